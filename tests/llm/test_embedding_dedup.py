import numpy as np
from test_components import brute

from tesserae.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in vectors], SCHEMA)


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    near = [base[i % 40] + rng.standard_normal(32) * rng.uniform(0.02, 0.6) for i in range(200)]
    x = np.concatenate([base, near, base[:5], base[:1] * 3]).astype(np.float32)
    got = {r.vec_id: r for r in E.embedding_components(frame(spark, enumerate(x)), cell_size=20, chunk=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = u @ u.T >= 0.9
    np.fill_diagonal(hits, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= hits[i].sum() for i in range(len(x)))
    assert found >= 0.98 * hits.sum()
    exact = np.array([got[i].n_links == hits[i].sum() for i in range(len(x))])
    assert exact.mean() > 0.97
    root = brute([(int(a), int(b)) for a, b in zip(*np.nonzero(hits), strict=True)])
    same = [got[i].component_id == root.get(i, i) for i in range(len(x))]
    assert np.mean(same) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_unusable_vectors_link_with_nothing(spark):
    v = [1.0, 0.0, 0.0, 1.0]
    rows = [(1, v), (2, None), (3, [0.0] * 4), (4, [1.0, None, 0.0, 1.0]), (5, [1.0, float("nan"), 0.0, 1.0]), (6, [float("inf"), 0, 0, 0]), (7, [1.0, 0.0]), (8, v), (9, []), (10, [2.0, 0, 0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_components(frame(spark, rows)).collect()}
    assert got[1] == (2, 1, True) and got[8] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 9))


def test_empty_and_null_ids(spark):
    assert E.embedding_components(frame(spark, [])).collect() == []
    got = E.embedding_components(frame(spark, [(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 2, -1), (3, 2, 3), (3, 2, 3)]


def test_each_length_of_vectors_has_its_own_links(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(30)] + [(100, [1.0, 2.0]), (101, [2.0, 4.1]), (102, [-1.0, 2.0]), (200, [3.0]), (201, [5.0]), (202, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_components(frame(spark, rows)).collect()}
    assert got[100] == (1, 100) and got[101] == (1, 100) and got[102] == (0, 102)
    assert got[200] == (1, 200) and got[201] == (1, 200) and got[202] == (0, 202)


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(600, [1.0, 2.0, 3.1]), (601, [-3.0, 0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_components(frame(spark, rows)).collect()}
    assert all(got[i] == (500, 0) for i in range(500)) and got[600] == (500, 0) and got[601] == (0, 601)


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    cells = list(E.multi_sequence(a, b, 1.1))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums)
    assert set(cells) == {(i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= 1.1}


def test_dense_groups_count_like_any_other(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 24))
    copies = [base[0] + rng.standard_normal(24) * 0.05 for _ in range(150)] + [base[1] + rng.standard_normal(24) * 0.05 for _ in range(60)]
    fringe = [base[0] + rng.standard_normal(24) * 0.35 for _ in range(60)] + [base[0] * (1 - t) + base[1] * t for t in np.linspace(0, 1, 30)]
    x = np.concatenate([base, copies, fringe]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert len(E.dense_pivots(u, np.sqrt(0.95) + 1e-6)) == 2
    hits = u @ u.T >= 0.9
    np.fill_diagonal(hits, False)
    got = {r.vec_id: r for r in E.embedding_components(frame(spark, enumerate(x)), cell_size=40, chunk=16).collect()}
    assert all(got[i].n_links <= hits[i].sum() for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * hits.sum()
    root = brute([(int(a), int(b)) for a, b in zip(*np.nonzero(hits), strict=True)])
    assert np.mean([got[i].component_id == root.get(i, i) for i in range(len(x))]) > 0.98
