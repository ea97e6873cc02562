import random
import re
from collections import defaultdict

import pytest

from tesserae.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "x", 1) for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        open_ = sum(w[s] for s in names if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else rest * w[s] / open_ if open_ else 0 for s in names}
        above = {s for s in names if s not in capped and target[s] >= epochs * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(i, " ".join("w" for _ in range(rnd.randint(0, 90))), rnd.choice(["hot"] * 6 + ["a", "Z", "é", "\U0001f600", None, "tiny"])) for i in range(400)]
    return [*out, (900, None, "a"), (901, "", "empty"), (902, " \t\n", None), (903, "one word two", "tiny"), (904, "w " * 3000, "Z")]


def test_plan(spark, rows):
    got = M.mix_plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix_plan(frame(spark, rows)).collect()), key=str)


def test_documents_follow_the_plan(spark, rows):
    docs = frame(spark, rows)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    words, text = defaultdict(int), {i: t for i, t, _ in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert text[r.doc_id].startswith(r.text)
    assert dict(words) == {r.doc_id: r.taken for r in M.mix_plan(docs).collect() if r.taken}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_rows_are_cut_once(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(12):
        row = (rnd.choice([i, None]), " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randint(1, 12))), rnd.choice("ab"))
        rows += [row] * rnd.choice([1, 3, 8])
    rows += [(5, "same id other text", "a"), (5, "same id third text here", "a")]
    docs = frame(spark, rows)
    plan, got = defaultdict(int), defaultdict(int)
    for r in M.mix_plan(docs).collect():
        plan[r.source_size] += r.taken
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for r in M.mix_documents(docs).collect():
        got[sizes[r.source]] += len(r.text.split())
    assert dict(got) == dict(plan)
    targets = brute_targets(sizes)
    assert all(abs(got[sizes[s]] - targets[s]) <= 0.5 for s in sizes) or sizes["a"] == sizes["b"]


def test_one_row_many_times_is_spread(spark):
    docs = frame(spark, [(7, "one two three", "a")] * 3000 + [(i, "x y", "b") for i in range(100)])
    got = [r.taken for r in M.mix_plan(docs).collect()]
    assert len(got) == 3100 and all(0 <= t <= 6 for t in got)
    sizes = {"a": 9000, "b": 200}
    assert sum(got) == sum(round(t) for t in brute_targets(sizes).values())


def test_empty_and_wordless(spark):
    assert M.mix_plan(frame(spark, [])).collect() == [] and M.mix_documents(frame(spark, [])).count() == 0
    got = M.mix_plan(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
