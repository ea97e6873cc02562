import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import simhash as S


def hamming(a, b):
    return bin(a ^ b).count("1")


def brute_fingerprint(text, k=3):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "  \t\n", "One", "Ärger A b", "A b C d", "x " * 700 + "y", "nb sp   wide"])
def test_fingerprint(text):
    got = S.simhash_words(S.shingle_hashes(text, 3), 1)[0]
    assert int(got) == brute_fingerprint(text)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40), st.integers(0, 20), st.randoms())
@settings(max_examples=40, deadline=None)
def test_bit_planes_count_every_distance(values, radius, rnd):
    near = [v ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1) for v in values]
    words = np.array(values + near, np.uint64).reshape(-1, 1)
    n, planes = len(words), S.BitPlanes(words, radius)
    for shift in range(1, n):
        got = planes.within(shift, (1 << (n - shift)) - 1)
        want = sum(1 << i for i in range(n - shift) if hamming(int(words[i, 0]), int(words[i + shift, 0])) <= radius)
        assert got == want


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts = base + [t + " zz" for t in base[:20]] + base[:15] + [None, "", "   ", "A B c", "a b C"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, keys int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = groups(list(prints), lambda a, b: hamming(prints[a], prints[b]) <= 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_large_buckets_lose_no_pair(spark):
    rnd = random.Random(5)
    fps = {0: 0}
    for i in range(1, 300):
        fps[i] = rnd.choice(list(fps.values())) ^ (1 << rnd.randrange(20, 64))
    unique = {v: k for k, v in reversed(fps.items())}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(k, signed(v), 65536 * s + (v >> (16 * s) & 0xFFFF)) for v, k in unique.items() for s in range(4)]
    df = spark.createDataFrame(rows, "id long, fp long, bucket long")
    links = S.candidate_links(df, ["fp"], 3, bucket_limit=16, block=32)
    from tesserae.llm.components import connected_components

    got = {r.node: r.root for r in connected_components(links.select("a", "b")).collect()}
    ids = {k: v for v, k in unique.items()}
    want = groups(list(ids), lambda a, b: hamming(ids[a], ids[b]) <= 3)
    assert got == {k: r for k, r in want.items() if k != r}


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert S.simhash_components(spark.createDataFrame([], schema)).collect() == []
    got = S.simhash_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (2, 2), (4, 4), (4, 4)]


def test_near_copies_at_five_words(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = {i: [word() for _ in range(120)] for i in range(40)}
    for i in range(20):
        copy = list(texts[i])
        copy[rnd.randrange(110)] = word()
        texts[100 + i] = copy
    half = {200 + i: texts[20 + i][:60] + [word() for _ in range(60)] for i in range(10)}
    rows = [(i, " ".join(t), "n") for i, t in {**texts, **half}.items()]
    docs = spark.createDataFrame([*rows, (None, "lone", "n"), (300, None, "n"), (301, "", "n"), (7, rows[7][1], "n")], "doc_id long, text string, node string")
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([*range(40), *half, 300])
    assert ids.count(None) == 1


def test_near_copies_of_an_empty_table(spark):
    assert S.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_groups(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.node: r.root for r in S.near_duplicate_groups(docs).collect()}


def test_repeated_lines_do_not_link_different_texts(spark):
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = [word() for _ in range(24)]
    texts = {i: " ".join(line * 30 + [word() for _ in range(200)]) for i in range(12)}
    assert near_groups(spark, texts) == {}


def shingle_sets(texts):
    return {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}


def jaccard_groups(texts):
    sets = shingle_sets(texts)
    want = groups(list(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return {i: r for i, r in want.items() if i != r}


def chained_texts(rnd, n_groups=4, size=30):
    """Groups in which neighbours are about 0.8 alike and others less, so that many likely pairs fail."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = {}
    for g in range(n_groups):
        base = [word() for _ in range(150)]
        for k in range(size):
            texts[100 * g + k] = " ".join(base)
            at = rnd.randrange(130)
            base = [*base[:at], *[word() for _ in range(rnd.choice((2, 9, 14)))], *base[at + 10 :]]
    return texts


def test_every_link_is_verified(spark):
    texts = chained_texts(random.Random(19))
    assert near_groups(spark, texts) == jaccard_groups(texts)


@pytest.mark.parametrize("how", [{"chunk": 8}, {"chunk": 4, "load": 900}, {"bucket_limit": 3}, {"bucket_limit": 3, "chunk": 5}])
def test_large_families_and_buckets_lose_no_link(spark, how):
    rnd = random.Random(29)
    texts = chained_texts(rnd, 2, 40)
    base = texts[0].split()
    for k in range(60):  # a dense group around one text, its members about 0.8 alike
        t = list(base)
        for _ in range(3):
            t[rnd.randrange(len(t))] = f"w{rnd.randrange(10**6)}"
        texts[1000 + k] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.node: r.root for r in S.near_duplicate_groups(docs, **how).collect()} == jaccard_groups(texts)


def test_recall_between_080_and_085(spark):
    """Pairs whose Jaccard similarity lies in [0.80, 0.85], each pair apart from all others."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts, pairs = {}, 0
    while pairs < 400:
        n = rnd.choice((12, 40, 90, 200, 600))
        one = [word() for _ in range(n)]
        two = list(one)
        for _ in range(max(1, n // 50)):
            at = rnd.randrange(n)
            two[at : at + rnd.randint(1, 3)] = [word()]
        a, b = (set(S.shingle_hashes(" ".join(x), 5).tolist()) for x in (one, two))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            texts[2 * pairs], texts[2 * pairs + 1] = " ".join(one), " ".join(two)
            pairs += 1
    got = near_groups(spark, texts)
    found = sum(got.get(2 * i + 1) == 2 * i for i in range(pairs))
    print("recall between 0.80 and 0.85:", found / pairs)
    assert found >= 0.99 * pairs
    assert len(got) == found


@given(st.lists(st.sets(st.integers(0, 60)), min_size=2, max_size=9))
@settings(max_examples=40, deadline=None)
def test_common_counts(raw):
    sets = [np.array(sorted(x), np.uint64) for x in raw]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b] * 9, strict=True))
    want = [len(raw[a] & raw[b]) for a, b in zip(i, j, strict=True)]
    for limit in (1 << 26, 200, 0):
        assert S.common_counts(sets, i, j, limit).tolist() == want


@pytest.mark.parametrize(("n", "n_masks"), [(10, 4), (1 << 25, 10), (1 << 35, 20), (1 << 45, 35)])
def test_masks_cover_three_differing_bits(n, n_masks):
    masks = S.block_masks(n, 3)
    assert len(masks) == n_masks
    rnd = random.Random(n)
    for _ in range(300):
        flipped = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(not flipped & m for m in masks)


@pytest.mark.parametrize("fill", [1e-3, 1e-7])
def test_components_with_masks_of_many_blocks(spark, fill):
    rnd = random.Random(13)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts = dict(enumerate(base + [t + " zz" for t in base]))
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = groups(list(prints), lambda a, b: hamming(prints[a], prints[b]) <= 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.simhash_components(docs, fill=fill).collect()} == want


def test_very_long_texts(spark):
    rnd = random.Random(37)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300_000))
    texts = {1: long, 2: long + " tail words", 3: long[: len(long) // 2], 4: "w" * 2_000_000, 5: "w" * 2_000_000 + " x"}
    assert near_groups(spark, texts) == {2: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: brute_fingerprint(t) for i, t in texts.items() if i > 3}
    got = {r.doc_id: r.fingerprint for r in S.simhash_components(docs).collect()}
    assert {i: got[i] for i in prints} == {i: f"{p:016x}" for i, p in prints.items()}


def test_recall_of_short_and_repetitive_texts(spark):
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(150):  # 4 of 5 shingles
        t = [word() for _ in range(9)]
        texts[2 * i], texts[2 * i + 1] = " ".join(t), " ".join(t[:8])
    for i in range(1000, 1020, 2):  # the same set, a passage of one text repeated
        t = [word() for _ in range(220)]
        texts[i], texts[i + 1] = " ".join(t + t[:24]), " ".join(t + t[:24] * 15)
    line = [word() for _ in range(12)]
    for i in range(2000, 2200, 4):  # a common line, edits at the end, sizes around the limit of the exact join
        t = line + [word() for _ in range(rnd.randint(1, 50))]
        for k in range(4):
            cut = rnd.randint(0, max(1, len(t) // 4))
            texts[i + k] = " ".join(t[: len(t) - cut] + [word() for _ in range(rnd.randint(0, cut))])
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    want = groups(list(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert near_groups(spark, texts) == {i: r for i, r in want.items() if i != r}
    assert sum(want[2 * i + 1] == 2 * i for i in range(150)) == 150
