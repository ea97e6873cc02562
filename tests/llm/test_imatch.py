import functools
import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash

from tesserae.llm import imatch as I

SCHEMA = "doc_id long, text string, n_chars string, fingerprint string, c string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


def corpus(n=120):
    rnd = random.Random(3)
    vocabulary = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    return [(3 * i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120)))) for i in range(n)]


def test_lexicon_band(spark):
    rows = [*corpus(60), (1000, None), (1001, "")]
    docs = frame(spark, rows)
    got = set(I.lexicon(docs, idf_low=1.0, idf_high=3.0))
    df = Counter(w for _, t in rows for w in set((t or "").split()))
    n = len(rows)
    words = spark.createDataFrame([(w,) for w in df], "w string").selectExpr("w", "xxhash64(w) AS h").collect()
    want = {r.h for r in words if n * math.exp(-3.0) <= df[r.w] <= n * math.exp(-1.0)}
    assert got == want and want


def test_equal_terms_equal_fingerprints(spark):
    rows = [(1, "beta alpha Beta"), (2, "ALPHA, beta!"), (3, "alpha gamma"), (4, "only rare"), (5, "only rare"), (6, "Only rare"), (7, None), (8, ""), (9, "!!"), (10, "rare only")]
    lex = [r.h for r in spark.sql("SELECT xxhash64(w) AS h FROM VALUES ('alpha'), ('beta'), ('gamma') AS t(w)").collect()]
    got = {r.doc_id: r.fingerprint for r in I.fingerprints(frame(spark, rows), lex).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] == got[6] == got[10] != got[1] and got[7] == got[8] != got[9]
    assert all(len(got[i]) == 4 * (1 + I.REPLICAS * len(I.SIZES)) for i in range(1, 7)) and got[7][0] == got[9][0] == "="
    assert len({r.fingerprint for r in I.fingerprints(frame(spark, rows), []).collect()}) == 5


def test_edit_likeness(spark):
    rows = [*corpus(), (5, "é\U0001f600x"), (7, ""), (8, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in I.edit_likeness(docs, I.lexicon(docs, idf_low=0.5)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(ordered):
        q = len(t) // 4
        edited = t[: len(t) - q] + ordered[(k + 1) % len(ordered)][1][:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1.0 and got[i].fingerprint == got[i].edited_fingerprint
    long = [got[i] for i, t in ordered if len(t) > 100]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_ring(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10_000), 500)
    got = {r.i: r for r in I.ring(spark.createDataFrame([(i, i * 2) for i in ids], "i long, v long"), "i", "v").collect()}
    ids.sort()
    for k, i in enumerate(ids):
        assert (got[i].next_id, got[i].prev_id, got[i].prev_carry) == (ids[(k + 1) % len(ids)], ids[k - 1], 2 * ids[k - 1])


def test_one_and_none(spark):
    assert I.lexicon(frame(spark, [])) == [] and I.edit_likeness(frame(spark, []), []).collect() == []
    r = I.edit_likeness(frame(spark, [(1, "abcdefgh")]), []).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_null_and_repeated_ids(spark):
    long = corpus(6)
    rows = [*long, long[2], long[2], long[2], (long[4][0], "another text of the same id"), (None, "lost one"), (None, "lost two"), (None, "lost two"), (None, None)]
    docs = frame(spark, rows)
    got = I.edit_likeness(docs, I.lexicon(docs, idf_low=0.1)).collect()
    texts = spark.createDataFrame(sorted({(t or "",) for _, t in rows}), "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    hashed = {r.t: r.h for r in texts}
    ordered = sorted(((i is None, i or 0, hashed[t or ""], t or "") for i, t in rows))
    want = []
    for k, (none, i, _, t) in enumerate(ordered):
        q = len(t) // 4
        edited = t[: len(t) - q] + ordered[(k + 1) % len(ordered)][3][:q]
        want.append((None if none else i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == long[2][0]) >= 3


def test_a_large_lexicon_is_joined(spark):
    rows = [*corpus(), (5, "é\U0001f600x"), (7, ""), (8, None), *corpus(3), (None, "lost one")]
    docs = frame(spark, rows)
    sent, joined = I.lexicon(docs, idf_low=0.5), I.lexicon(docs, idf_low=0.5, literals=10)
    assert isinstance(sent, list) and {r.term for r in joined.collect()} == set(sent)
    assert Counter(I.edit_likeness(docs, joined).collect()) == Counter(I.edit_likeness(docs, sent).collect())
    assert Counter(I.fingerprints(docs, joined).collect()) == Counter(I.fingerprints(docs, sent).collect())


def brute_fingerprint(text, lex):
    """The fingerprint from its definition: XXH64 of terms, chained through sorted arrays."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    digest = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed & (1 << 64) - 1)
    chain = lambda ts: functools.reduce(lambda seed, t: digest(struct.pack("<q", t), seed), ts, 42) & 0xFFFF
    every = sorted({signed(digest(w.encode())) for w in regex.findall(r"[\p{L}\p{N}]+", text.lower())})
    terms = [t for t in every if t in lex] or every
    if not terms:
        return "=" + hashlib.md5(text.encode()).hexdigest()
    out = f"{chain(terms):04x}"
    for r in range(10):
        for s in range(1, 10):
            bits = [(t if r < 6 else digest(struct.pack("<q", t))) % (1 << 64) >> 10 * (r % 6) for t in terms]
            subset = [t for t, b in zip(terms, bits, strict=True) if b % (1 << s) == 0]
            out += f"{chain(subset):04x}" if subset else "...."
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "=" in (a[0], b[0]):
        return 0.0
    best = 0.0
    for k in range(9):
        pairs = [(a[4 + 4 * (9 * r + k) :][:4], b[4 + 4 * (9 * r + k) :][:4]) for r in range(10)]
        filled = sum(x != "...." or y != "...." for x, y in pairs)
        best = max(best, sum(x == y != "...." for x, y in pairs) / max(filled, 3))
    return best


def test_query_matches_brute_force(spark, sf_dir):
    from tesserae.llm.queries import op7_imatch_fingerprints

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    seen = Counter(w for _, t in docs for w in set(regex.findall(r"[\p{L}\p{N}]+", t.lower())))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    lex = {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w, n in seen.items() if 3.0 <= math.log(len(docs) / n) <= 5.3}
    got = {r.doc_id: r for r in op7_imatch_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r, prints = got[i], [brute_fingerprint(x, lex) for x in (t, edited, following)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[0], prints[1])
        assert r.near_edited == pytest.approx(brute_likeness(prints[0], prints[1])) and r.near_next == pytest.approx(brute_likeness(prints[0], prints[2]))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + " ".join(f"w{k}" for k in range(50_000))), (2, "x" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in I.edit_likeness(docs, I.lexicon(docs)).collect()}
    assert got[1].n_chars > 2_000_000 and 0 <= got[1].near_edited <= 1
