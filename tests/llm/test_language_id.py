import random

import numpy as np

from tesserae.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, gram string, score string"
SYLLABLES = {"xx": ["tho", "ing", "ea", "wh", "st"], "yy": ["ção", "nho", "qu", "ei", "ar"], "zz": ["sch", "ung", "ö", "pf", "en"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "x") for i, t, lang in rows], SCHEMA)


def corpus(n=150):
    rnd = random.Random(6)
    return [(i, text(rnd, lang, rnd.randint(3, 60)), lang) for i in range(n) for lang in [rnd.choice(sorted(SYLLABLES))]]


def test_counts_by_hand():
    n = L.gram_counts("Ab")
    assert n.sum() == 4 + 3 + 2  # " ab ": characters, pairs, triples
    assert (L.gram_counts("a  b\n") == L.gram_counts("A b")).all()
    long = "ab " * 400_000
    assert L.gram_counts(long).sum() > 3_000_000


def test_held_out_accuracy_and_extra_columns(spark):
    rows = corpus()
    model = L.learn(frame(spark, rows[:100]))
    got = {r.doc_id: r for r in L.identify(frame(spark, [(i, t, None) for i, t, _ in rows]), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[100:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixtures_have_several_languages(spark):
    rnd = random.Random(8)
    model = L.learn(frame(spark, corpus()))
    mixed = text(rnd, "xx", 80) + " " + text(rnd, "zz", 40)
    lang, share, langs = model.predict(mixed)
    assert (lang, langs) == ("xx", ["xx", "zz"]) and 0.5 < share < 0.85
    assert model.predict(text(rnd, "yy", 60))[2] == ["yy"]


def test_mixtures_and_unwanted_languages_go(spark):
    rnd = random.Random(12)
    model = L.learn(frame(spark, corpus()))
    half = text(rnd, "xx", 60) + " " + text(rnd, "zz", 60)
    rows = [(1, text(rnd, "xx", 60), "zz"), (2, text(rnd, "yy", 60), None), (3, half, "xx"), (4, "12 34", "xx"), (5, None, "xx"), (6, text(rnd, "zz", 60), "zz")]
    kept = lambda **how: sorted(r.doc_id for r in L.keep_identified(frame(spark, rows), model, **how).collect())
    assert kept() == [1, 2, 6]
    noisy = [(7, text(rnd, "xx", 9) + " +1 (269) 555-3296 nm.22@mail7.example.com 4524132264652876", "xx"), (8, "x1 y2", None)]
    assert [r.doc_id for r in L.keep_identified(frame(spark, noisy), model).collect()][:1] == [7]
    assert kept(languages=["xx", "yy"]) == [1, 2]
    assert kept(min_share=0.0) == [1, 2, 3, 6]


def test_em_reaches_the_likelihood_of_a_grid_search():
    rng = np.random.default_rng(1)
    counts = {lang: rng.integers(1, 50, L.SIZE).astype(float) for lang in "ab"}
    m = L.Mixture(counts, rounds=300)
    n = rng.integers(0, 5, 400).astype(np.float32)
    p = m.p[:400]
    share, fit = m._fit(n, p)
    grid = max(float(n @ np.log(p @ np.array([w, 1 - w]))) for w in np.linspace(0.001, 0.999, 999))
    assert fit >= grid - 0.05


def test_undetermined(spark):
    model = L.learn(frame(spark, corpus(60)))
    rows = [(1, None, "xx"), (2, "", None), (3, "12 34 -- !", "xx"), (4, "thoing", None), (4, "thoing", None)]
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in L.identify(frame(spark, rows), model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "xx", True), (4, "xx", True)]
    assert [r.doc_id for r in L.keep_identified(frame(spark, rows), model).collect()] == [4, 4]
    nothing = L.learn(frame(spark, [(1, "abc", None), (2, None, "xx")]))
    assert nothing.langs == [] and L.identify(frame(spark, rows), nothing).where("lang_pred = 'und'").count() == 5
    assert L.identify(frame(spark, []), model).collect() == []
