import random

import numpy as np

from tesserae.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic string, label_id string, severity string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


def corpus(n=400):
    rnd, out, labels = random.Random(5), [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 200))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "nasty", "rotten", "Foul,"]))
        out.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return out, labels


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    half = spark.createDataFrame([(i, y) for i, y in labels if i % 2] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.learn(docs, half)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(got[i].toxic == bool(y) for i, y in labels)
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, y in labels if not y}


def test_severity_grows_with_the_cues(spark):
    rows, labels = corpus()
    model = T.learn(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = [model.expected("plain words " * 20 + "vile nasty " * k) for k in range(6)]
    assert scores == sorted(scores) and scores[0] < 0.2 < 1 < scores[-1]


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 1))
    latent = 1.5 * x[:, 0] + rng.logistic(size=6000)
    y = (latent > -0.5).astype(int) + (latent > 1.0)
    w, t = T.fit_ordinal(x, y, 3, np.array([1e-6]), np.array([1.0]), 1500)
    assert abs(w[0] - 1.5) < 0.15 and abs(t[0] + 0.5) < 0.15 and abs(t[1] - 1.0) < 0.15


def test_defined_results_without_labels_or_texts(spark):
    rows = [(1, None), (2, ""), (3, "vile"), (3, "vile")]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.learn(frame(spark, rows), none)
    assert [r.severity for r in T.score(frame(spark, rows), model).collect()] == [0.0] * 4
    one_kind = T.learn(frame(spark, rows), spark.createDataFrame([(3, 1)], "doc_id long, toxic int"))
    assert one_kind.expected("vile") == 0.0
    assert T.score(frame(spark, []), model).collect() == [] and T.keep_clean(frame(spark, []), model).count() == 0


def test_beginnings_of_words_are_cues(spark):
    """Toxic words that share a beginning, each seen rarely, and a group of near copies of one toxic text."""
    rows, labels = corpus(300)
    rnd = random.Random(17)
    end = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    clean = [(i, t) for (i, t), (_, y) in zip(rows, labels, strict=True) if not y]
    extra = [(1000 + k, t + f" grim{end()} and grim{end()}") for k, (_, t) in enumerate(clean[:60])]
    docs = frame(spark, [*clean, *extra])
    model = T.learn(docs, spark.createDataFrame([*((i, 0) for i, _ in clean), *((i, 1) for i, _ in extra[:40])], "doc_id long, toxic int"))
    assert "grim*" in model.vocabulary
    assert all(model.expected(t) >= 0.5 for _, t in extra[40:])
    assert np.mean([model.expected(t) < 0.5 for _, t in clean]) > 0.98


def test_near_copies_share_a_key(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(0, text), (1, text + " end"), (2, "a b"), (3, ""), (4, "other words here")], "i int, t string")
    key = {r[0]: r[1] for r in df.select("i", T._same_text(df.t)).collect()}
    assert key[0] == key[1] and len(set(key.values())) == 4


def test_learning_is_the_same_however_rows_are_dealt_out(spark):
    rows, labels = corpus(200)
    rows += [(500 + k, rows[3][1] + f" tail{k}") for k in range(9)]  # near copies share one vote
    known = spark.createDataFrame([*labels, *((500 + k, labels[3][1]) for k in range(9))], "doc_id long, toxic int")
    models = [T.learn(frame(spark, rows).repartition(n), known.repartition(n)) for n in (1, 7)]
    assert models[0].vocabulary == models[1].vocabulary
    assert np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].thresholds, models[1].thresholds)


def test_texts_that_share_a_passage_all_count(spark):
    """Toxic texts with one long common passage and a word of their own kind: none of them is left out."""
    rows, labels = corpus(200)
    passage = " ".join(f"p{k}" for k in range(40))
    extra = [(1000 + k, f"{passage} vex vex {' '.join(f'q{k}x{j}' for j in range(40))}") for k in range(30)]
    model = T.learn(frame(spark, rows + extra), spark.createDataFrame([*labels, *((i, 1) for i, _ in extra)], "doc_id long, toxic int"))
    assert "vex" in model.vocabulary


def test_scores_match_a_plain_computation(spark):
    rows, labels = corpus(300)
    docs = frame(spark, [*rows, (900, None), (901, "vile " * 400_000), (902, "x" * 1_000_000)])
    model = T.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in T.score(docs, model).collect():
        text = dict([*rows, (901, "vile " * 400_000), (902, "x" * 1_000_000)]).get(r.doc_id) or ""
        plain, cues, n = {}, 0, 0
        for w in T._WORDS.findall(text.lower()):
            own = [f for f in [w, *(w[:k] + "*" for k in range(3, 8) if len(w) > k)] if f in model.vocabulary]
            for f in own:
                plain[f] = plain.get(f, 0) + 1
            cues, n = cues + any(model.cue[model.vocabulary[f]] for f in own), n + 1
        s = sum(model.weights[model.vocabulary[f]] * np.log1p(c) for f, c in plain.items())
        s += model.weights[-3] * np.log1p(cues) + model.weights[-2] * (cues > 0) + model.weights[-1] * min(100 * cues / max(n, 1), 10)
        want = sum(1 - 1 / (1 + np.exp(-min(max(t - s, -60), 60))) for t in model.thresholds)
        assert abs(r.severity - want) < 1e-9 and r.toxic == (r.severity >= 0.5)
