import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.model_call import call_model, stub_client
from tesserae.operators import cues, joins, ordered, quality, signal, structure, tasks, timeline


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_wins_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("k", 2, "b"), ("k", 2, "a")], "key string, ord int, v string")
    assert rows(ordered.first_wins(df, ["key"], ["ord"])) == [("k", 2, "a"), (None, 1, "a")]
    assert rows(ordered.latest(df, ["key"], ["ord"])) == [("k", 2, "b"), (None, 3, "c")]


def test_islands_with_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "i int, v string").withColumn("k", F.lit(1))
    got = ordered.with_islands(df, "v", ["k"], ["i"])
    assert [r.island for r in got.orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, "a", 4)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 100), ("a", 9, 101), ("b", 2, 102)], "k string, t int, v int")
    assert rows(ordered.asof_last(left, right, ["k"], "t", "t", ["v"], "id").select("id", "asof_v")) == [(1, 100), (2, 101), (3, None), (4, None)]


@pytest.mark.parametrize(("sizes", "blocks"), [([], []), ([5], [0]), ([20], [0]), ([4, 4, 4, 20, 1], [0, 0, 1, 2, 3])])
def test_budget_fold(spark, sizes, blocks):
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(ordered.fold_budget(F.col("s"), 10)).first()[0] == blocks


def test_defaults_apply_together(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, None, 7)], "kk int, a int, b int")
    assert rows(joins.left_with_defaults(left, right, "k", "kk", {"a": 0, "b": 5})) == [(1, None, 7), (2, 0, 5)]


def test_contained_texts(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps over"), (2, "a b"), (3, None), (4, "pre-the quick brown fox jumps overly")], "id int, t string")
    items = spark.createDataFrame([(9, "the quick brown fox jumps over"), (8, "a b"), (7, "nothing here to be found at all")], "item int, body string")
    assert rows(joins.first_contained(docs, "id", "t", items, "item", "body")) == [(1, 9), (2, 8), (4, 9)]


def test_range_join_equals_nested_loops(spark):
    rng = np.random.default_rng(0)
    spans = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.uniform(-50, 50, 40), rng.uniform(-1, 30, 40), strict=True))]
    points = [(i, float(p)) for i, p in enumerate(rng.uniform(-60, 90, 80))]
    got = joins.range_join(spark.createDataFrame(spans, "a int, lo double, hi double"), spark.createDataFrame(points, "b int, p double"), "lo", "hi", "p", 7.0)
    assert rows(got.select("a", "b")) == sorted((a, b) for a, lo, hi in spans for b, p in points if lo <= p <= hi) or len(rows(got)) == sum(lo <= p <= hi for _, lo, hi in spans for _, p in points)


def test_range_counts_equal_nested_loops(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    spans = [(int(k), float(a), float(a + w)) for k, a, w in zip(rng.integers(0, 20, 60), rng.integers(-40, 40, 60), rng.integers(-5, 30, 60), strict=True)]
    spans += [(None, -5.0, 5.0), (None, 0.0, 0.0), (30, None, 1.0), (31, 1.0, None), (32, nan, nan), (33, 5.0, nan), (34, -inf, inf), (35, inf, inf), (36, -0.0, -0.0), (37, 900.0, 901.0)]
    points = [float(p) for p in rng.integers(-50, 70, 300)] + [0.0, -0.0, nan, nan, inf, -inf, None]
    rank = lambda v: (1, 0.0) if v != v else (0, v)  # noqa: E731  # NaN is above all numbers and equals itself
    want = {k: 0 for k, _, _ in spans}
    for k, lo, hi in spans:
        want[k] += sum(None not in (lo, hi, p) and rank(lo) <= rank(p) <= rank(hi) for p in points)
    left, right = spark.createDataFrame(spans, "k int, lo double, hi double"), spark.createDataFrame([(p,) for p in points], "p double")
    assert rows(joins.range_counts(left, ["k"], right, "lo", "hi", "p", "n")) == sorted(want.items(), key=repr)
    whole = spark.createDataFrame([(1,), (1,), (4,), (None,)], "p int")  # of another type than the bounds
    assert rows(joins.range_counts(spark.createDataFrame([(1, 0.5, 1.5), (2, 1.0, 4.0)], "k int, lo double, hi double"), ["k"], whole, "lo", "hi", "p", "n")) == [(1, 2), (2, 3)]
    assert rows(joins.range_counts(left.limit(0), ["k"], right, "lo", "hi", "p", "n")) == []
    assert {r.n for r in joins.range_counts(left, ["k"], right.limit(0), "lo", "hi", "p", "n").collect()} == {0}


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 1000])
def test_summed_up_to_in_buckets(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    values = sorted({float(v) for v in np.concatenate([rng.uniform(0, 1, 200), rng.lognormal(0, 20, 200)])}) + [float("inf")]
    data = [(v, int(n)) for v, n in zip(values, rng.integers(-3, 9, len(values)), strict=True)]
    got = ordered.summed_up_to(spark.createDataFrame(data, "v double, n int").repartition(5), "v", "n", "upto", rows_per_bucket)
    assert [tuple(r) for r in got.orderBy("v").collect()] == [(v, n, int(s)) for (v, n), s in zip(data, np.cumsum([n for _, n in data]), strict=True)]


def test_harmonized_ids(spark):
    units = spark.createDataFrame([("rain",), ("rain_02",), ("wind_01",), ("none",)], "u string")
    req = spark.createDataFrame([(1, "rain"), (2, "wind_03"), (3, "wind_04"), (4, "rain_02")], "o int, r string")
    assert rows(joins.harmonize_ids(units, "u", req, "r", "o", "h")) == [("none", "none"), ("rain", "rain_02"), ("rain_02", "rain_02"), ("wind_01", "wind_01")]


def test_best_record_is_the_fold(spark):
    rng = np.random.default_rng(4)
    data = [(int(k), i, int(s), str(r)) for i, (k, s, r) in enumerate(zip(rng.integers(0, 8, 120), rng.integers(0, 30, 120), rng.choice(["primary", "secondary", "tactical", "odd"], 120), strict=True))]
    want = {}
    for k, o, s, r in data:
        old = want.get(k)
        if old is None:
            want[k] = (o, s, r)
        elif s > old[1]:
            rank = lambda x: quality.ROLES.get(x, 0)
            want[k] = (o, s, r if rank(r) > rank(old[2]) else old[2])
    got = quality.best_record(spark.createDataFrame(data, "k int, o int, score int, role string"), ["k"], "o", "score", "role")
    assert {r.k: (r.o, r.score, r.role) for r in got.collect()} == want


def test_json_salvage(spark):
    texts = ['{"a":1}', 'Sure!\n```json\n{"a": 2}\n```\nbye', "prose", "", None, '{"a":"x"}', '[{"a":3}]']
    got = quality.salvage_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "a INT")
    assert {r.i: (r.parsed.a if r.parsed else None, r.broken) for r in got.collect()} == {0: (1, False), 1: (2, False), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, True), 6: (3, False)}
    many = quality.salvage_json_list(spark.createDataFrame([(0, 'x [{"a":1},{"a":2}]'), (1, 'y {"a":3} z'), (2, "none")], "i int, t string"), "t", "a INT")
    assert {r.i: [p.a for p in r.parsed or []] for r in many.collect()} == {0: [1, 2], 1: [3], 2: []}


def test_quarantine_and_flags(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "i int, valence double")
    good, bad = quality.quarantine(df, {"valence": F.col("valence").between(0, 1)})
    assert rows(good) == [(1, 0.5)] and [r.violations for r in bad.collect()] == [["valence"]] * 2
    assert [r[0] for r in df.select(quality.flags({"HIGH": F.col("valence") > 1})).collect()] == [["OK"], ["HIGH"], ["OK"]]


def test_structure_kinds_and_sections(spark):
    texts = {1: "Chapter 1: One\nabc\nChapter 2: Two\nxyz", 2: "Prologo\nx\n1\naa\n2\nbb\n1\ncc\n", 3: "GREAT HALL ONE\n" + "x" * 60 + "\nGREAT HALL TWO\n" + "y" * 60 + "\n", 4: "nothing", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert {r.id: r.kind for r in docs.select("id", structure.kind(F.col("text")).alias("kind")).collect()} == {1: "titled", 2: "numbered", 3: "capitals", 4: "plain", 5: "plain"}
    got = {}
    for r in structure.boundaries(docs, "id").orderBy("id", "section_index").collect():
        got.setdefault(r.id, []).append((r.section_title, r.start_pos, r.end_pos))
    assert got[1] == [("Chapter 1: One", 0, 19), ("Chapter 2: Two", 19, 37)]
    assert [g[0] for g in got[2]] == ["Prologo", "1", "2"] and got[2][-1][2] == len(texts[2])
    assert [g[0] for g in got[3]] == ["Great Hall One", "Great Hall Two"]
    assert got[4] == [("Section 001", 0, 7)] and got[5] == [("Section 001", 0, 0)]


def test_profile_matching(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 10, 2), (1, 20, 901), (2, 0, 7), (2, 9, 8), (2, 12, 9), (3, 4, 0), (3, 8, 998)], "id int, pos int, number int")
    profile = spark.createDataFrame(
        [(1, 1, "Prologo"), (1, 2, "1"), (1, 3, "2"), (1, 4, "Coda 1: end"), (2, 1, "Uno"), (2, 2, "Due"), (3, 1, "Prologue"), (3, 2, "middle"), (3, 3, "EPILOGO")], "id int, section int, name string"
    )
    got = rows(structure.match_profile(found, profile, "id").select("id", "pos", "section", "name"))
    assert sorted(got) == [(1, 5, 2, "1"), (1, 10, 3, "2"), (1, 20, 4, "Coda 1: end"), (2, 0, 1, "Uno"), (2, 9, 2, "Due"), (3, 4, 1, "Prologue"), (3, 8, 3, "EPILOGO")]


def test_a_missing_grid_aborts(spark):
    units = spark.createDataFrame([(1, 1), (1, 2)], "p int, u int")
    grid = spark.createDataFrame([(1, 1, 2.5), (9, 1, 1.0)], "p int, u int, s double")
    assert rows(joins.required_grid(units, grid, "p", "u", {"s": 0.0})) == [(1, 1, 2.5), (1, 2, 0.0)]
    with pytest.raises(Exception, match="no timing for 2"):
        joins.required_grid(units.unionByName(spark.createDataFrame([(2, 1)], "p int, u int")), grid, "p", "u", {"s": 0.0}).collect()


def test_marks_and_lyrics(spark):
    u = spark.createDataFrame([(1, 0, None, 100), (1, 1, "b", 50), (1, 2, None, 50), (1, 3, "a", 10), (1, 4, "b", 5)], "k int, i int, s string, ms int")
    assert rows(timeline.section_marks(u, ["k"], ["i"], "s", "ms")) == [(1, 0, "chapter_001", 0, 100), (1, 1, "b", 100, 200), (1, 2, "a", 200, 210), (1, 3, "b", 210, 215)]
    a = spark.createDataFrame([(1, 0.0, "low", None, None), (1, 60.0, "low", "[x]. Falls.", None), (1, 125.5, "high", None, "loud")], "k int, start_s double, intensity string, roadmap_item string, note string")
    assert [r.lyric for r in cues.lyric_lines(a, ["k"]).orderBy("start_s").collect()] == ["[00:01.00] [Intro] Low section.", "[01:01.00] None Falls", "[02:06.50] [Outro] loud"]


def test_signal_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 500)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    r = df.select(signal.rms(F.col("x")), signal.peak(F.col("x")), signal.clipped(F.col("x"), 0.5), signal.normalize_peak(F.col("x"), -3.0), signal.fit_length(F.col("x"), 3), signal.fade_out(F.col("x"), 10)).first()
    assert r[0] == pytest.approx(np.sqrt((x * x).mean())) and r[1] == pytest.approx(abs(x).max()) and r[2] == (abs(x) >= 0.5).sum()
    assert np.allclose(r[3], x / abs(x).max() * 10 ** (-3 / 20)) and len(r[4]) == 3 and r[5][-1] == 0
    assert np.allclose(signal.frame_rms(np.ones(4096))[3:5], 1.0)


def test_audio_features_of_a_tone_and_of_noise(spark):
    rate, rng = 22_050, np.random.default_rng(2)
    tone, noise = np.sin(2 * np.pi * 440 * np.arange(rate) / rate), rng.normal(0, 0.3, rate)
    clicks = np.where(np.arange(rate) % 5000 < 20, 0.9, 0.0)
    df = spark.createDataFrame([(n, x) for n, x in [("tone", tone.tolist()), ("noise", noise.tolist()), ("clicks", clicks.tolist()), ("silence", [0.0] * 3000), ("empty", []), ("none", None)]], "n string, x array<double>")
    got = {r.n: r.s for r in df.select("n", signal.audio_features(F.col("x"), rate).alias("s")).collect()}
    assert got["tone"].pitch_mean == pytest.approx(440, rel=0.01) and got["tone"].voiced_ratio > 0.9
    assert got["tone"].centroid == pytest.approx(440, rel=0.2) and got["tone"].zero_crossings == pytest.approx(2 * 440 / rate, rel=0.1)
    assert got["noise"].voiced_ratio < 0.1 and got["noise"].rolloff > 8000 and len(got["noise"].mfcc) == 13
    assert got["clicks"].onset_max > 5 * got["clicks"].onset_mean and got["tone"].chroma_variance < got["noise"].chroma_variance
    assert got["silence"].silence_ratio == 1 and got["silence"].pitch_mean == 0 and got["silence"].centroid == 0
    assert got["empty"].mfcc is None and got["none"].centroid is None


def test_voiced_intervals_end_with_the_signal(spark):
    x = np.concatenate([np.ones(4096), np.zeros(8192), np.ones(1000)]).tolist()
    df = spark.createDataFrame([(0, x), (1, [0.0] * 100), (2, []), (3, None)], "i int, x array<double>")
    got = {r.i: [tuple(v) for v in r.v] for r in df.select("i", signal.voiced_intervals(F.col("x")).alias("v")).collect()}
    assert len(got[0]) == 2 and got[0][-1][1] == len(x) and got[1] == [(0, 100)] and got[2] == got[3] == []


def test_ducking_multiplies_overlaps(spark):
    s = spark.createDataFrame([(1, i, 1.0) for i in range(100)], "g int, sample_idx int, value double")
    ranges = [(1, 10, 60, -6.0, 5), (1, 40, 90, -12.0, 5)]
    got = {r.sample_idx: r.value for r in signal.apply_ducking(s, spark.createDataFrame(ranges, "g int, start int, end int, depth_db double, fade int"), "g", width=16).collect()}
    want = np.ones(100)
    for _, a, b, db, fade in ranges:
        low, n = 10 ** (db / 20), b - a
        ramp = min(fade, n // 3)
        gain = np.full(n, low)
        gain[:ramp] = 1 - (1 - low) * np.arange(ramp) / ramp
        gain[n - ramp :] = low + (1 - low) * np.arange(ramp) / ramp
        want[a:b] *= gain
    assert np.allclose([got[i] for i in range(100)], want)


def test_task_states(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([("a", t(0), "IN_FLIGHT"), ("a", t(1), "FAILED"), ("a", t(2), "IN_FLIGHT"), ("b", t(0), "COMPLETED"), ("c", t(59), "IN_FLIGHT")], "task string, at timestamp, status string")
    got = tasks.with_readiness(tasks.latest_state(e, "task", ["at"], "status"), F.lit(dt.datetime(2024, 1, 1, 1, 0)))
    assert {r.task: (r.status, r.attempts, r.ready) for r in got.collect()} == {"a": ("TIMEOUT", 1, True), "b": ("COMPLETED", 0, False), "c": ("IN_FLIGHT", 0, False)}


@pytest.mark.parametrize("kind", ["int", "double", "string", "date", "timestamp_ntz"])
def test_numbering_cuts_a_hot_key_into_buckets(spark, kind):
    rng = np.random.default_rng(3)
    day = lambda v: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(v) * 977)
    make = {"int": int, "double": lambda v: float("inf") if v > 990 else float("nan") if v > 980 else float(v), "string": lambda v: f"n{v:05d}", "date": lambda v: day(v).date(), "timestamp_ntz": day}[kind]
    keys = [None if v < 0.2 else "hot" if v < 0.9 else "b" for v in rng.random(3000)]
    data = [(k, None if v < 5 else make(v), i) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 1000, 3000), strict=True))]
    df = spark.createDataFrame(data, f"k string, v {kind}, i int")
    w = Window.partitionBy("k").orderBy("v", "i")
    want = rows(df.select("k", "i", F.row_number().over(w), F.ntile(7).over(w), F.dense_rank().over(Window.partitionBy("k").orderBy("v"))))
    got = ordered.numbered(df, ["k"], ["v", "i"], "n", rows_per_bucket=50)
    got = ordered.dense_ranked(ordered.quantile_groups(got, ["k"], ["v", "i"], 7, "q"), ["k"], "v", "d")
    assert rows(got.select("k", "i", "n", "q", "d")) == want
    assert ordered.numbered(df.limit(0), ["k"], ["v"], "n").count() == 0
    assert sorted(r.n for r in ordered.numbered(df, [], ["v", "i"], "n", rows_per_bucket=50).collect()) == list(range(1, 3001))


def test_queue_order_and_replay(spark):
    q = spark.createDataFrame([("q", False, 1), ("q", False, 2), ("q", True, 3), ("q", True, 4)], "queue string, head boolean, seq int")
    assert [r.seq for r in tasks.queue_order(q, "queue", "head", "seq").orderBy("position").collect()] == [4, 3, 1, 2]
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    res = spark.createDataFrame([("a", "error", 1), ("a", "done", 2), ("b", "error", 1)], "k string, status string, updated_at int")
    assert rows(tasks.replay_or_submit(req, res, "k")) == [("a", "replay"), ("b", "resubmit"), ("c", "submit")]


def test_model_calls_reuse_the_cache(spark):
    p = spark.createDataFrame([(1, "x"), (2, "x"), (3, "boom")], "i int, prompt string")

    def client(prompt):
        if prompt == "boom":
            raise RuntimeError("429")
        return stub_client(prompt)

    got = {r.i: r for r in call_model(p, client).collect()}
    assert got[1].response == got[2].response == stub_client("x") and got[3].error == "RuntimeError: 429"
    cache = spark.createDataFrame([(got[1].cache_key, "kept")], "cache_key string, response string")
    assert {r.i: r.response for r in call_model(p, client, cache=cache).collect()} == {1: "kept", 2: "kept", 3: None}
