import datetime as dt
import io
import json
import time
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.sources import files, queue
from tesserae.streaming import tasks as S


def docx(paragraphs, table):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def epub(*pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, page in enumerate(pages):
            z.writestr(f"p{k}.xhtml", page)
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain è")
    (tmp_path / "b.epub").write_bytes(epub("<p>one</p>", "<script>x</script><p>two</p>"))
    (tmp_path / "c.docx").write_bytes(docx(["first", "", "second"], [["x", "y"]]))
    (tmp_path / "d.epub").write_bytes(b"not a zip")
    (tmp_path / "e.pdf").write_bytes(b"PK")
    (tmp_path / "f.xyz").write_bytes(b"?")
    (tmp_path / "g.docx").write_bytes(b"broken")
    by = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert (by["a.txt"].text, by["b.epub"].text, by["c.docx"].text) == ("plain è", "one\n\ntwo", "first\nsecond\nx | y")
    assert {n: by[n].format for n in ("d.epub", "e.pdf", "f.xyz")} == dict.fromkeys(("d.epub", "e.pdf", "f.xyz"), "unknown")
    assert by["g.docx"].text is None and by["g.docx"].error


def test_versions_and_stage_tables(spark, tmp_path):
    v = spark.createDataFrame([("chunk-000", 1, "old"), ("chunk-000", 2, "new"), ("chunk-000-micro-001", 3, "child")], "_key string, _modified int, body string")
    assert {r._key: r.body for r in files.latest_version(v).collect()} == {"chunk-000": "new", "chunk-000-micro-001": "child"}
    out = str(tmp_path / "t")
    rows = lambda stage, x: spark.createDataFrame([("c", stage, x)], "collection_id string, stage string, x int")
    files.write_stage(rows("a", 1), out)
    files.write_stage(rows("b", 2), out)
    files.write_stage(rows("a", 3), out)
    assert sorted((r.stage, r.x) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 2)]


def test_taxonomy(spark):
    got = files.load_taxonomy(spark, "rain:\n  soft: {description: light, tags: [a, b]}\n  hard:\n").collect()
    assert sorted((r.canonical_id, r.description, r.tags) for r in got) == [("hard", None, []), ("soft", "light", ["a", "b"])]


def test_wav_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, 2.0], [-2.0, 0.25, 0.0], 8000)], "l array<float>, r array<float>, rate int")
    got = df.select(files.decode_wav(files.encode_wav("l", "r", "rate")).alias("w")).first().w
    assert got.rate == 8000 and [round(x, 3) for x in got.left] == [0.0, 0.5, 1.0] and round(got.right[0], 3) == -1.0
    assert files.wav_samples(b"junk") == (0, [], [])
    mono = io.BytesIO()
    with wave.open(mono, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100), w.writeframes(b"\x00\x40" * 2)
    assert files.wav_samples(mono.getvalue())[1] == files.wav_samples(mono.getvalue())[2] == [0.5, 0.5]


def test_queue(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = lambda seqs: spark.createDataFrame([("a", s, json.dumps({"n": s})) for s in seqs], "queue string, seq long, payload string")
    queue.push(spark, path, rows([1, 2]))
    queue.push(spark, path, rows([3]), head=True)
    got = queue.peek(spark, path, "a").orderBy("position")
    assert [r.n for r in queue.parse(got, "n INT").collect()] == [3, 1, 2]
    assert queue.peek(spark, path, "none").count() == 0
    spark.dataSource.register(queue.QueueSource)
    read = spark.read.format("json_queue").option("messages", '[{"a":1},{"a":2}]').load()
    assert [r.payload for r in read.orderBy("seq").collect()] == ['{"a": 1}', '{"a": 2}']


def test_worker_leaves_paused_collections(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "go"), (2, "stop")], "n int, k string").write.parquet(source)
    stream = S.read_stream(spark, source)
    S.work_queue(stream, lambda df: df.withColumn("n", F.col("n") * 10), lambda s: s.createDataFrame([("stop",)], "k string"), str(tmp_path / "out"), str(tmp_path / "held"), "k")
    assert [(r.n, r.k) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(10, "go")]
    assert [(r.n, r.reason) for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [(2, "paused")]


def test_a_failing_worker_puts_back_pauses_and_stops(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string").write.parquet(at("in"))
    stream = S.read_stream(spark, at("in"))
    nobody = lambda s: s.createDataFrame([], "k string")
    broken = lambda df: df.withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("model is down")).cast("int")).otherwise(F.col("n")))
    S.work_queue(stream, broken, nobody, at("out"), at("held"), "k", at("pauses"), at("mark"))
    held, pauses = spark.read.parquet(at("held")), spark.read.parquet(at("pauses"))
    assert sorted((r.n, r.k, r.reason) for r in held.collect()) == [(1, "a", "failed"), (2, "b", "failed")]
    assert {r.k for r in pauses.collect()} == {"a", "b"} and all("model is down" in r.reason for r in pauses.collect())
    assert S.resumable(held, pauses, "k").count() == 0
    assert [(r.n, r.k) for r in S.resumable(held, pauses.where("k <> 'a'"), "k").collect()] == [(1, "a")]
    # the next worker goes on after what this one has read
    S.work_queue(stream, lambda df: df, nobody, at("out"), at("held"), "k", at("pauses"), at("mark"))
    assert spark.read.parquet(at("held")).count() == 2
    with pytest.raises(Exception, match="model is down"):
        S.work_queue(stream, broken, nobody, at("out2"), at("held2"), "k")


def test_tasks_in_flight_time_out(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    row = lambda e, u, t: (e, u, t, dt.datetime(2026, 1, 1, 0, 0, e))
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    spark.createDataFrame([row(1, 1, "click"), row(2, 2, "purchase")], schema).coalesce(1).write.parquet(at("in"))
    states = S.task_states(spark.readStream.schema(schema).parquet(at("in")), 1)
    q = states.writeStream.format("parquet").option("checkpointLocation", at("mark")).trigger(processingTime="0 seconds").start(at("out"))
    try:  # such a stream has always another batch to run, as timers may be due
        got, end = [], time.monotonic() + 45
        while len(got) < 3 and time.monotonic() < end:
            time.sleep(1)
            got = sorted((r.user_id, r.status) for r in spark.read.schema(states.schema).parquet(at("out")).collect()) if q.lastProgress else []
    finally:
        q.stop()
    assert got == [(1, "IN_FLIGHT"), (1, "TIMEOUT"), (2, "COMPLETED")]


def test_stage_outputs_of_the_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
