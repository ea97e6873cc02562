"""Queries with order: timelines, islands, sessions, tags, packing, marks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..operators import ordered as O
from ..operators import timeline as L
from ..session import table
from ..sources import files

UNITS_SQL = """u AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[^\\s\\x0b\\x85\\xa0]+')) AS words,
  len(regexp_extract_all(text, '[^\\s\\x0b\\x85\\xa0]+')) * 400 AS ms, CASE role WHEN 'user' THEN 400 WHEN 'assistant' THEN 200 ELSE 80 END AS pause FROM conversations)"""


def units(spark, sf_dir):
    """Turns as spoken units: 400 ms a word, a pause by role."""
    c = table(spark, sf_dir, "conversations")
    words = X.word_count(F.col("text")).cast("bigint")
    pause = F.when(F.col("role") == "user", 400).when(F.col("role") == "assistant", 200).otherwise(80).cast("bigint")
    return c.select("conv_id", "turn", "role", "text", words.alias("words"), (words * 400).alias("ms"), pause.alias("pause"))


@query("timeline_offsets", f"""WITH {UNITS_SQL} SELECT conv_id, turn, CAST(coalesce(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset,
  ms + pause AS total_time FROM u""")
def timeline_offsets(spark, sf_dir):
    return L.offsets(units(spark, sf_dir), ["conv_id"], ["turn"], "ms", "pause").select("conv_id", "turn", F.col("start_offset").cast("bigint").alias("start_offset"), "total_time")


@query("timeline_rollup", f"""WITH {UNITS_SQL}, o AS (SELECT conv_id, role, ms + pause AS t, coalesce(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
  SELECT conv_id, role, CAST(min(s) AS BIGINT) AS first_start, CAST(sum(t) AS BIGINT) AS total_time, CASE WHEN grouping(conv_id) = 1 THEN 0 WHEN grouping(role) = 1 THEN 1 ELSE 2 END AS level FROM o GROUP BY ROLLUP (conv_id, role)""")
def timeline_rollup(spark, sf_dir):
    placed = L.offsets(units(spark, sf_dir), ["conv_id"], ["turn"], "ms", "pause")
    got = L.roll_up(placed, ["conv_id", "role"], "start_offset", "total_time")
    return got.select("conv_id", "role", F.col("first_start").cast("bigint").alias("first_start"), F.col("total_time").cast("bigint").alias("total_time"), F.col("level").cast("int").alias("level"))


@query("section_slices", "SELECT conv_id, turn AS start_turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), max(turn) OVER (PARTITION BY conv_id) + 1) AS end_turn FROM conversations")
def section_slices(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = F.max("turn").over(Window.partitionBy("conv_id")) + 1
    return c.select("conv_id", F.col("turn").alias("start_turn"), O.next_or(F.col("turn"), last, ["conv_id"], ["turn"]).alias("end_turn"))


@query("islands_by_role", """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS ch FROM conversations),
  i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS island FROM c)
  SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM i GROUP BY conv_id, island""")
def islands_by_role(spark, sf_dir):
    got = O.with_islands(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", ["conv_id"], ["turn"])
    return got.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


@query("forward_fill_state", """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_purchase FROM events""")
def forward_fill_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", O.forward_fill(value, F.lit(-1), ["user_id"], ["ts", "event_id"]).alias("last_purchase"))


@query("marker_sessions", """SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM events) GROUP BY 1, 2""")
def marker_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    session = O.marker_session(F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"])
    return e.withColumn("session", session).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


@query("resequence_ids", "SELECT doc_id, printf('%03d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS number FROM documents")
def resequence_ids(spark, sf_dir):
    got = O.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "n")
    return got.select("doc_id", X.zero_pad(F.col("n")).alias("number"))


@query("arc_tags", """WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS intensity FROM conversations)
  SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN 'Intro' WHEN row_number() OVER w = count(*) OVER (PARTITION BY conv_id) THEN 'Outro' WHEN intensity = 'mid' AND lead(intensity) OVER w = 'high' THEN 'Pre-Chorus'
  WHEN intensity = 'mid' THEN 'Verse' WHEN intensity = 'high' THEN 'Chorus' END AS tag FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def arc_tags(spark, sf_dir):
    level = F.when(F.col("turn") % 3 == 0, "low").when(F.col("turn") % 3 == 1, "mid").otherwise("high")
    return L.arc_tags(table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("intensity")), ["conv_id"], ["turn"], "intensity").drop("intensity")


@query("single_accent", """SELECT event_id, CASE WHEN count(p) OVER (PARTITION BY user_id, d ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 THEN p END AS accent
  FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events)""")
def single_accent(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    accent = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", O.keep_first_non_null(accent, ["user_id", "day"], ["event_id"]).alias("accent"))


@query("gaps_over_threshold", """SELECT event_id, gap FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) WHERE gap > 3600000000""")
def gaps_over_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", O.gap_to_next(F.col("us"), F.col("us"), ["user_id"], ["ts", "event_id"]).alias("gap")).where("gap > 3600000000")


@query("budget_packing", """WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS n FROM conversations),
  r AS (SELECT conv_id, i, turn, n AS total, 0 AS block FROM c WHERE i = 1 UNION ALL
        SELECT c.conv_id, c.i, c.turn, CASE WHEN r.total + c.n > 1500 THEN c.n ELSE r.total + c.n END, CASE WHEN r.total + c.n > 1500 THEN r.block + 1 ELSE r.block END FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1)
  SELECT conv_id, turn, block FROM r""")
def budget_packing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    packed = c.select("conv_id", F.arrays_zip(F.col("t.turn").alias("turn"), O.fold_budget(F.col("t.n"), 1500).alias("block")).alias("z"))
    return packed.select("conv_id", F.explode("z").alias("z")).select("conv_id", "z.turn", "z.block")


@query("placement_times", f"""WITH {UNITS_SQL}, o AS (SELECT conv_id, turn, role, ms / 1000.0::DOUBLE AS voice, coalesce(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000.0::DOUBLE AS t,
  CASE turn % 4 WHEN 0 THEN 'ambient' WHEN 1 THEN 'spot' WHEN 2 THEN 'accent' ELSE 'motif' END AS kind, CASE turn % 3 WHEN 0 THEN 'middle' WHEN 1 THEN 'end' ELSE 'start' END AS timing FROM u)
  SELECT conv_id, turn, round(CASE kind WHEN 'ambient' THEN t + 0.25 WHEN 'spot' THEN greatest(0, CASE timing WHEN 'middle' THEN t + voice / 2 WHEN 'end' THEN t + voice - 2 ELSE t END + 0.25)
  WHEN 'accent' THEN CASE timing WHEN 'end' THEN t + voice WHEN 'middle' THEN t + voice / 2 ELSE t END ELSE CASE timing WHEN 'end' THEN greatest(0, t + voice - 1) WHEN 'middle' THEN t + voice / 2 ELSE t END END, 3) AS at_s FROM o""")
def placement_times(spark, sf_dir):
    placed = L.offsets(units(spark, sf_dir), ["conv_id"], ["turn"], "ms", "pause")
    kind = F.element_at(F.array(*map(F.lit, ("ambient", "spot", "accent", "motif"))), (F.col("turn") % 4 + 1).cast("int"))
    timing = F.element_at(F.array(*map(F.lit, ("middle", "end", "start"))), (F.col("turn") % 3 + 1).cast("int"))
    at = L.placement(kind, timing, F.col("start_offset") / 1000.0, F.col("ms") / 1000.0, F.lit(2.0), F.lit(0.25))
    return placed.select("conv_id", "turn", F.round(at, 3).alias("at_s"))


@query("concat_manifest", f"""WITH {UNITS_SQL}, f AS (SELECT conv_id, turn, unnest(CASE WHEN role = 'user' THEN ['file ''conv-' || conv_id || '-' || turn || '.wav''', 'file ''silence_400ms.wav'''] ELSE ['file ''conv-' || conv_id || '-' || turn || '.wav'''] END) AS line,
  unnest(CASE WHEN role = 'user' THEN [0, 1] ELSE [0] END) AS k FROM u) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS line_no, line FROM f""")
def concat_manifest(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("path", F.format_string("conv-%d-%d.wav", "conv_id", "turn")).withColumn("silence", F.when(F.col("role") == "user", 400).otherwise(0))
    return files.concat_manifest(u, ["conv_id"], ["turn"], "path", "silence")


@query("section_marks", f"""WITH {UNITS_SQL}, s AS (SELECT *, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'chapter_001') AS sec,
  coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
  c AS (SELECT *, CASE WHEN sec = lag(sec) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS ch FROM s), i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS mark FROM c)
  SELECT conv_id, CAST(mark AS BIGINT) AS mark, any_value(sec) AS section, CAST(min(st) AS BIGINT) AS start_ms, CAST(max(st + ms) AS BIGINT) AS end_ms FROM i GROUP BY conv_id, mark""")
def section_marks(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("section", F.when(F.col("turn") % 3 == 1, F.col("role")))
    return L.section_marks(u, ["conv_id"], ["turn"], "section", "ms")


@query("clock_formats", """SELECT DISTINCT o_orderkey % 20000 AS s, printf('%02d:%02d', (o_orderkey % 20000) // 60, (o_orderkey % 20000) % 60) AS mmss,
  CASE WHEN o_orderkey % 20000 >= 3600 THEN printf('%d:%02d:%02d', (o_orderkey % 20000) // 3600, (o_orderkey % 20000) % 3600 // 60, (o_orderkey % 20000) % 60) ELSE printf('%d:%02d', (o_orderkey % 20000) % 3600 // 60, (o_orderkey % 20000) % 60) END AS clock FROM orders""")
def clock_formats(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 20000).alias("s")).distinct()
    return s.select("s", X.minutes_seconds(F.col("s")).alias("mmss"), X.hours_minutes_seconds(F.col("s") * 1000).alias("clock"))


@query("chapter_metadata", f"""WITH {UNITS_SQL}, s AS (SELECT conv_id, turn, role, ms, coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u)
  SELECT conv_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(st AS BIGINT) || chr(10) || 'END=' || CAST(st + ms AS BIGINT) || chr(10) || 'title=' || role || chr(10), '' ORDER BY turn) AS metadata FROM s GROUP BY conv_id""")
def chapter_metadata(spark, sf_dir):
    placed = units(spark, sf_dir).withColumn("start_ms", O.running_before(F.col("ms"), ["conv_id"], ["turn"]).cast("bigint"))
    marks = placed.select("conv_id", "start_ms", (F.col("start_ms") + F.col("ms")).alias("end_ms"), F.col("role").alias("title"))
    return files.chapter_metadata(marks, ["conv_id"])


@query("chapter_round_trip", f"""WITH {UNITS_SQL}, s AS (SELECT conv_id, turn, role, ms, coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u)
  SELECT conv_id, CAST(st AS BIGINT) AS start_ms, CAST(st + ms AS BIGINT) AS end_ms, role AS title FROM s""")
def chapter_round_trip(spark, sf_dir):
    rows = chapter_metadata(spark, sf_dir).select("conv_id", F.explode(files.parse_chapter_metadata(F.col("metadata"))).alias("c"))
    return rows.select("conv_id", "c.start_ms", "c.end_ms", "c.title")


@query("scene_groups", """SELECT conv_id, coalesce(role, 'unknown_chapter') AS section, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1, 2""")
def scene_groups(spark, sf_dir):
    section = F.coalesce("role", F.lit("unknown_chapter")).alias("section")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", section).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
