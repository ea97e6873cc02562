"""Catalogue and progress reads, unit and cue queries, and scalar expressions against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..functions.model_call import call_model, stub_client
from ..operators import cues as C
from ..operators import joins as J
from ..operators import ordered as O
from ..session import table
from ..sources import files
from .temporal import UNITS_SQL, units


@query("section_counts", """SELECT conv_id, count(*) AS scenes, count(*) FILTER (role = 'assistant') AS voiced, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def section_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("role") == "assistant").alias("voiced"), F.sum(F.length("text")).alias("chars"))


@query("segments_with_audio_counts", """SELECT d.source, count(*) AS segments, CAST(sum(CASE WHEN l.n IS NULL THEN 0 ELSE l.n END) AS BIGINT) AS audio FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1""")
def segments_with_audio_counts(spark, sf_dir):
    audio = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "documents").join(audio, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce("n", F.lit(0))).alias("audio"))


@query("scene_listing", """SELECT c.conv_id, c.turn, c.role, left(c.text, 40) AS preview, l.quality IS NOT NULL AS has_audio FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def scene_listing(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality")  # noqa: E741
    got = table(spark, sf_dir, "conversations").join(l, F.col("conv_id") == F.col("k"), "left")
    return got.select("conv_id", "turn", "role", F.left("text", F.lit(40)).alias("preview"), F.col("quality").isNotNull().alias("has_audio"))


@query("role_filter", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant')")
def role_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn")


@query("completed_files", """SELECT page_id, url FROM pages WHERE url NOT LIKE '%blog.%' AND url NOT LIKE '%/es/%' AND contains(url, 'example') AND length(html) > 1000""")
def completed_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(~F.contains("url", F.lit("blog.")) & ~F.contains("url", F.lit("/es/")) & F.contains("url", F.lit("example")) & (F.length("html") > 1000)).select("page_id", "url")


@query("chunk_discovery", """SELECT regexp_extract(url, '://([^/?#]+)', 1) AS chunk, list_sort(list(CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER))) AS micro FROM pages GROUP BY 1""")
def chunk_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("chunk"), F.regexp_extract("url", "/([0-9]+)", 1).cast("int").alias("n"))
    return p.groupBy("chunk").agg(F.sort_array(F.collect_list("n")).alias("micro"))


@query("case_insensitive_lookup", """SELECT c_custkey FROM customer WHERE lower(c_name) = 'customer#000000042' OR regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') = 'customer_000000007'""")
def case_insensitive_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.lower("c_name") == "customer#000000042") | (X.normalize_id(F.col("c_name")) == "customer_000000007")).select("c_custkey")


@query("field_fallbacks", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, o_orderstatus) AS text, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0.5e0) AS arousal FROM orders""")
def field_fallbacks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.col("o_orderstatus")).alias("text"),
        F.coalesce(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")), F.lit(0.5)).alias("arousal"),
    )


@query("unit_scripts", f"""WITH {UNITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, round(0.4 + 0.5 * ((turn % 10) / 10e0), 3) AS e FROM u)
  SELECT conv_id, turn, CAST(n AS INTEGER) AS scene_number, conv_id || '-scene-' || printf('%03d', n) AS scene_id, lower(coalesce(nullif(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE '' END, ''), 'neutro')) AS primary_emotion, e AS energy,
  round(words / 150e0 * 60, 3) AS estimated_seconds, contains(text, '"') AS has_dialogue FROM r""")
def unit_scripts(spark, sf_dir):
    u = units(spark, sf_dir).select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise("").alias("emotion"), F.lit(None).cast("string").alias("block"), ((F.col("turn") % 10) / 10.0).alias("arousal"))
    got = C.unit_scripts(u, ["conv_id"], "turn", "text", "emotion", "block", "arousal")
    return got.select("conv_id", "turn", "scene_number", "scene_id", "primary_emotion", "energy", "estimated_seconds", "has_dialogue")


@query("automation_join", """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS depth, arg_max(event_id, event_id) AS fade FROM events GROUP BY 1)
  SELECT c_custkey, CASE WHEN a.user_id IS NULL THEN 'medium' ELSE depth END AS depth, CASE WHEN a.user_id IS NULL THEN -1 ELSE fade END AS fade FROM customer LEFT JOIN a ON c_custkey = user_id""")
def automation_join(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("depth"), F.col("event_id").alias("fade"), "event_id")
    return C.with_automation(table(spark, sf_dir, "customer").select("c_custkey"), a, "c_custkey", "event_id", {"depth": "medium", "fade": -1})


@query("events_on_timeline", f"""WITH {UNITS_SQL}, o AS (SELECT conv_id, turn, coalesce(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
  SELECT event_id, CAST(s AS BIGINT) AS start_ms FROM events JOIN o ON conv_id = user_id AND turn = event_id % 8""")
def events_on_timeline(spark, sf_dir):
    placed = units(spark, sf_dir).withColumn("start_ms", O.running_before(F.col("ms") + F.col("pause"), ["conv_id"], ["turn"]).cast("bigint"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("conv_id"), (F.col("event_id") % 8).alias("turn"))
    return e.join(placed, ["conv_id", "turn"]).select("event_id", "start_ms")


@query("ordinal_sections", """SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey + 1""")
def ordinal_sections(spark, sf_dir):
    """Nations carry their number as a Roman numeral, regions as an English word; both are parsed and joined."""
    numerals = F.array(F.lit(""), *[F.lit(X.roman(k)) for k in range(1, 31)])
    words = F.array(*map(F.lit, ("First:", "SECOND", "third.", "four", "Five,")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", X.parse_ordinal(numerals[F.col("n_nationkey")]).alias("number"))
    r = table(spark, sf_dir, "region").select("r_name", X.parse_ordinal(words[F.col("r_regionkey")]).alias("number_"))
    return n.join(r, F.col("number") == F.col("number_"), "left").select("n_nationkey", "r_name")


@query("sections_filled_from_second_source", """SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 'order ' || min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1""")
def sections_filled_from_second_source(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("m"))
    return a.unionByName(b.join(a.select("k"), "k", "left_anti").select("k", F.concat(F.lit("order "), F.col("m").cast("string")).alias("name")))


@query("micro_spans", f"""WITH {UNITS_SQL}, o AS (SELECT conv_id, turn, ms, coalesce(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
  SELECT conv_id, printf('%02d:%02d', CAST(min(s) AS BIGINT) // 60000, CAST(min(s) AS BIGINT) // 1000 % 60) AS first_at, CAST(arg_max(s + ms, turn) AS BIGINT) AS end_ms FROM o GROUP BY conv_id""")
def micro_spans(spark, sf_dir):
    placed = units(spark, sf_dir).withColumn("s", O.running_before(F.col("ms") + F.col("pause"), ["conv_id"], ["turn"]).cast("bigint"))
    return placed.groupBy("conv_id").agg(X.minutes_seconds(F.floor(F.min("s") / 1000)).alias("first_at"), F.max_by(F.col("s") + F.col("ms"), "turn").alias("end_ms"))


@query("voice_levels", """SELECT l_returnflag, round(avg(nullif(l_discount, 0)), 6) AS mean, min(nullif(l_discount, 0)) AS least, max(nullif(l_discount, 0)) AS most FROM lineitem GROUP BY 1""")
def voice_levels(spark, sf_dir):
    x = X.falsy_to_null(F.col("l_discount"), 0.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("registry_sizes", """SELECT event_type, count(*) AS n, list_sort(list(event_id))[1:10] AS first_ids FROM events GROUP BY 1""")
def registry_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    top = O.top_k(e, ["event_type"], [F.col("event_id")], 10).groupBy("event_type").agg(F.sort_array(F.collect_list("event_id")).alias("first_ids"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(top, "event_type")


@query("dashboard_totals", """SELECT count(*) AS units, count(*) FILTER (role = 'assistant') AS voiced, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS user_chars, round(100.0 * count(*) FILTER (role = 'assistant') / count(*), 2)::DOUBLE AS percent FROM conversations""")
def dashboard_totals(spark, sf_dir):
    voiced = F.count_if(F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").agg(
        F.count(F.lit(1)).alias("units"), voiced.alias("voiced"), F.sum(F.when(F.col("role") == "user", F.length("text"))).alias("user_chars"), F.round(100.0 * voiced / F.count(F.lit(1)), 2).alias("percent")
    )


@query("stage_file_counts", """SELECT source, count(*) AS a, count(l.doc_id) AS b, count(*) FILTER (l.toxic = 1) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def stage_file_counts(spark, sf_dir):
    got = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"), "toxic"), "doc_id", "left")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("a"), F.count("has").alias("b"), F.count_if(F.col("toxic") == 1).alias("c"))


@query("lyric_lines", """WITH a AS (SELECT conv_id, turn * 47.25e0 AS start_s, ['low', 'mid', 'high', 'odd'][turn % 4 + 1] AS intensity, CASE turn % 4 WHEN 0 THEN '[a-1]. Rises ' || role || '.' WHEN 3 THEN 'no tag' END AS item, CASE WHEN turn % 5 < 3 THEN 'note ' || turn END AS note FROM conversations),
  t AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '[Intro]' WHEN row_number() OVER w = count(*) OVER (PARTITION BY conv_id) THEN '[Outro]' WHEN intensity = 'mid' AND lead(intensity) OVER w = 'high' THEN '[Pre-Chorus]' WHEN intensity = 'high' THEN '[Chorus]' WHEN intensity = 'low' THEN 'None' ELSE '[Verse]' END AS tag,
    CAST((start_s + 1) * 100 AS BIGINT) AS cs FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY start_s))
  SELECT conv_id, start_s, printf('[%02d:%02d.%02d]', cs // 6000, cs % 6000 // 100, cs % 100) || ' ' || tag || ' ' || CASE WHEN item IS NOT NULL THEN coalesce(nullif(regexp_extract(item, '\\. (.+)\\.$', 1), ''), note, '') ELSE coalesce(note, upper(intensity[1]) || intensity[2:] || ' section.') END AS lyric FROM t""")
def lyric_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    level = F.element_at(F.array(*map(F.lit, ("low", "mid", "high", "odd"))), (t % 4 + 1).cast("int"))
    item = F.when(t % 4 == 0, F.concat(F.lit("[a-1]. Rises "), "role", F.lit("."))).when(t % 4 == 3, "no tag")
    s = c.select("conv_id", (t * 47.25).alias("start_s"), level.alias("intensity"), item.alias("roadmap_item"), F.when(t % 5 < 3, F.concat(F.lit("note "), t.cast("string"))).alias("note"))
    return C.lyric_lines(s, ["conv_id"]).select("conv_id", "start_s", "lyric")


@query("arc_rules", """WITH a AS (SELECT conv_id, count(*) * 200 AS d, count(*) AS n, list(turn * 60 ORDER BY turn) AS s, list(turn * 60 + CASE WHEN turn = 3 THEN 30 ELSE 60 END ORDER BY turn) AS e, bool_or(turn = 3) AS short FROM conversations GROUP BY 1)
  SELECT conv_id, array_to_string(list_filter([CASE WHEN NOT (CASE WHEN d < 600 THEN n = 3 WHEN d <= 1800 THEN n BETWEEN 4 AND 5 ELSE n >= 6 END) THEN 'segment_count' END, CASE WHEN short THEN 'segment_too_short' END], lambda x: x IS NOT NULL), ',') AS broken FROM a""")
def arc_rules(spark, sf_dir):
    ends = F.col("turn") * 60 + F.when(F.col("turn") == 3, 30).otherwise(60)
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        (F.count(F.lit(1)) * 200).alias("d"), F.sort_array(F.collect_list(F.struct((F.col("turn") * 60).alias("s"), ends.alias("e")))).alias("z")
    )
    return a.select("conv_id", F.array_join(C.arc_violations(F.col("d"), F.col("z.s"), F.col("z.e")), ",").alias("broken"))


@query("asset_requests", """WITH b AS (SELECT replace(p_type, ' ', '_') || '_01' AS canonical_id, 0 AS r, p_partkey AS ord, 'bed' AS kind FROM part WHERE p_size > 40 UNION ALL SELECT replace(p_name, ' ', '_') || '_01', 1, p_partkey, 'item' FROM part UNION ALL SELECT replace(p_type, ' ', '_') || '_01', 1, p_partkey, 'item' FROM part)
  SELECT canonical_id, arg_min(kind, (r, ord)) AS kind, arg_min(ord, (r, ord)) AS ord FROM b GROUP BY 1""")
def asset_requests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    slug = lambda c: F.replace(c, F.lit(" "), F.lit("_")).alias("canonical_id")
    ids = lambda c, kind: p.select(slug(c), F.col("p_partkey").alias("ord"), F.lit(kind).alias("kind"), "p_size")
    got = C.request_list(ids("p_type", "bed").where("p_size > 40").drop("p_size"), ids("p_name", "item").unionByName(ids("p_type", "item")).drop("p_size"))
    return got.select("canonical_id", "kind", "ord")


@query("scalar_expressions", """SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract('retryDelay: ' || o_orderkey % 90, 'retryDelay: ([0-9]+)', 1), '') AS INTEGER) + 5, 65) AS delay,
  translate(replace(lower(o_orderpriority), ' ', '_'), '''.', '') AS motif, CASE WHEN starts_with(lower(o_orderpriority), '1-') THEN o_orderpriority ELSE '1-' || o_orderpriority END AS prefixed,
  round(pow(10, (o_orderkey % 40 - 20) / 20e0), 6) AS gain, CAST(trunc((o_orderkey % 1000) / 7e0 * 44100) AS BIGINT) AS samples, CASE o_orderstatus WHEN 'F' THEN 7200 WHEN 'O' THEN 1500 ELSE 900 END AS timeout,
  lower(o_orderpriority) LIKE '%urgent%' OR contains(o_orderpriority, '429') AS transient, 'At ~' || CAST(trunc((o_orderkey % 100) / 100e0 * 100) AS INTEGER) || '%: ' || o_orderstatus AS arc FROM orders""")
def scalar_expressions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        X.retry_delay(F.concat(F.lit("retryDelay: "), (k % 90).cast("string"))).alias("delay"),
        X.motif_id(F.col("o_orderpriority")).alias("motif"),
        X.ensure_prefix(F.col("o_orderpriority"), "1-").alias("prefixed"),
        F.round(X.db_to_linear((k % 40 - 20).cast("double")), 6).alias("gain"),
        X.seconds_to_samples((k % 1000) / F.lit(7.0)).alias("samples"),
        X.timeout_seconds(F.when(F.col("o_orderstatus") == "F", "bed").when(F.col("o_orderstatus") == "O", "motif")).alias("timeout"),
        X.is_transient(F.col("o_orderpriority"), ("429", "urgent")).alias("transient"),
        X.arc_line((k % 100) / F.lit(100.0), F.col("o_orderstatus")).alias("arc"),
    )


@query("friendly_titles", "SELECT n_nationkey, 'Nation ' || n_nationkey AS title, '''/a/'' b' AS quoted FROM nation")
def friendly_titles(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", X.friendly_title(F.lower("n_name")).alias("title"), F.replace(X.shell_quote_path(F.lit("'/a/' b")), F.lit("'\\''"), F.lit("'")).alias("quoted"))


@query("config_upsert", """SELECT n_nationkey, 'name=' || n_name || ',region=' || n_regionkey || ',status=done' AS config FROM nation""")
def config_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = F.create_map(F.lit("name"), F.col("n_name"), F.lit("status"), F.lit("new"))
    change = F.create_map(F.lit("status"), F.lit("done"), F.lit("region"), F.col("n_regionkey").cast("string"))
    entries = F.transform(F.map_entries(files.upsert_config(base, change)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return n.select("n_nationkey", F.array_join(F.sort_array(entries), ",").alias("config"))


@query("log_lines", """SELECT event_id, '{"event_id":' || event_id || CASE WHEN value > 20 THEN ',"note":"' || event_type || '"' ELSE '' END || '}' AS line FROM events""")
def log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("note", F.when(F.col("value") > 20, F.col("event_type")))
    return e.select("event_id", files.log_lines("event_id", "note").alias("line"))


@query("report_lines", """SELECT conv_id, '| ' || conv_id || ' | ' || count(*) || ' |' AS row FROM conversations GROUP BY 1""")
def report_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", F.concat(F.lit("| "), F.col("conv_id").cast("string"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("row"))


@query("wav_durations", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(trunc(event_id * 100 / CAST(event_id % 5 * 11025 AS DOUBLE) * 1000) AS INTEGER) END AS ms FROM events""")
def wav_durations(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", files.wav_milliseconds(e * 100, e % 5 * 11025).alias("ms"))


@query("stub_model_calls", "SELECT count(DISTINCT lang || ' ' || source) AS prompts, 0 AS errors FROM documents")
def stub_model_calls(spark, sf_dir):
    """The remote model as a batch function, with its stub: each distinct prompt is asked once."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("prompt"))
    got = call_model(p, stub_client)
    return got.agg(F.countDistinct("response", "prompt").alias("prompts"), F.count("error").cast("int").alias("errors"))


@query("two_sided_lookup", """SELECT count(*) AS rows, count(*) FILTER (s_suppkey IS NULL) AS only_customer, count(*) FILTER (c_custkey IS NULL) AS only_supplier FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3""")
def two_sided_lookup(spark, sf_dir):
    got = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey") * 3, "full")
    return got.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s_suppkey").isNull()).alias("only_customer"), F.count_if(F.col("c_custkey").isNull()).alias("only_supplier"))


@query("required_grid_join", """SELECT conv_id, turn, coalesce(e.n, 0) AS events FROM conversations LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = conv_id""")
def required_grid_join(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return J.left_with_defaults(table(spark, sf_dir, "conversations").select("conv_id", "turn"), n, "conv_id", "user_id", {"events": 0})


@query("numbered_first_occurrence", "SELECT user_id, CAST(floor(value) AS INTEGER) AS number, min(event_id) AS event_id FROM events WHERE value < 20 GROUP BY 1, 2")
def numbered_first_occurrence(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value < 20").select("user_id", F.floor("value").cast("int").alias("number"), "event_id")
    return O.first_wins(e, ["user_id", "number"], ["event_id"])


@query("ranked_within_window", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quartile, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS priority_rank FROM orders")
def ranked_within_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    parted = O.quantile_groups(o, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], 4, "quartile")
    return O.dense_ranked(parted, ["o_orderstatus"], "o_orderpriority", "priority_rank").select("o_orderkey", "quartile", "priority_rank")
