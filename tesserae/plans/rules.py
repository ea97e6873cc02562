"""Queries over single rules: fixed tables, checks, matching, states and formats, each against the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..operators import cues as C
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import quality as Q
from ..operators import signal as S
from ..operators import structure
from ..operators import tasks as T
from ..operators import timeline as L
from ..session import table


def _pick(values, key):
    """The value at key modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


DEPTHS = ("none", "light", "shallow", "medium", "deep", "heavy", "loud", None)
FADES = ("instant", "snap", "sharp", "smooth", "slow", "fast", None)


@query("duck_and_fade", f"""SELECT event_id, CASE d WHEN 'none' THEN 0.0 WHEN 'light' THEN -8.0 WHEN 'shallow' THEN -8.0 WHEN 'deep' THEN -20.0 WHEN 'heavy' THEN -20.0 ELSE -14.0 END::DOUBLE AS depth_db,
  CAST(CASE f WHEN 'instant' THEN 30 WHEN 'snap' THEN 30 WHEN 'sharp' THEN 60 WHEN 'slow' THEN 400 ELSE 180 END AS INTEGER) AS fade_ms
  FROM (SELECT event_id, {_sql_list(DEPTHS)}[event_id % 8 + 1] AS d, {_sql_list(FADES)}[event_id % 7 + 1] AS f FROM events)""")
def duck_and_fade(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", L.duck_depth(_pick(DEPTHS, k)).alias("depth_db"), L.fade_ms(_pick(FADES, k)).alias("fade_ms"))


ORDINALS = ("Undici:", "dodicesimo", "VENTESIMO.", "trenta", "xxix", "XXXI", "ventitré", "007", "12,", ":5", "diciannove.,", "quinto", "none", "")


@query("ordinal_words", f"""SELECT l_orderkey, l_linenumber, CAST([11, 12, 20, 30, 29, NULL, 23, 7, 12, NULL, 19, 5, NULL, NULL][l_orderkey % 14 + 1] AS INTEGER) AS number, {_sql_list(ORDINALS)}[l_orderkey % 14 + 1] AS token FROM lineitem""")
def ordinal_words(spark, sf_dir):
    token = _pick(ORDINALS, F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.parse_ordinal(token).alias("number"), token.alias("token"))


ERRORS = ("HTTP 503", "Service Unavailable", "high demand, try later", "429 too many", "Read TIMEOUT", "network down", "RESOURCE_EXHAUSTED", "quota", "bad request", "503 and quota_exhausted")


@query("error_actions", f"""SELECT event_id, regexp_matches(m, '503|unavailable|high demand|429|timeout|network') AS transient,
  CASE WHEN regexp_matches(m, '429|resource_exhausted|quota_exhausted') THEN 'pause' WHEN regexp_matches(m, '503|unavailable|high demand|timeout|network') THEN 'retry' ELSE 'fail' END AS action
  FROM (SELECT event_id, lower({_sql_list(ERRORS)}[event_id % 10 + 1]) AS m FROM events)""")
def error_actions(spark, sf_dir):
    m = _pick(ERRORS, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", X.is_transient(m).alias("transient"), X.error_action(m).alias("action"))


@query("retry_jobs", "SELECT event_id, 'job-' || user_id || CASE WHEN event_id % 4 > 0 THEN '_r' || event_id % 4 ELSE '' END AS job FROM events")
def retry_jobs(spark, sf_dir):
    job = F.concat(F.lit("job-"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.retry_job_id(job, F.col("event_id") % 4).alias("job"))


EMOTIONS = ("Paura", "joy", "neutro", "curiosità", "RABBIA", "determinazione", "relax", "tristezza", "unknown", None)


@query("emotion_tables", f"""WITH e AS (SELECT doc_id, {_sql_list(EMOTIONS)}[doc_id % 10 + 1] AS e, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS stated FROM documents)
  SELECT doc_id, CASE WHEN lower(e) = 'paura' THEN 'Tone: Dark. Rhythm: Slow. Attitude: Hesitant.' WHEN lower(e) = 'joy' THEN 'Tone: Bright. Rhythm: Moderate. Attitude: Conversational.'
      WHEN lower(e) = 'curiosità' THEN 'Tone: Bright. Rhythm: Moderate. Attitude: Factual.' WHEN lower(e) = 'rabbia' THEN 'Tone: Dark. Rhythm: Fast. Attitude: Authoritative.'
      WHEN lower(e) = 'tristezza' THEN 'Tone: Melancholic. Rhythm: Slow. Attitude: Intimate.' ELSE 'Tone: Neutral. Rhythm: Moderate. Attitude: Factual.' END AS instruction,
    left(CASE WHEN stated <> '' THEN stated WHEN lower(e) = 'paura' THEN 'Hushed, tight chest voice.' WHEN lower(e) = 'curiosità' THEN 'Slightly rising intonation' WHEN lower(e) = 'rabbia' THEN 'Clipped, low voice. Hard consonants.'
      WHEN lower(e) = 'determinazione' THEN 'Chest voice, firm and forward.' WHEN lower(e) = 'tristezza' THEN 'Soft, low chest voice. Measured' ELSE 'Low, unhurried chest voice. Measured' END, 20) AS tone,
    left(CASE WHEN e = 'relax' THEN 'Calma, suoni ambientali' WHEN e = 'tristezza' THEN 'Musica malinconica, archi' ELSE 'Texture ambientale discreta' END, 20) AS music FROM e""")
def emotion_tables(spark, sf_dir):
    e, stated = _pick(EMOTIONS, F.col("doc_id")), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.voice_instruction(e).alias("instruction"), F.left(C.narrator_tone(stated, e), F.lit(20)).alias("tone"), F.left(C.music_prompt(e), F.lit(20)).alias("music")
    )


KINDS, MODELS = ("pad", "amb", "sfx", "sting", "leitmotif"), ("Qwen3-TTS-1.7b", "fish-s1-mini", "other", "my-QWEN3")


@query("model_routing", f"""SELECT event_id, CASE WHEN k IN ('amb', 'sfx', 'sting') THEN 'audiocraft-medium' ELSE 'acestep-1.5-xl-sft' END AS asset_model, CASE WHEN m LIKE '%qwen3%' THEN 'qwen3' WHEN m LIKE '%fish%' THEN 'fish' ELSE 'default' END AS backend
  FROM (SELECT event_id, {_sql_list(KINDS)}[event_id % 5 + 1] AS k, lower({_sql_list(MODELS)}[event_id % 4 + 1]) AS m FROM events)""")
def model_routing(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", C.asset_model(_pick(KINDS, k)).alias("asset_model"), C.voice_backend(_pick(MODELS, k), ["qwen3", "fish"], "default").alias("backend"))


@query("reading_instructions", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'Read with a ' || lower(o_orderpriority) || ' tone. Maintain a ' || lower(o_orderstatus) || ' pacing throughout. The delivery should be calm.'
  WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'plain' END AS instruction FROM orders""")
def reading_instructions(spark, sf_dir):
    k = F.col("o_orderkey")
    stated = F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("")
    got = C.reading_instruction(F.when(k % 3 != 0, F.col("o_orderpriority")), F.col("o_orderstatus"), F.when(k % 5 != 0, F.lit("Calm")), stated, F.lit("plain"))
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("instruction"))


@query("required_fields", """SELECT conv_id, turn, (role <> 'user' AND turn % 4 <> 0) AS complete FROM conversations""")
def required_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("block_id", F.when(F.col("turn") % 4 != 0, F.col("turn").cast("string"))).withColumn("body", F.when(F.col("role") == "user", "").otherwise("x"))
    return c.select("conv_id", "turn", Q.filled("block_id", "body").alias("complete"))


PAYLOAD_SQL = """SELECT event_id, '{"x":1' || CASE WHEN event_id % 2 = 0 THEN ',"entities":[1,2]' ELSE '' END || CASE WHEN event_id % 3 > 0 THEN ',"relations":[]' ELSE '' END
  || CASE event_id % 4 WHEN 0 THEN ',"block_id":"b"' WHEN 1 THEN ',"chunk_label":null' ELSE '' END || CASE WHEN event_id % 5 > 1 THEN ',"book_id":7' ELSE '' END || '}' AS p FROM events"""


@query("input_checks", f"""WITH p AS ({PAYLOAD_SQL}), k AS (SELECT event_id, p, json_keys(p) AS k FROM p)
  SELECT event_id, array_to_string(list_filter([CASE WHEN NOT list_contains(k, 'entities') THEN 'entities' END, CASE WHEN NOT list_contains(k, 'relations') THEN 'relations' END,
    CASE WHEN NOT (list_contains(k, 'block_id') OR list_contains(k, 'chunk_label')) THEN 'block_id' END, CASE WHEN NOT (list_contains(k, 'project_id') OR list_contains(k, 'book_id')) THEN 'project_id' END], lambda x: x IS NOT NULL), ',') AS missing,
    CAST(coalesce(json_array_length(p, '$.entities'), 0) AS INTEGER) AS entities_count, CAST(coalesce(json_array_length(p, '$.concepts'), 0) AS INTEGER) AS concepts_count FROM k""")
def input_checks(spark, sf_dir):
    k = F.col("event_id")
    part = lambda test, text: F.when(test, text).otherwise("")
    payload = F.concat(
        F.lit('{"x":1'), part(k % 2 == 0, ',"entities":[1,2]'), part(k % 3 > 0, ',"relations":[]'), F.when(k % 4 == 0, ',"block_id":"b"').when(k % 4 == 1, ',"chunk_label":null').otherwise(""), part(k % 5 > 1, ',"book_id":7'), F.lit("}")
    )
    e = table(spark, sf_dir, "events").select("event_id", payload.alias("p"))
    return e.select("event_id", F.array_join(Q.violations(Q.input_checks(F.col("p"))), ",").alias("missing"), *Q.member_counts(F.col("p"), "entities", "concepts"))


@query("timed_units", "SELECT event_id, value FROM events WHERE event_type <> 'error' AND value < 300")
def timed_units(spark, sf_dir):
    """Units without an id or a duration are left out."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_id")).alias("scene_id"), F.when(F.col("value") < 300, F.col("value")).alias("value"))
    return e.where(F.col("scene_id").isNotNull() & F.col("value").isNotNull()).select("event_id", "value")


@query("empty_analyses", "SELECT conv_id, count(*) FILTER (role = 'user') + count(*) FILTER (turn > 5) + count(*) FILTER (length(text) > 400) > 0 AS usable FROM conversations GROUP BY conv_id")
def empty_analyses(spark, sf_dir):
    lists = [F.collect_list(F.when(t, F.col("turn"))).alias(n) for n, t in (("e", F.col("role") == "user"), ("r", F.col("turn") > 5), ("c", F.length("text") > 400))]
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*lists).select("conv_id", Q.any_filled("e", "r", "c").alias("usable"))


@query("context_structs", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.5e0 END AS arousal, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'neutro' END AS primary_emotion, '' AS setting FROM orders""")
def context_structs(spark, sf_dir):
    """The part of an analysis that later stages are given, with its defaults."""
    k = F.col("o_orderkey")
    analysis = F.struct(F.when(k % 2 == 0, F.col("o_totalprice")).alias("arousal"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("emotion"), F.lit(None).cast("string").alias("setting"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", analysis.alias("a"))
    context = F.struct(F.coalesce("a.arousal", F.lit(0.5)).alias("arousal"), F.coalesce("a.emotion", F.lit("neutro")).alias("primary_emotion"), F.coalesce("a.setting", F.lit("")).alias("setting"))
    return o.select("o_orderkey", context.alias("c")).select("o_orderkey", "c.*")


@query("grid_with_gaps", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text) / 10e0 ELSE 0 END AS seconds FROM conversations""")
def grid_with_gaps(spark, sf_dir):
    """Units and their required timing grid: each conversation is in it, every other unit is not."""
    c = table(spark, sf_dir, "conversations")
    grid = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.length("text") / 10.0).otherwise(0.0).alias("seconds")).where("turn % 2 = 0 OR turn = -1")
    grid = grid.unionByName(c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("int").alias("turn"), F.lit(0.0).alias("seconds")))
    return J.required_grid(c.select("conv_id", "turn"), grid, "conv_id", "turn", {"seconds": 0.0})


@query("last_name_wins", """SELECT user_id, event_id, coalesce(n, CAST(user_id AS VARCHAR)) AS name FROM events LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON user_id = o_custkey""")
def last_name_wins(spark, sf_dir):
    """Of repeated entity ids the last one in order names the id."""
    names = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return J.name_or_id(table(spark, sf_dir, "events"), "user_id", names, "o_custkey", "o_orderpriority", "name", "o_orderkey").select("user_id", "event_id", "name")


@query("first_candidate_paths", """WITH c AS (SELECT conv_id AS k, r, conv_id || '/' || r AS path FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([1, 2, 3]) AS r)), e AS (SELECT DISTINCT conv_id || '/' || turn AS path FROM conversations WHERE length(text) > 250)
  SELECT d.conv_id, m.path AS found FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN (SELECT k, arg_min(c.path, r) AS path FROM c JOIN e USING (path) GROUP BY k) m ON d.conv_id = m.k""")
def first_candidate_paths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ids = c.select("conv_id").distinct()
    at = lambda r: F.concat(F.col("conv_id").cast("string"), F.lit("/"), r.cast("string")).alias("path")
    candidates = ids.select("conv_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).select("conv_id", "rank", at(F.col("rank")))
    return J.first_candidate(ids, candidates, c.where(F.length("text") > 250).select(at(F.col("turn"))), "conv_id", "rank", "path")


@query("units_with_files", """WITH u AS (SELECT conv_id, turn, conv_id || '_' || turn AS unit FROM conversations), f AS (SELECT '/out/run-' || conv_id % 3 || '-' || conv_id || '_' || turn || '.wav' AS path, conv_id || '_' || turn AS unit FROM conversations WHERE turn % 3 <> 1
    UNION ALL SELECT '/old/' || conv_id || '_' || turn || '.v2.wav', conv_id || '_' || turn || '.v2' FROM conversations WHERE turn % 3 = 1 UNION ALL SELECT '/a/' || conv_id || '_' || turn || '.json', conv_id || '_' || turn FROM conversations WHERE turn % 5 = 0)
  SELECT conv_id, turn, (SELECT min(path) FROM f WHERE f.unit = u.unit) AS file, CASE WHEN (SELECT min(path) FROM f WHERE f.unit = u.unit) IS NULL THEN 'missing' ELSE 'ok' END AS flag FROM u""")
def units_with_files(spark, sf_dir):
    """Units and the files that are named after them, by the end of the name's stem; units without one are flagged."""
    c = table(spark, sf_dir, "conversations")
    unit, s = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")), F.lit
    files = c.where("turn % 3 <> 1").select(F.concat(s("/out/run-"), (F.col("conv_id") % 3).cast("string"), s("-"), unit, s(".wav")).alias("path"))
    files = files.unionByName(c.where("turn % 3 = 1").select(F.concat(s("/old/"), unit, s(".v2.wav")).alias("path"))).unionByName(c.where("turn % 5 = 0").select(F.concat(s("/a/"), unit, s(".json")).alias("path")))
    got = J.attach_by_file(c.select("conv_id", "turn", unit.alias("unit")), "unit", files, "path")
    return got.select("conv_id", "turn", "file", F.when(F.col("file").isNull(), "missing").otherwise("ok").alias("flag"))


TITLED_SQL = "SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '  CAPITOLO ' || turn || ' - ' || role || chr(10) ELSE '' END || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query("titled_sections", f"""WITH d AS ({TITLED_SQL}), p AS (SELECT conv_id, s AS section, ['Prologo: start', 'Capitolo 0: zero', 'Capitolo 2: two', 'Chapter 4', 'Capitolo 4: four (end)'][s] AS name FROM d, (SELECT unnest([1, 2, 3, 4, 5]) AS s))
  SELECT conv_id, section, name, CAST(CASE WHEN regexp_matches(lower(name), '^(capitolo|chapter|parte) ') AND regexp_matches(text, '(?i)(?:^|\\n)[ \\t]*' || regexp_escape(split_part(name, ': ', 1)))
    THEN length(regexp_extract(text, '(?is)^(.*?)(^|\\n)[ \\t]*' || regexp_escape(split_part(name, ': ', 1)), 1)) + length(regexp_extract(text, '(?is)^(.*?)(^|\\n)[ \\t]*' || regexp_escape(split_part(name, ': ', 1)), 2)) ELSE 0 END AS INTEGER) AS pos FROM d JOIN p USING (conv_id)""")
def titled_sections(spark, sf_dir):
    """A profile's titles looked for at the starts of lines."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  CAPITOLO "), F.col("turn").cast("string"), F.lit(" - "), "role", F.lit("\n"))).otherwise("")
    texts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(head, "text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    names = F.array(*map(F.lit, ("Prologo: start", "Capitolo 0: zero", "Capitolo 2: two", "Chapter 4", "Capitolo 4: four (end)")))
    profile = texts.select("conv_id", F.posexplode(names).alias("i", "name")).select("conv_id", (F.col("i") + 1).alias("section"), "name")
    return structure.locate_titles(texts, profile, "conv_id")


PROFILE = ("Prologo", "1", "2", " 7 ", "Coda 3: last", "Interlude")


@query("profile_sections", f"""WITH d AS (SELECT conv_id, turn * 100 AS pos, CASE WHEN conv_id % 3 = 0 THEN turn WHEN conv_id % 3 = 1 THEN turn + 50 ELSE CASE WHEN turn = 1 THEN 903 ELSE turn * 7 END END AS number FROM conversations),
  p AS (SELECT conv_id, s AS section, {_sql_list(PROFILE)}[s] AS name, CAST([0, 1, 2, 7, 903, NULL][s] AS INTEGER) AS number FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS s)),
  m AS (SELECT conv_id, section, name, pos FROM d JOIN p USING (conv_id, number)), g AS (SELECT conv_id FROM m GROUP BY conv_id HAVING count(*) >= 3),
  z AS (SELECT d.conv_id, pos, row_number() OVER (PARTITION BY d.conv_id ORDER BY pos, number) AS i FROM d)
  SELECT conv_id, pos, section, name FROM m WHERE conv_id IN (SELECT conv_id FROM g) UNION ALL SELECT z.conv_id, pos, section, name FROM z JOIN p ON p.conv_id = z.conv_id AND p.section = z.i WHERE z.conv_id NOT IN (SELECT conv_id FROM g)""")
def profile_sections(spark, sf_dir):
    """Detected heading numbers under a profile's names: by number where half the profile is met, else by position."""
    c, t, k = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("conv_id") % 3
    number = F.when(k == 0, t).when(k == 1, t + 50).when(t == 1, 903).otherwise(t * 7)
    detected = c.select("conv_id", (t * 100).alias("pos"), number.alias("number"))
    profile = c.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(*map(F.lit, PROFILE))).alias("i", "name")).select("conv_id", (F.col("i") + 1).alias("section"), "name")
    return structure.match_profile(detected, profile, "conv_id")


HEADINGS = ("Capitolo Primo: {}", "x Capitolo Due\n{}", "Libro Terzo.  \n\n\n\n{}", "Capitolo Sette. {}", "plain {}  ", "Libro Primo: {}\n\n\nend", "")


@query("heading_pauses", f"""WITH t AS (SELECT c_custkey, replace({_sql_list(HEADINGS)}[c_custkey % 7 + 1], '{{}}', c_mktsegment) AS t FROM customer),
  a AS (SELECT c_custkey, regexp_replace(regexp_replace(t, '\\b(Capitolo\\s+[A-Za-zÀ-ÿ]+)\\b\\.?', '\\1.', 'g'), '\\b(Capitolo\\s+[A-Za-zÀ-ÿ]+\\.)\\s*', '\\1' || chr(10) || chr(10), 'g') AS t FROM t),
  b AS (SELECT c_custkey, regexp_replace(regexp_replace(t, '\\b(Libro\\s+[A-Za-zÀ-ÿ]+)\\b\\.?', '\\1.', 'g'), '\\b(Libro\\s+[A-Za-zÀ-ÿ]+\\.)\\s*', '\\1' || chr(10) || chr(10), 'g') AS t FROM a)
  SELECT c_custkey, trim(regexp_replace(replace(replace(t, 'Capitolo Primo:', 'Capitolo Primo.'), 'Libro Primo:', 'Libro Primo.'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS fixed FROM b""")
def heading_pauses(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.heading_pauses(F.replace(_pick(HEADINGS, F.col("c_custkey")), F.lit("{}"), F.col("c_mktsegment"))).alias("fixed"))


@query("spoken_units", """WITH p AS (SELECT conv_id, turn, unnest(['Capitolo ' || turn, 'He said', role || ' hello there', 'and thought', 'it is late', 'then left']) AS t, unnest(['title', 'narration', 'dialogue', 'narration', 'thought', 'narration']) AS kind, unnest([0, 1, 2, 3, 4, 5]) AS piece FROM conversations)
  SELECT conv_id, turn, piece, 0 AS part, kind, t AS unit_text, CAST(len(string_split(t, ' ')) AS INTEGER) AS words, CASE kind WHEN 'title' THEN 2000 ELSE 200 END AS pause_ms FROM p
  UNION ALL SELECT conv_id, turn, 6, part, 'dialogue', array_to_string(list_transform(range(part * 60, least(part * 60 + 60, 130)), lambda i: 'w' || i), ' '), CAST(least(60, 130 - part * 60) AS INTEGER), 200 FROM conversations, (SELECT unnest([0, 1, 2]) AS part)""")
def spoken_units(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    long = " ".join(f"w{i}" for i in range(130))
    text = F.concat(F.lit("Capitolo "), F.col("turn").cast("string"), F.lit("\nHe said \""), "role", F.lit(f" hello there\" and thought 'it is late' then left \"{long}\"."))
    return C.spoken_units(c.select("conv_id", "turn", text.alias("text")), "text").drop("text")


@query("json_lists", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE 1 END::INTEGER AS n, CASE WHEN event_id % 5 IN (0, 1, 4) THEN event_id END AS first_a FROM events""")
def json_lists(spark, sf_dir):
    """Lists of records salvaged from a model's answer: a list, a single object, none, an empty list, a fenced one."""
    k, s = F.col("event_id").cast("string"), F.lit
    record = F.concat(s('{"a": '), k, s("}"))
    answers = F.array(F.concat(s("Here: ["), record, s(", "), record, s("] done")), F.concat(s("one "), record, s(" only")), s("nothing"), s("[]"), F.concat(s("```json\n["), record, s("]\n```")))
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(answers, (F.col("event_id") % 5 + 1).cast("int")).alias("p"))
    got = Q.salvage_json_list(e, "p", "a BIGINT")
    return got.select("event_id", F.when(~F.col("broken"), F.size("parsed")).alias("n"), F.try_element_at("parsed", F.lit(1))["a"].alias("first_a"))


@query("fenced_blocks", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": ' || event_id || '}' WHEN 1 THEN 'plain ' || event_type ELSE event_type END AS inner_text FROM events""")
def fenced_blocks(spark, sf_dir):
    k, t, s = F.col("event_id").cast("string"), F.col("event_type"), F.lit
    answers = F.array(F.concat(s('say\n```json\n{"k": '), k, s("}\n```\nend ```x```")), F.concat(s("  plain "), t, s(" ")), F.concat(s("```"), t, s("```")))
    return table(spark, sf_dir, "events").select("event_id", Q.between_fences(F.element_at(answers, (F.col("event_id") % 3 + 1).cast("int"))).alias("inner_text"))


@query("asset_listing", """SELECT p_brand, string_agg('- ' || p_partkey || ': [''' || p_type || ''', ''' || p_size || '''] - ' || p_name, chr(10) ORDER BY p_partkey) AS listing FROM part GROUP BY 1""")
def asset_listing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array("p_type", F.col("p_size").cast("string")).alias("tags"), "p_name")
    return C.asset_listing(p, "p_brand", "p_partkey", "tags", "p_name")


@query("prompt_templates", """WITH t AS (SELECT p_brand AS name, p_partkey AS version, p_name AS template FROM part), c AS (SELECT p_brand AS name, min(p_partkey) AS version FROM part WHERE p_size > 25 AND p_brand < 'Brand#3' GROUP BY 1)
  SELECT t.* FROM t JOIN (SELECT t.name, coalesce(any_value(c.version), max(t.version)) AS version FROM t LEFT JOIN c USING (name) GROUP BY t.name) w ON t.name = w.name AND t.version = w.version""")
def prompt_templates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    templates = p.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"), F.col("p_name").alias("template"))
    chosen = p.where("p_size > 25 AND p_brand < 'Brand#3'").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("version"))
    return C.choose_templates(templates, chosen)


@query("format_templates", """SELECT c_custkey, '{"name": "' || c_name || '", "seg": {' || c_mktsegment || '}}' AS prompt FROM customer""")
def format_templates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.format_template(F.lit('{{"name": "{name}", "seg": {{{seg}}}}}'), {"name": F.col("c_name"), "seg": F.col("c_mktsegment")}).alias("prompt"))


@query("stage_checkpoints", "SELECT user_id, arg_max(event_type, event_id) AS stage, max(event_id) AS at FROM events GROUP BY 1")
def stage_checkpoints(spark, sf_dir):
    return T.last_checkpoint(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("stage"), "event_id"), "user_id", "stage", "event_id")


@query("stage_barrier", """WITH t AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS completed, count(*) FILTER (value > 300) AS queued FROM events GROUP BY 1)
  SELECT *, NOT (completed >= total AND queued = 0) AS open FROM t""")
def stage_barrier(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    totals = e.groupBy("user_id").agg(F.count_if(F.col("event_id") % 2 == 0).alias("total"))
    return T.stage_barrier(totals, e.where("event_type IN ('click', 'view')"), e.where("value > 300"), ["user_id"])


ACTIONS = ("start", "suspend", "resume", "stop", "noise", "suspend")


@query("control_states", f"""WITH a AS (SELECT user_id, event_id, {_sql_list(ACTIONS)}[event_id % 6 + 1] AS a FROM events), k AS (SELECT * FROM a WHERE a <> 'noise')
  SELECT k.user_id, any_value(s.s) AS status, CASE WHEN arg_max(a, event_id) IN ('start', 'resume') THEN 'green' ELSE 'red' END AS semaphore
  FROM k LEFT JOIN (SELECT user_id, CASE WHEN arg_max(a, event_id) = 'stop' THEN 'stopped' ELSE 'running' END AS s FROM k WHERE a <> 'suspend' GROUP BY 1) s ON k.user_id = s.user_id GROUP BY 1""")
def control_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _pick(ACTIONS, F.col("event_id")).alias("action"))
    return T.control_states(e, "user_id", "action", "event_id")


@query("manual_gate", "SELECT event_id FROM events WHERE event_type = 'click'")
def manual_gate(spark, sf_dir):
    """What is pushed on with the gate open and, none, with the gate shut."""
    ready = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id")
    return T.gated(ready, True).unionByName(T.gated(ready))


@query("zombies_rewritten", """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(epoch_us(ts)) AS us FROM events GROUP BY 1), n AS (SELECT max(us) AS now_us FROM l)
  SELECT user_id, CASE WHEN t IN ('click', 'view') THEN CASE WHEN us < now_us - 1800000000 THEN 'TIMEOUT' ELSE 'IN_FLIGHT' END ELSE 'PENDING' END AS status, CASE WHEN t IN ('click', 'view') AND us < now_us - 1800000000 THEN now_us ELSE us END AS updated_us FROM l, n""")
def zombies_rewritten(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.when(F.max_by("event_type", "event_id").isin("click", "view"), "IN_FLIGHT").otherwise("PENDING").alias("status"), F.max("at").alias("updated_at"))
    now = F.lit(e.agg(F.max("at")).first()[0])
    return T.expired(last, now).select("user_id", "status", F.unix_micros("updated_at").alias("updated_us"))


@query("output_names", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN s WHEN o_orderkey % 4 = 1 THEN s || '-' || o_orderkey ELSE s || '-b' || o_orderkey END || CASE WHEN o_orderkey % 3 = 0 THEN '-scene-' || o_orderkey % 9 ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '-extra' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '-20260101' ELSE '' END || '.json' AS name
  FROM (SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM orders)""")
def output_names(spark, sf_dir):
    k = F.col("o_orderkey")
    block = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(X.normalize_id(F.col("o_orderpriority")), F.lit("-"), k.cast("string"))).otherwise(F.concat(F.lit("b"), k.cast("string")))
    scene, custom, stamp = F.when(k % 3 == 0, F.concat(F.lit("scene-"), (k % 9).cast("string"))), F.when(k % 5 == 0, "extra").otherwise(""), F.when(k % 2 == 0, "20260101")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.output_name(F.col("o_orderpriority"), block, scene, custom, stamp).alias("name"))


@query("upload_pages", """SELECT conv_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY turn) FILTER (turn % 2 = 0 AND trim(text) <> '') AS text, CASE WHEN count(*) FILTER (turn % 2 = 0 AND trim(text) <> '') > 0 THEN 'upload_complete' ELSE 'error' END AS status FROM conversations GROUP BY 1""")
def upload_pages(spark, sf_dir):
    """Pages of an upload joined by form feeds, with its status."""
    page = F.when((F.col("turn") % 2 == 0) & (F.trim("text") != ""), F.struct("turn", "text"))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("p"))
    return got.select("conv_id", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["text"]), "\n\f\n")).alias("text"), F.when(F.size("p") > 0, "upload_complete").otherwise("error").alias("status"))


@query("pause_statistics", """WITH g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 - value AS gap FROM events)
  SELECT user_id, count(*) AS pauses, round(avg(gap), 3) AS mean, round(max(gap), 3) AS longest FROM g WHERE gap > 0.05 GROUP BY 1""")
def pause_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("end", F.col("start") + F.col("value"))
    got = S.pause_stats(e, ["user_id"], ["ts", "event_id"], "start", "end")
    return got.select("user_id", "pauses", F.round("mean", 3).alias("mean"), F.round("longest", 3).alias("longest"))


@query("flag_severities", """SELECT flag, count(*) AS n, flag IN ('LATE', 'HUGE') AS critical FROM (SELECT unnest([CASE WHEN l_tax > 0.05 THEN 'LATE' END, CASE WHEN l_quantity > 45 THEN 'HUGE' END, CASE WHEN l_discount = 0 THEN 'FULL' END]) AS flag FROM lineitem) WHERE flag IS NOT NULL GROUP BY 1""")
def flag_severities(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    flags = Q.flags({"LATE": F.col("l_tax") > 0.05, "HUGE": F.col("l_quantity") > 45, "FULL": F.col("l_discount") == 0})
    return Q.severities(l.select(flags.alias("flags")), "flags", ["LATE", "HUGE"])


@query("text_forms", """SELECT c_custkey, lower(regexp_replace(trim(c_name || '  #  ' || c_mktsegment), '\\s+', ' ', 'g')) AS collapsed, 'L''Amico Di ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS titled, 'it' || chr(39) || chr(92) || chr(39) || chr(39) || 's ' || c_custkey AS quoted, '"' || c_name || '", "' || c_mktsegment || '"' AS cues FROM customer""")
def text_forms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.collapse(F.concat("c_name", F.lit("  #  "), "c_mktsegment")).alias("collapsed"),
        X.title_case(F.concat(F.lit("l'AMICO di "), "c_mktsegment")).alias("titled"),
        X.shell_quote_path(F.concat(F.lit("it's "), F.col("c_custkey").cast("string"))).alias("quoted"),
        X.quoted_list(F.array("c_name", "c_mktsegment")).alias("cues"),
    )


@query("array_forms", """SELECT vec_id, round(list_sum(list_transform(range(1, 21), lambda i: coalesce(embedding[i]::DOUBLE, 0))), 4) AS cut_sum, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE + embedding[len(embedding) + 1 - i]::DOUBLE) / 2 * i)), 4) AS mono_sum, 200 AS padded FROM embeddings""")
def array_forms(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4)
    mono = S.mono(e, F.reverse(e))
    return table(spark, sf_dir, "embeddings").select("vec_id", total(S.fit_length(e, 20)).alias("cut_sum"), total(F.transform(mono, lambda v, i: v * (i + 1))).alias("mono_sum"), F.size(S.fit_length(e, 200)).alias("padded"))


@query("layer_mixes", """WITH s AS (SELECT label AS g, vec_id % 40 AS sample_idx, ['voice', 'music', 'ambient', 'spot', 'accent'][vec_id % 5 + 1] AS layer, embedding[1]::DOUBLE AS v FROM embeddings), m AS (SELECT unnest(['voice', 'music', 'music_fx', 'full']) AS mode)
  SELECT mode, g, sample_idx, round(sum(v), 4) AS value FROM s, m WHERE mode = 'full' OR layer = mode OR mode = 'music_fx' AND layer <> 'voice' GROUP BY ALL""")
def layer_mixes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = e.select(F.col("label").alias("g"), (F.col("vec_id") % 40).alias("sample_idx"), _pick(("voice", "music", "ambient", "spot", "accent"), F.col("vec_id")).alias("layer"), F.col("embedding")[0].cast("double").alias("value"))
    out = None
    for mode in ("voice", "music", "music_fx", "full"):
        one = S.mix(s, "g", mode).select(F.lit(mode).alias("mode"), "g", "sample_idx", F.round("value", 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("with_silence", "SELECT event_id, 0 AS part, event_type AS item FROM events UNION ALL SELECT event_id, 1, 'silence ' || event_id % 3 * 250 FROM events WHERE event_id % 3 > 0")
def with_silence(spark, sf_dir):
    """Each clip followed by its silence, if it has any."""
    ms = F.col("event_id") % 3 * 250
    parts = F.array_compact(F.array(F.col("event_type"), F.when(ms > 0, F.concat(F.lit("silence "), ms.cast("string")))))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(parts).alias("part", "item"))


@query("ordered_reports", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS by_start, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN '' ELSE event_type END, event_id) AS by_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS by_task FROM events""")
def ordered_reports(spark, sf_dir):
    """Positions by start time, by type (a missing one first) and id, and by task id."""
    kind = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit(""))
    at = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", "event_id", at("ts", "event_id").alias("by_start"), at(kind, "event_id").alias("by_type"), at("event_id").alias("by_task"))


@query("role_sets", """SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT role), ['assistant', 'narrator']))), ',') AS roles, len(list(role)) + 2 AS concatenated FROM conversations GROUP BY 1""")
def role_sets(spark, sf_dir):
    """Set union of roles, and plain concatenation of two lists."""
    more = F.array(F.lit("assistant"), F.lit("narrator"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("s"), F.collect_list("role").alias("l"))
    return g.select("conv_id", F.array_join(F.sort_array(F.array_union("s", more)), ",").alias("roles"), F.size(F.concat("l", more)).cast("bigint").alias("concatenated"))


@query("voice_progress", """SELECT source, count(l.doc_id) AS done, count(*) AS total, round(100e0 * count(l.doc_id) / count(*), 1) AS percent, count(l.doc_id) = count(*) AS finished FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def voice_progress(spark, sf_dir):
    """Units with a voice against all units."""
    done = F.count("has")
    got = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left").groupBy("source")
    return got.agg(done.alias("done"), F.count(F.lit(1)).alias("total"), F.round(100.0 * done / F.count(F.lit(1)), 1).alias("percent"), (done == F.count(F.lit(1))).alias("finished"))


@query("first_text_files", "SELECT source, min(doc_id) AS doc_id, arg_min(md5(text), doc_id) AS content FROM documents WHERE lang = 'en' GROUP BY 1")
def first_text_files(spark, sf_dir):
    """The first matching file of each folder, by path."""
    return O.first_wins(table(spark, sf_dir, "documents").where("lang = 'en'").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("content")), ["source"], ["doc_id"])
