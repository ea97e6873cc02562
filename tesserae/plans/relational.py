"""Queries over the relational tables: joins, aggregations, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import quality as Q
from ..session import table

LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


@query(
    "unit_timing_left_join",
    """SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(CASE WHEN n IS NULL THEN 5e0 ELSE qty END, 5e0) AS voice, CASE WHEN n IS NULL THEN 0.5e0 ELSE 0e0 END AS pause
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def unit_timing_left_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("voice"), F.lit(0.0).alias("pause"))
    got = J.left_with_defaults(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", {"n": 0, "voice": 5.0, "pause": 0.5})
    return got.select("o_orderkey", "n", "voice", "pause")


@query(
    "context_broadcast",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def context_broadcast(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query(
    "parent_from_key",
    """WITH k AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages)
       SELECT page_id, p[1] || '/' || p[2] AS parent, count(*) OVER (PARTITION BY p[1] || '/' || p[2]) AS siblings FROM k""",
)
def parent_from_key(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", X.parent_key(F.regexp_replace("url", "^[a-z]+://", ""), 2, "/").alias("parent"))
    parents = pages.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings"))
    return pages.join(parents, "parent").select("page_id", "parent", "siblings")


@query(
    "relation_names",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS source, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS target
       FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""",
)
def relation_names(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    got = J.name_or_id(J.name_or_id(l, "l_suppkey", s, "s_suppkey", "s_name", "source"), "l_partkey", p, "p_partkey", "p_name", "target")
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "source", "target")


@query(
    "resolve_with_fallbacks",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN nullif(c_name, '') END, CASE WHEN n_regionkey = 1 THEN nullif(n_name, '') END, nullif(c_mktsegment, ''), 'narrator') AS voice
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def resolve_with_fallbacks(spark, sf_dir):
    got = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    chain = [F.when(F.col("c_acctbal") > 5000, F.col("c_name")), F.when(F.col("n_regionkey") == 1, F.col("n_name")), F.col("c_mktsegment")]
    return got.select("c_custkey", F.coalesce(X.first_truthy(*chain), F.lit("narrator")).alias("voice"))


@query(
    "asset_prompt_join",
    """SELECT p_partkey, p_name, coalesce(uses, 0) AS uses, coalesce(p_type, '') AS kind FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
)
def asset_prompt_join(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    got = J.left_with_defaults(table(spark, sf_dir, "part"), uses, "p_partkey", "l_partkey", {"uses": 0})
    return got.select("p_partkey", "p_name", "uses", F.coalesce("p_type", F.lit("")).alias("kind"))


@query(
    "preserve_assignments",
    "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, '') AS assigned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def preserve_assignments(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("assigned"))
    return J.left_with_defaults(table(spark, sf_dir, "documents").select("doc_id"), old, "doc_id", "k", {"assigned": ""}).select("doc_id", "assigned")


@query(
    "registry_union_legacy",
    """SELECT c_name AS name, 'registry' AS origin FROM customer UNION ALL
       SELECT s_name, 'legacy' FROM supplier WHERE replace(s_name, 'Supplier', 'Customer') NOT IN (SELECT c_name FROM customer WHERE c_acctbal > 0)""",
)
def registry_union_legacy(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    legacy = table(spark, sf_dir, "supplier").withColumn("k", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))
    extra = legacy.join(c.where("c_acctbal > 0").select(F.col("c_name").alias("k")), "k", "left_anti")
    return c.select(F.col("c_name").alias("name"), F.lit("registry").alias("origin")).unionByName(extra.select(F.col("s_name").alias("name"), F.lit("legacy").alias("origin")))


@query(
    "contains_match",
    """SELECT doc_id, min(item_id) AS item_id FROM documents, benchmark WHERE strpos(documents.text, benchmark.text) > 0 GROUP BY doc_id""",
)
def contains_match(spark, sf_dir):
    found = J.first_contained(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "item_id")


@query(
    "asof_section",
    """SELECT e.event_id, s.event_id AS asof_section_id FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup') s
       ON e.user_id = s.user_id AND e.ts >= s.ts""",
)
def asof_section(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    sections = e.where("event_type = 'signup'").withColumnRenamed("event_id", "section_id")
    return O.asof_last(e, sections, ["user_id"], "ts", "ts", ["section_id"], "event_id").select("event_id", "asof_section_id")


@query(
    "interval_cover",
    """SELECT o_orderkey, count(event_id) AS covered, sum(CASE WHEN event_id IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM orders o LEFT JOIN events e
       ON e.user_id = o.o_custkey AND e.event_id >= o.o_orderkey AND e.event_id < o.o_orderkey + 500 GROUP BY 1""",
)
def interval_cover(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    got = o.join(e, (F.col("user_id") == F.col("o_custkey")) & (F.col("event_id") >= F.col("o_orderkey")) & (F.col("event_id") < F.col("o_orderkey") + 500), "left")
    return got.groupBy("o_orderkey").agg(F.count("event_id").alias("covered"), F.sum(F.when(F.col("event_id").isNotNull(), 1).otherwise(0)).alias("hits"))


@query(
    "range_join_buckets",
    """SELECT s.s_suppkey, count(c.c_custkey) AS near FROM supplier s LEFT JOIN customer c ON c.c_acctbal >= s.s_acctbal - 50 AND c.c_acctbal <= s.s_acctbal + 50 GROUP BY 1""",
)
def range_join_buckets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    c = table(spark, sf_dir, "customer").where("c_custkey is not null").select("c_acctbal")
    return J.range_counts(s, ["s_suppkey"], c, "low", "high", "c_acctbal", "near")


@query("path_exists_semi", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def path_exists_semi(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query(
    "positional_zip",
    """SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS i FROM nation) USING (i)""",
)
def positional_zip(spark, sf_dir):
    return J.positional_zip(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"], table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).alias("k"), "n_name"), ["k"]).select("r_name", "n_name")


@query("pending_work", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "cache_misses",
    """SELECT doc_id, md5('model:' || text) AS key FROM documents WHERE md5('model:' || text) NOT IN (SELECT md5('model:' || text) FROM documents JOIN labels USING (doc_id))""",
)
def cache_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.cache_key(F.lit("model"), F.col("text")).alias("key"))
    kept = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return d.join(kept, "key", "left_anti").select("doc_id", "key")


@query(
    "latest_per_key",
    "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id",
)
def latest_per_key(spark, sf_dir):
    return O.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("first_wins_dedup", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_dedup(spark, sf_dir):
    return O.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query(
    "fallback_key_dedup",
    """SELECT coalesce(CASE WHEN value > 50 THEN event_type END, 'user-' || user_id) AS key, min(event_id) AS event_id FROM events GROUP BY 1""",
)
def fallback_key_dedup(spark, sf_dir):
    key = F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return O.first_wins(table(spark, sf_dir, "events").select(key.alias("key"), "event_id"), ["key"], ["event_id"])


@query(
    "union_first_wins",
    """SELECT custkey, arg_min(origin, rank) AS origin FROM (SELECT o_custkey AS custkey, 'order' AS origin, 1 AS rank FROM orders UNION ALL SELECT c_custkey, 'customer', 2 FROM customer) GROUP BY 1""",
)
def union_first_wins(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.lit("order").alias("origin"), F.lit(1).alias("rank"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.lit("customer").alias("origin"), F.lit(2).alias("rank"))
    return O.first_wins(a.unionByName(b), ["custkey"], ["rank"]).select("custkey", "origin")


@query(
    "top_k_per_group",
    """SELECT p_brand, p_partkey, p_retailprice, rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank_in_group FROM part) WHERE rank_in_group <= 10""",
)
def top_k_per_group(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 10)


@query("page_of_50", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_of_50(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50)


@query("conditional_type_counts", """SELECT count(*) FILTER (event_type = 'view') AS beds, count(*) FILTER (event_type = 'click') AS ambients,
       count(*) FILTER (event_type = 'error') AS spots, count(*) FILTER (event_type = 'purchase') AS accents FROM events""")
def conditional_type_counts(spark, sf_dir):
    kinds = {"beds": "view", "ambients": "click", "spots": "error", "accents": "purchase"}
    return table(spark, sf_dir, "events").agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()])


@query(
    "dominant_value",
    """SELECT user_id, event_type AS dominant, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""",
)
def dominant_value(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("dominant"), (-F.col("b.m")).alias("n"))


@query(
    "section_averages",
    """SELECT o_orderstatus, round(avg(l_quantity), 3) AS avg_quantity, round(avg(l_discount), 4) AS avg_discount, round(avg(l_tax), 4) AS avg_tax, count(DISTINCT l_returnflag) AS flags
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def section_averages(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return got.groupBy("o_orderstatus").agg(
        F.round(F.avg("l_quantity"), 3).alias("avg_quantity"),
        F.round(F.avg("l_discount"), 4).alias("avg_discount"),
        F.round(F.avg("l_tax"), 4).alias("avg_tax"),
        F.size(F.collect_set("l_returnflag")).cast("bigint").alias("flags"),
    )


@query(
    "progress_by_stage",
    """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS percent,
       CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'pending' WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) THEN 'done' ELSE 'in_progress' END AS status FROM orders GROUP BY 1""",
)
def progress_by_stage(spark, sf_dir):
    got = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return got.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 2)).withColumn("status", X.stage_status(F.col("done"), F.col("total")))


@query("collection_summary", "SELECT source, count(*) AS documents, sum(n_chars) AS chars, max(n_chars) AS longest FROM documents GROUP BY source ORDER BY documents DESC, source")
def collection_summary(spark, sf_dir):
    got = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    return got.orderBy(F.desc("documents"), "source")


@query("count_by_voice", "SELECT coalesce(nullif(role, ''), 'none') AS voice, count(*) AS n FROM conversations GROUP BY 1")
def count_by_voice(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.coalesce(X.falsy_to_null(F.col("role")), F.lit("none")).alias("voice")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_violations",
    """SELECT array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM lineitem GROUP BY 1""",
)
def range_violations(spark, sf_dir):
    checks = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.07}
    return table(spark, sf_dir, "lineitem").groupBy(F.array_join(Q.violations(checks), ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "quality_flags",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, coalesce(nullif(array_to_string(list_filter([CASE WHEN l_quantity > 40 THEN 'LOUD' END, CASE WHEN l_discount = 0 THEN 'FLAT' END,
       CASE WHEN l_extendedprice < 2000 THEN 'QUIET' END], lambda x: x IS NOT NULL), '|'), ''), 'OK') AS flags FROM lineitem""",
)
def quality_flags(spark, sf_dir):
    flags = Q.flags({"LOUD": F.col("l_quantity") > 40, "FLAT": F.col("l_discount") == 0, "QUIET": F.col("l_extendedprice") < 2000})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.array_join(flags, "|").alias("flags"))


@query(
    "flag_totals",
    """SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'LOUD' END, CASE WHEN l_discount = 0 THEN 'FLAT' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY 1""",
)
def flag_totals(spark, sf_dir):
    flags = Q.violations({"LOUD": F.col("l_quantity") <= 40, "FLAT": F.col("l_discount") != 0})
    return table(spark, sf_dir, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "heuristic_score",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(greatest(0.1, 1.0 - CASE WHEN l_discount < 0.01 THEN 0.3 ELSE 0.0 END - CASE WHEN l_quantity < 5 THEN 0.2 ELSE 0.0 END
       - CASE WHEN l_tax > 0.04 THEN 0.2 ELSE 0.0 END), 2)::DOUBLE AS score FROM lineitem""",
)
def heuristic_score(spark, sf_dir):
    score = X.heuristic_score(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", score.alias("score"))


@query(
    "unit_parameters",
    """SELECT event_id, e AS energy, round(0.6 + 0.2 * e, 3) AS temperature, round(0.3 + 0.4 * a, 3) AS subtalker FROM (SELECT event_id, a, round(0.4 + 0.5 * a, 3) AS e
       FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 100 AS a FROM events))""",
)
def unit_parameters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 100).cast("double") / 100).alias("a"))
    return e.select("event_id", X.unit_energy(F.col("a")).alias("energy"), X.unit_temperature(F.col("a")).alias("temperature"), X.unit_subtalker(F.col("a")).alias("subtalker"))


@query(
    "id_harmonize",
    """WITH r AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_02' ELSE '' END AS id FROM part),
       f AS (SELECT p_partkey, CASE WHEN regexp_matches(id, '_\\d+$') THEN id ELSE id || '_01' END AS full_id FROM r),
       m AS (SELECT base, arg_max(full_id, p_partkey) AS full_id FROM (SELECT regexp_replace(full_id, '_\\d+$', '') AS base, full_id, p_partkey FROM f UNION ALL SELECT full_id, full_id, p_partkey FROM f) GROUP BY base),
       u AS (SELECT p_partkey, replace(p_name, ' ', '_') AS id FROM part)
       SELECT u.p_partkey, coalesce(m.full_id, u.id) AS harmonized FROM u LEFT JOIN m ON u.id = m.base""",
)
def id_harmonize(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("id", F.replace("p_name", F.lit(" "), F.lit("_")))
    requests = part.select(F.concat("id", F.when(F.col("p_partkey") % 3 == 0, "_02").otherwise("")).alias("canonical_id"), F.col("p_partkey").alias("ord"))
    return J.harmonize_ids(part.select("p_partkey", "id"), "id", requests, "canonical_id", "ord", "harmonized").select("p_partkey", "harmonized")


@query(
    "merge_sections",
    """WITH f AS (SELECT source, trim(lower(lang)) AS name, min(doc_id) AS first FROM documents WHERE trim(lower(lang)) <> '' GROUP BY 1, 2)
       SELECT source, name, lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY first) AS VARCHAR), 3, '0') AS section_id FROM f""",
)
def merge_sections(spark, sf_dir):
    return Q.merge_sections(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id").select("source", "name", "section_id")


@query(
    "merge_best_record",
    """WITH d AS (SELECT source, lang, doc_id, n_chars AS score, CASE WHEN doc_id % 5 = 0 THEN 'primary' WHEN doc_id % 5 < 3 THEN 'secondary' ELSE 'tactical' END AS role, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 5 < 3 THEN 2 ELSE 1 END AS rank FROM documents),
         t AS (SELECT a.* FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.source = a.source AND b.lang = a.lang AND b.doc_id < a.doc_id AND b.score >= a.score))
       SELECT source, lang, max(doc_id) AS doc_id, max(score) AS score, arg_max(role, rank) AS role FROM t GROUP BY 1, 2""",
)
def merge_best_record(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "source", "lang", "doc_id", F.col("n_chars").alias("score"), F.when(F.col("doc_id") % 5 == 0, "primary").when(F.col("doc_id") % 5 < 3, "secondary").otherwise("tactical").alias("role")
    )
    return Q.best_record(d, ["source", "lang"], "doc_id", "score", "role").select("source", "lang", "doc_id", "score", "role")


@query(
    "stem_completeness",
    """SELECT user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'view', 'error'], lambda x: NOT list_contains(l, x))), ',') AS missing, len(l) = 5 AS complete
       FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE value > 150 OR event_type IN ('click', 'view') GROUP BY 1)""",
)
def stem_completeness(spark, sf_dir):
    have = table(spark, sf_dir, "events").where("value > 150 OR event_type IN ('click', 'view')").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    missing = Q.missing_members(F.col("have"), ["click", "purchase", "signup", "view", "error"])
    return have.select("user_id", F.array_join(F.sort_array(missing), ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


@query(
    "concurrent_fetch_plan",
    "SELECT p_partkey, p_partkey % 10 AS lane FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
)
def concurrent_fetch_plan(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey")
    return table(spark, sf_dir, "part").join(held, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", (F.col("p_partkey") % 10).alias("lane"))


@query(
    "count_gate_share",
    """SELECT c_mktsegment, count(*) AS n, CAST(greatest(0, 20 - count(*)) AS BIGINT) AS quota_left FROM customer GROUP BY 1""",
)
def count_gate_share(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("quota_left", F.greatest(F.lit(0).cast("bigint"), 20 - F.col("n")))


@query(
    "json_props_extract",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS bucket FROM events",
)
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT").alias("p")).select("event_id", "p.k", (F.col("p.k") % 7).alias("bucket"))


@query("json_salvage", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, false AS broken FROM events")
def json_salvage(spark, sf_dir):
    """The payload is wrapped in a code fence with notes around it, then parsed again."""
    noisy = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nNotes follow."))
    got = Q.salvage_json(table(spark, sf_dir, "events").select("event_id", noisy.alias("payload")), "payload", "k INT")
    return got.select("event_id", "parsed.k", "broken")


@query(
    "window_extremes",
    """SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def window_extremes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("first_order"), F.max_by("o_orderkey", order).alias("last_order"))
