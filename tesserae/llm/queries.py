"""The opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, imatch, language_id, license_scan, mixing, packing, sharding, simhash, toxicity, url_filter

#: Rules of op4 (action, host, path).
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_read(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its id: bad if of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), False)
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), outcomes, URL_RULES)


def held_out(id_col: str):
    """Whether a document is held out of language training: crc32 of its id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~held_out("doc_id")))
    return language_id.identify(docs, model).withColumn("held_out", held_out("doc_id"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return imatch.edit_likeness(docs, imatch.lexicon(docs))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup,
            op2_embedding_near_dedup,
            op3_mixing,
            op4_url_filter,
            op5_language_id,
            op6_packing,
            op7_imatch_fingerprints,
            op8_license_scan,
            op9_toxicity,
            op10_sharding,
        )
    }


OP4_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, regexp_replace(host, ':[0-9]*$', '') AS bare
  FROM u LEFT JOIN o USING (page_id) GROUP BY host),
hd AS (
  SELECT host, n, k, CASE WHEN ip THEN bare WHEN two IN ({suffixes}) THEN regexp_extract(bare, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE two END AS domain,
         CASE WHEN ip THEN 'ip' WHEN two IN ({suffixes}) THEN two ELSE regexp_extract(bare, '[^.]*$') END AS suffix
  FROM (SELECT *, regexp_extract(bare, '([^.]*\\.)?[^.]*$') AS two, regexp_matches(bare, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') AS ip FROM h)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hd GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
top AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1) ELSE 0 END AS mean FROM s),
sp AS (SELECT s.*, mean FROM s, top), s1 AS (SELECT {strength} AS s FROM sp WHERE n > 0),
sm AS (SELECT suffix, (k + s * mean) / (n + s) AS mean FROM sp, s1),
dp AS (SELECT d.*, mean FROM d JOIN sm USING (suffix)), s2 AS (SELECT {strength} AS s FROM dp WHERE n > 0),
dm AS (SELECT domain, (k + s * mean) / (n + s) AS mean FROM dp, s2),
hp AS (SELECT hd.*, mean FROM hd JOIN dm USING (domain)), s3 AS (SELECT {strength} AS s FROM hp WHERE n > 0),
r AS (SELECT host, (k + s * mean) / (n + s) AS share, n + s AS w FROM hp, s3),
b AS (SELECT host, share - 1.645 * sqrt(share * (1 - share) / (w + 1)) > 0.3 AS bad FROM r),
t(k, action, rhost, rpath) AS (VALUES (1, 'allow', 'example.com', '/en/7'), (2, 'block', 'example.net', '/de/8'),
  (3, 'block', 'com', '/en/'), (4, 'allow', 'net', '/de/'), (5, 'block', 'org', '/es/')),
f AS (
  SELECT page_id, host, path, (SELECT min(k) FROM t WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS k FROM u)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN b USING (host) LEFT JOIN t USING (k)
""".format(
    suffixes=", ".join(f"'{x}'" for x in url_filter.SUFFIXES),
    strength="""CASE WHEN coalesce(sum((k - n * mean) * (k - n * mean) / n) > sum(mean * (1 - mean)) AND sum((n - 1) * mean * (1 - mean)) > 0, false)
    THEN greatest(2, least(1000, sum((n - 1) * mean * (1 - mean)) / (sum((k - n * mean) * (k - n * mean) / n) - sum(mean * (1 - mean))) - 1)) ELSE 1000 END""",
)


def oracle_sql() -> dict[str, str]:
    """The other operators rest on XXH64, floating-point models, tokenizers or scheduling, which SQL cannot express."""
    return {"op4_url_filter": OP4_SQL, "op8_license_scan": license_scan.oracle_sql()}
