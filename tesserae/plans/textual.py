"""Queries over documents and pages: cleaning, counting, identifiers, segmentation, structure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..functions import text as T
from ..operators import structure
from ..session import table


@query(
    "clean_lines",
    """SELECT doc_id, md5(left(array_to_string(list_filter(list_transform(string_split(replace(text, chr(12), ''), chr(10)),
       lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), chr(10)), 800000)) AS clean_md5 FROM documents""",
)
def clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text")).cast("binary")).alias("clean_md5"))


@query("word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\x0b\\x85\\xa0]+')) AS INTEGER) AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("token_estimate", "SELECT doc_id, CAST(trunc(n_chars / 3.8e0) AS INTEGER) AS tokens, n_chars > 5000 AS needs_chunking FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("n_chars")).alias("tokens"), (F.col("n_chars") > 5000).alias("needs_chunking"))


@query("sentence_ends", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]+\\s+')) AS INTEGER) AS ends FROM documents")
def sentence_ends(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[.!?]+\\s+")).alias("ends"))


@query(
    "id_normalize",
    """WITH n AS (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer)
       SELECT name, CASE WHEN coalesce(name, '') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(lower(
         regexp_replace(name, '^((?:.*/)?\\.*[^./][^/]*)\\.[^./]*$', '\\1')), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug,
         count(*) AS n FROM n GROUP BY ALL""",
)
def id_normalize(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    return names.groupBy("name", X.normalize_id(F.col("name")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_format_by_extension",
    """SELECT page_id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1))
         WHEN 'pdf' THEN 'pdf' WHEN 'epub' THEN 'epub' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'txt' WHEN 'html' THEN 'html' ELSE 'unknown' END AS format FROM pages""",
)
def file_format_by_extension(spark, sf_dir):
    from ..sources.files import format_of_path

    return table(spark, sf_dir, "pages").select("page_id", format_of_path(F.regexp_replace("url", "[?#].*$", ""), also=("html",)).alias("format"))


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("t")).select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("text_previews", "SELECT doc_id, left(text, 80) AS preview_80, left(text, 120) AS preview_120 FROM documents")
def text_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("preview_80"), F.substring("text", 1, 120).alias("preview_120"))


@query(
    "content_hash_jobs",
    """SELECT doc_id, 'job-' || substr(sha256('doc:' || doc_id || '|source:' || source), 1, 12) AS job,
         'd2-' || substr(source, 1, 3) || '-' || substr(md5(text), 1, 10) AS asset_job, md5('model:' || text) AS cache_key FROM documents""",
)
def content_hash_jobs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.job_id(doc=F.col("doc_id"), source=F.col("source")).alias("job"),
        X.asset_job_id(F.col("source"), F.col("text")).alias("asset_job"),
        X.cache_key(F.lit("model"), F.col("text")).alias("cache_key"),
    )


@query(
    "punctuation_toggle",
    """SELECT turn, conv_id, replace(CASE WHEN starts_with(text, '- ') THEN chr(57344) || ' ' || substr(r, 2) ELSE r END, chr(57344), '"') AS normalized
       FROM (SELECT *, regexp_replace(text, '(\\.|\\?|!|\\n)\\s*- ', '\\1 ' || chr(57344) || ' ', 'g') AS r FROM conversations)""",
)
def punctuation_toggle(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_punctuation(F.col("text"), "toggle", "- ").alias("normalized"))


@query(
    "punctuation_pairs",
    """SELECT doc_id, md5(replace(regexp_replace(text, '(?s)\\|(.*?)\\|', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344), '"')) AS normalized_md5 FROM documents""",
)
def punctuation_pairs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_punctuation(F.col("text"), "enclosed_pair", "|").cast("binary")).alias("normalized_md5"))


@query(
    "placeholder_prompts",
    """SELECT c_custkey, replace(replace('Name: {name}; Segment: {segment}', '{name}', c_name), '{segment}', c_mktsegment) AS prompt FROM customer""",
)
def placeholder_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.fill_template(F.lit("Name: {name}; Segment: {segment}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("prompt"))


@query(
    "structure_kind",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:^|\n)[ \t]*(Capitolo|Chapter|Parte)\s+\S+\s*[:\-]')) AS t, len(regexp_extract_all(text, '(?:^|\n)[ \t]*\d{1,3}[ \t]*\n')) AS n,
         len(regexp_extract_all(text, '(?:^|\n)[ \t]*([A-Z][A-Z\s''"À-Ü]{5,})[ \t]*\n')) AS c FROM documents)
       SELECT doc_id, CASE WHEN t = 0 AND n = 0 AND c = 0 THEN 'plain' WHEN t >= n AND t >= c THEN 'titled' WHEN n >= c THEN 'numbered' ELSE 'capitals' END AS kind FROM c""",
)
def structure_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", structure.kind(F.col("text")).alias("kind"))


@query("section_boundaries")
def section_boundaries(spark, sf_dir):
    return structure.boundaries(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "section_index", "section_title", "start_pos", "end_pos")


@query(
    "prefix_clusters",
    """WITH h AS (SELECT array_to_string(string_split(p_name, ' ')[1:2], ' ') AS prefix, p_size FROM part)
       SELECT prefix, count(*) AS n, max(p_size) - min(p_size) AS spread FROM h GROUP BY prefix
       HAVING count(*) >= 2 AND max(p_size) - min(p_size) >= 0.5 * avg(p_size)""",
)
def prefix_clusters(spark, sf_dir):
    heads = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 2).alias("prefix"), "p_size")
    got = heads.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), (F.max("p_size") - F.min("p_size")).alias("spread"), F.avg("p_size").alias("mean"))
    return got.where((F.col("n") >= 2) & (F.col("spread") >= 0.5 * F.col("mean"))).drop("mean")


@query("roman_ordinals", """SELECT n_nationkey, n_nationkey + 1 AS parsed FROM nation""")
def roman_ordinals(spark, sf_dir):
    """Round trip: section numbers written as Roman numerals and parsed again."""
    n = table(spark, sf_dir, "nation")
    written = F.array(*[F.lit(X.roman(k)) for k in range(1, 31)])[F.col("n_nationkey")]
    return n.select("n_nationkey", X.parse_ordinal(F.concat(F.lower(written), F.lit(":"))).alias("parsed"))


@query(
    "language_bullets",
    """SELECT source, array_to_string(list_transform(list_sort(list(DISTINCT lang)), lambda x: '- ' || x), chr(10)) AS bullets FROM documents GROUP BY source""",
)
def language_bullets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return d.select("source", X.bullet_list(F.col("langs")).alias("bullets"))


@query(
    "section_first_positions",
    """SELECT doc_id, word AS name, strpos(text, word) - 1 AS pos FROM (SELECT doc_id, text, unnest(['the ', ' la ', ' der ', 'zzz']) AS word FROM documents) WHERE strpos(text, word) > 0""",
)
def section_first_positions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.explode(F.array(*map(F.lit, ("the ", " la ", " der ", "zzz")))).alias("name"))
    return structure.section_positions(d, "doc_id", "text", s, "name")


@query(
    "section_blocks",
    """WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
       r AS (SELECT conv_id, i, n AS total, 0 AS block, CAST(e AS BIGINT) AS e, CAST(e - n AS BIGINT) AS s FROM l WHERE i = 1 UNION ALL
             SELECT l.conv_id, l.i, CASE WHEN r.total + l.n > 2000 THEN l.n ELSE r.total + l.n END, CASE WHEN r.total + l.n > 2000 THEN r.block + 1 ELSE r.block END, CAST(l.e AS BIGINT), CAST(l.e - l.n AS BIGINT) FROM r JOIN l ON l.conv_id = r.conv_id AND l.i = r.i + 1)
       SELECT conv_id, block, min(s) AS start_pos, max(e) AS end_pos, count(*) AS sections FROM r GROUP BY 1, 2""",
)
def section_blocks(spark, sf_dir):
    """A conversation is one text whose sections are its turns; sections are packed whole."""
    c = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    texts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "").alias("text"))
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    positions = c.select("conv_id", F.col("turn").cast("string").alias("name"), (end - F.length("text")).alias("pos"))
    return structure.section_blocks(positions, texts, "conv_id", "text", 2000)


@query("boundary_union", """SELECT doc_id, list_sort(list_distinct(list_concat([n_chars % 7, n_chars % 11], [n_chars % 5, n_chars % 7]))) AS marks FROM documents""")
def boundary_union(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_union(F.array(n % 7, n % 11), F.array(n % 5, n % 7))).alias("marks"))


@query("edge_headings", """SELECT source, list(doc_id ORDER BY doc_id)[:3] AS first_three, list(doc_id ORDER BY doc_id)[-2:] AS last_two FROM documents GROUP BY source""")
def edge_headings(spark, sf_dir):
    """The first and last few of each source. Bounded lists: ranked from both ends before they are gathered."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    w = Window.partitionBy("source")
    up, down = F.row_number().over(w.orderBy("doc_id")), F.row_number().over(w.orderBy(F.desc("doc_id")))
    first = d.withColumn("r", up).where("r <= 3").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("first_three"))
    last = d.withColumn("r", down).where("r <= 2").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("last_two"))
    return first.join(last, "source")


@query(
    "upload_status",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<![^>]*>', '', 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
       SELECT page_id, CASE WHEN regexp_matches(t, '\S') THEN 'upload_complete' ELSE 'error' END AS status FROM t""",
)
def upload_status(spark, sf_dir):
    """Pages as uploads: extracted text, or an error with its status."""
    got = table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("t"))
    return got.select("page_id", F.when(F.length("t") > 0, "upload_complete").otherwise("error").alias("status"))
