"""Segmentation queries. Their SQL walks the texts by recursion, a step for each piece."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import expr as X
from ..functions import text as T
from ..session import table

_WS = r"[\s\x0b\x1c-\x1f\x85\xa0]"
_NO_WS = r"[^\s\x0b\x1c-\x1f\x85\xa0]"


def _marks(name: str, pattern: str, from_: str) -> str:
    """name (doc_id, marks): the places of a pattern's matches, from the lengths of the matches and of the pieces between them."""
    return f"""{name} AS (SELECT doc_id, list(from_ ORDER BY from_) AS marks FROM (SELECT doc_id, {from_} AS from_ FROM (
      SELECT doc_id, n, sum(between_ + n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM (
        SELECT doc_id, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(p[1:len(m)], lambda x: length(x))) AS between_
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents)))) GROUP BY doc_id)"""


def segments_sql(least: int, most: int, overlap: int, exact: bool = True) -> str:
    """CTEs up to seg (doc_id, segment_index, start_index, end_index, segment_text, word_count)."""
    after = f"CASE WHEN stop - {overlap} > from_ THEN stop - {overlap} ELSE stop END"
    follow = after if exact else f"CASE WHEN cut OR stop = n THEN stop ELSE {after} END"
    first = lambda marks: f"list_min(list_filter({marks}, lambda x: x >= from_ + {least} AND x <= from_ + {most}))"
    step = f"""SELECT doc_id, k, from_, n, text, p, s, h, coalesce(nullif({first('p')}, from_ + {most}), {first('s')}, from_ + {most}) AS want, list_min(list_filter(h, lambda x: x > from_)) AS head"""
    ended = "SELECT *, coalesce(head < want, false) AS cut, least(CASE WHEN coalesce(head < want, false) THEN head ELSE want END, n) AS stop"
    return f"""{_marks("pa", r"\n" + _WS + r"*\n", "stop")}, {_marks("sen", r"[.!?]+" + _WS + "+", "stop")}, {_marks("hea", r"(?i)\n" + _WS + r"*(?:chapter|capitolo|section|parte)" + _WS + r"+\d+", "stop - n")},
    {_marks("nl", r"\n", "stop")}, ind AS (SELECT doc_id, list_filter(marks, lambda x: regexp_matches(substr(text, x + 1, 1), '{_WS}')) AS marks FROM nl JOIN documents USING (doc_id)),
    d AS (SELECT doc_id, text, length(text) AS n, list_concat(coalesce(pa.marks, []), coalesce(ind.marks, [])) AS p, coalesce(sen.marks, []) AS s, coalesce(hea.marks, []) AS h
      FROM documents LEFT JOIN pa USING (doc_id) LEFT JOIN ind USING (doc_id) LEFT JOIN sen USING (doc_id) LEFT JOIN hea USING (doc_id)),
    seg0 AS (SELECT doc_id, 0 AS k, 0::BIGINT AS from_, 0::BIGINT AS stop, 0::BIGINT AS follow FROM d WHERE n > 0
      UNION ALL SELECT doc_id, k + 1, from_, stop, {follow} FROM ({ended} FROM ({step} FROM (SELECT d.*, r.k, r.follow AS from_ FROM seg0 r JOIN d USING (doc_id) WHERE r.follow < d.n)))
        WHERE regexp_matches(substr(text, from_ + 1, stop - from_), '{_NO_WS}') AND k <= 10000),
    seg AS (SELECT doc_id, k - 1 AS segment_index, from_::INT AS start_index, stop::INT AS end_index, t AS segment_text, len(regexp_extract_all(t, '{_NO_WS}+'))::INT AS word_count
      FROM (SELECT doc_id, k, from_, stop, regexp_replace(substr(text, from_ + 1, stop - from_), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM seg0 JOIN d USING (doc_id) WHERE k > 0))"""


def subsegments_sql(source: str, ids: str, text: str, window: int = 300) -> str:
    """CTEs up to sub (ids, subsegment_index, subsegment_text, word_count) over a table."""
    return f"""w AS (SELECT {ids}, regexp_extract_all({text}, '{_NO_WS}+') AS w FROM {source}),
    sub0 AS (SELECT {ids}, 0 AS k, 0::BIGINT AS from_, 0::BIGINT AS stop FROM w
      UNION ALL SELECT {ids}, k + 1, from_, CASE WHEN stop < len(w) AND dot <> '' THEN from_ + len(string_split(dot, ' ')) ELSE stop END
        FROM (SELECT *, regexp_extract(substr(array_to_string(w[from_ + 1:stop + 20], ' '), 1, length(array_to_string(w[from_ + 1:stop], ' ')) + 50), '(?s)^.*\\.') AS dot
          FROM (SELECT w.*, r.k, r.stop AS from_, least(r.stop + {window}, len(w.w)) AS stop FROM sub0 r JOIN w USING ({ids}) WHERE r.stop < len(w.w)))),
    sub AS (SELECT {ids}, k - 1 AS subsegment_index, array_to_string(w[from_ + 1:stop], ' ') AS subsegment_text, (stop - from_)::INT AS word_count FROM sub0 JOIN w USING ({ids}) WHERE k > 0)"""


SEGMENT_MD5 = "SELECT doc_id, segment_index, start_index, end_index, word_count, md5(segment_text) AS segment_md5 FROM seg"


@query("segment_documents", f"WITH RECURSIVE {segments_sql(1500, 3500, 500)} {SEGMENT_MD5}")
def segment_documents(spark, sf_dir):
    return T.segment(table(spark, sf_dir, "documents"), ["doc_id"], least=1500, most=3500, overlap=500).withColumn("segment_md5", F.md5(F.col("segment_text").cast("binary"))).drop("segment_text")


@query("segment_documents_full_size", f"WITH RECURSIVE {segments_sql(7500, 17_500, 2500)} {SEGMENT_MD5}")
def segment_documents_full_size(spark, sf_dir):
    got = T.segment(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.withColumn("segment_md5", F.md5(F.col("segment_text").cast("binary"))).drop("segment_text")


@query("subsegment_documents", f"WITH RECURSIVE {subsegments_sql('documents', 'doc_id', 'text')} SELECT doc_id, subsegment_index, word_count, md5(subsegment_text) AS subsegment_md5 FROM sub")
def subsegment_documents(spark, sf_dir):
    return T.subsegment(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("subsegment_md5", F.md5(F.col("subsegment_text").cast("binary"))).drop("subsegment_text")


@query(
    "segment_tree",
    f"""WITH RECURSIVE {segments_sql(7500, 17_500, 2500, exact=False)}, {subsegments_sql('seg', 'doc_id, segment_index', 'segment_text')}
    SELECT doc_id, printf('chunk-%03d-micro-%03d', segment_index, subsegment_index) AS label, word_count FROM sub""",
)
def segment_tree(spark, sf_dir):
    """Documents to segments to subsegments, with hierarchical labels."""
    segments = T.segment(table(spark, sf_dir, "documents"), ["doc_id"], exact=False)
    pieces = T.subsegment(segments, ["doc_id", "segment_index"], "segment_text")
    label = F.concat(F.lit("chunk-"), X.zero_pad(F.col("segment_index")), F.lit("-micro-"), X.zero_pad(F.col("subsegment_index")))
    return pieces.select("doc_id", label.alias("label"), "word_count")


@query("segment_stats", f"WITH RECURSIVE {segments_sql(1500, 3500, 500)} SELECT doc_id, count(*) AS segments, sum(word_count)::BIGINT AS words, max(word_count) AS most_words FROM seg GROUP BY doc_id")
def segment_stats(spark, sf_dir):
    got = T.segment(table(spark, sf_dir, "documents"), ["doc_id"], least=1500, most=3500, overlap=500)
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("word_count").alias("words"), F.max("word_count").alias("most_words"))


@query(
    "size_blocks",
    r"""WITH RECURSIVE b AS (SELECT doc_id, 0 AS k, 0::BIGINT AS from_, 0::BIGINT AS stop FROM documents
      UNION ALL SELECT doc_id, k + 1, from_, CASE WHEN stop < length(text) AND gap <> '' THEN from_ + 2500 + length(gap) - 2 ELSE stop END
        FROM (SELECT *, regexp_extract(substr(text, from_ + 2501, stop - from_ - 2500), '(?s)^.*\n\n') AS gap FROM (SELECT doc_id, text, k, b.stop AS from_, least(b.stop + 5000, length(text)) AS stop FROM b JOIN documents USING (doc_id) WHERE b.stop < length(text))))
      SELECT doc_id, k - 1 AS block_index, (stop - greatest(from_ - CASE WHEN from_ > 0 THEN 200 ELSE 0 END, 0))::INT AS block_chars FROM b WHERE k > 0""",
)
def size_blocks(spark, sf_dir):
    got = T.blocks(table(spark, sf_dir, "documents"), ["doc_id"], limit=5000, overlap=200)
    return got.select("doc_id", "block_index", F.length("block_text").alias("block_chars"))
