"""Document fingerprints by I-Match.

Terms (runs of letters and digits, in lower case) are kept if their inverse document frequency over all documents lies
inside a band. A document's distinct kept terms, sorted, are hashed: the whole set, and its cuts to randomised lexicon
subsets. Subset (r, s) holds the terms whose r-th random number has s zero bits, so 1 in 2^s of the lexicon; documents of any
length have subsets with one or a few of their terms, which survive edits elsewhere.

A fingerprint is 4 hex digits for each of the 91 hashes, `....` for an empty subset. A text none of whose terms lies in the band
keeps all its terms; a text without terms gets `=` and the MD5 of the text instead. Likeness: 1 for equal fingerprints, else the largest share, over the subset sizes, of
subsets that agree among those that are filled on either side (at least 3 are counted); 0 against a fingerprint without
terms.

The lexicon has a bounded size: a term inside the band is in at least N * exp(-idf_high) documents, so there are at most
exp(idf_high) * (mean distinct terms a document) terms, whatever N. Up to LITERALS terms (counted) go to all tasks as a set of 64-bit hashes;
beyond that, as for tables of books, it stays a table that the terms of the texts are joined with. Both give the same fingerprints.

Null text counts as empty. Repeated rows count as documents of their own. No documents: an empty lexicon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, files_for, row_files

REPLICAS, SIZES = 10, (1, 2, 3, 4, 5, 6, 7, 8, 9)
#: A lexicon of up to so many terms is sent to the tasks.
LITERALS = 200_000


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms of a text."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text_col: str = "text", idf_low: float = 3.0, idf_high: float = 5.3, literals: int = LITERALS) -> list[int] | DataFrame:
    """Term hashes whose idf = ln(documents / documents with the term) lies inside [idf_low, idf_high]: a list, or a table (term)
    of more than `literals` terms."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term")).groupBy("term").count()
    band = counts.where((F.col("count") >= n * math.exp(-idf_high)) & (F.col("count") <= n * math.exp(-idf_low)))
    band = durable(band.select("term").hint("rebalance"))  # a small table in one file
    return band if band.count() > literals else [r[0] for r in band.collect()]


def _short(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFF))), 4, "0"))


def kept_terms(hashes: str, lex: list[int]) -> Column:
    """Sorted distinct hashes inside the lexicon (all, where none is inside), for each array in the column `hashes`."""
    if not lex:
        return F.transform(F.col(hashes), lambda h: F.sort_array(h))
    among = ",".join("-9223372036854775808" if h == -(1 << 63) else str(h) for h in lex)
    kept = F.expr(f"transform({hashes}, h -> filter(h, x -> x IN ({among})))")
    return F.zip_with(kept, F.col(hashes), lambda k, h: F.sort_array(F.when(F.size(k) > 0, k).otherwise(h)))


def fingerprint_of(terms: Column, text: Column) -> Column:
    """The fingerprint from kept terms. Each replica cuts its subset down from size to size."""
    parts, masks = [_short(F.xxhash64(terms))], F.array(*[F.lit((1 << s) - 1).cast("long") for s in SIZES])
    for r in range(REPLICAS):

        def cut(acc: Column, mask: Column, r: int) -> Column:
            # six replicas have bits of the term's hash, the others those of its hash
            bits = lambda x: F.shiftrightunsigned(x if r < 6 else F.xxhash64(x), 10 * (r % 6))
            subset = F.filter(acc["t"], lambda x: bits(x).bitwiseAND(mask) == 0)
            digits = lambda t: F.when(F.size(t) == 0, "....").otherwise(_short(F.xxhash64(t)))
            return F.transform(F.array(subset), lambda t: F.struct(t.alias("t"), F.concat(acc["o"], digits(t)).alias("o")))[0]

        step = (lambda r: lambda acc, mask: cut(acc, mask, r))(r)
        parts.append(F.aggregate(masks, F.struct(terms.alias("t"), F.lit("").alias("o")), step, lambda acc: acc["o"]))
    whole = F.concat(F.lit("="), F.md5(text.cast("binary")))
    return F.when(F.size(terms) == 0, whole).otherwise(F.concat(*parts))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    best = []
    for k in range(len(SIZES)):
        at = [5 + 4 * (r * len(SIZES) + k) for r in range(REPLICAS)]
        pairs = [(F.substring(a, p, 4), F.substring(b, p, 4)) for p in at]
        same = sum((((x == y) & (x != "....")).cast("int") for x, y in pairs), F.lit(0))
        filled = sum((((x != "....") | (y != "....")).cast("int") for x, y in pairs), F.lit(0))
        best.append(same / F.greatest(filled, F.lit(3)))
    rough = F.when(a.startswith("=") | b.startswith("="), F.lit(0.0)).otherwise(F.greatest(*best))
    return F.when(a == b, F.lit(1.0)).otherwise(rough).cast("double")


def _joined_terms(rows: DataFrame, lex: DataFrame) -> DataFrame:
    """rows, with the terms that `kept_terms` keeps in __terms in place of __hashes, by a join on the terms. A term inside the band is in at most a
    share exp(-idf_low) of the texts; what is gathered again are the terms of a single row."""
    rows = durable(rows.withColumn("__row", F.monotonically_increasing_id()))
    terms = rows.select("__row", F.posexplode("__hashes").alias("__text", "__h")).select("__row", "__text", F.explode("__h").alias("term"))
    kept = terms.join(lex, "term").groupBy("__row").agg(F.collect_list(F.struct("__text", "term")).alias("__kept"))
    kept = rows.join(kept.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left")

    def of_text(h: Column, k: Column) -> Column:
        mine = F.transform(F.filter("__kept", lambda t: t["__text"] == k), lambda t: t["term"])
        return F.sort_array(F.when(F.size(F.coalesce(mine, F.array().cast("array<bigint>"))) > 0, mine).otherwise(h))

    return kept.withColumn("__terms", F.transform("__hashes", of_text)).drop("__hashes", "__kept", "__row", "__of")


def with_fingerprints(rows: DataFrame, texts: dict[str, str], lex: list[int] | DataFrame) -> DataFrame:
    """rows and a fingerprint column for each text column. texts: text column -> name of its fingerprint."""
    plain = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts])
    rows = rows.withColumn("__hashes", F.transform(plain, term_hashes))
    rows = rows.withColumn("__terms", kept_terms("__hashes", lex)).drop("__hashes") if isinstance(lex, list) else _joined_terms(rows, lex)
    for k, (c, name) in enumerate(texts.items()):
        rows = rows.withColumn(name, fingerprint_of(F.col("__terms")[k], F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return rows.drop("__terms")


def fingerprints(docs: DataFrame, lex: list[int] | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row."""
    return with_fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("__text")), {"__text": "fingerprint"}, lex).select(id_col, "fingerprint")


def ring(rows: DataFrame, id_col: str, carry: str) -> DataFrame:
    """(id, carry, next_id, prev_id, prev_carry): each row with its neighbours by ascending id, the last followed by the first.

    Needs ids that are unique and not null. Rows are sorted in range partitions; only each partition's ends are brought
    together."""
    total = rows.count()
    n = max(1, total // 65536)
    parts = durable(rows.select(F.col(id_col).alias("id"), F.col(carry).alias("c")).repartitionByRange(n, "id").withColumn("pid", F.spark_partition_id()), files_for(total))
    w, row = Window.partitionBy("pid").orderBy("id"), F.struct("id", "c")
    inside = parts.withColumn("next", F.lead("id").over(w)).withColumn("prev", F.lag(row).over(w))
    ends = parts.groupBy("pid").agg(F.min("id").alias("first"), F.max_by(row, "id").alias("last"))
    order, all_ = Window.orderBy("pid"), Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = durable(
        ends.select(
            "pid", F.coalesce(F.lead("first").over(order), F.first("first").over(all_)).alias("after"), F.coalesce(F.lag("last").over(order), F.last("last").over(all_)).alias("before")
        ),
        8,
    )
    return inside.join(ends, "pid").select(
        F.col("id").alias(id_col),
        F.col("c").alias(carry),
        F.coalesce("next", "after").alias("next_id"),
        F.coalesce("prev", "before")["id"].alias("prev_id"),
        F.coalesce("prev", "before")["c"].alias("prev_carry"),
    )


def edit_likeness(docs: DataFrame, lex: list[int] | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against an edited
    copy, whose last quarter is the start of the next document, and against the next document.

    Rows are in the order of their ids, null ids last, and of their texts' hashes; the last is followed by the first. Rows
    with one id and one text are worked out once: each is followed by its copy, the last of them by the next document.
    Texts are shuffled once, by id and hash; of the next document only the quarter that is needed moves on."""
    text, kind = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.schema[id_col].dataType
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0).cast(kind)).alias("id"), F.xxhash64("text").alias("hash"))
    rows, total = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("place", place), docs.count()
    lengths = durable(rows.groupBy("place").agg(F.first(F.length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("copies")), row_files(total))
    links = durable(ring(lengths.withColumn("c", F.struct("n_chars", "copies")), "place", "c"), files_for(total))
    repeated = not lengths.where("copies > 1").isEmpty()
    texts = rows.select("place", "text")
    placed = (texts.dropDuplicates(["place"]) if repeated else texts).join(links, "place")
    head = "left(text, cast({} div 4 as int))"
    heads = placed.select(F.col("prev_id").alias("owner"), F.col("place").alias("next"), F.lit(1).cast("long").alias("times"), F.expr(head.format("prev_carry.n_chars")).alias("head"))
    if repeated:
        own = placed.where("c.copies > 1").select("place", F.col("place").alias("next"), F.expr("c.copies - 1").alias("times"), F.expr(head.format("c.n_chars")).alias("head"))
        heads = heads.unionByName(own.withColumnRenamed("place", "owner"))
    both = placed.select("place", "text", F.col("c.n_chars").alias("n_chars")).join(heads, F.col("place") == F.col("owner"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), "head"))
    both = with_fingerprints(both, {"text": "fingerprint", "edited": "edited_fingerprint"}, lex)
    made = durable(
        both.select("place", "n_chars", "next", "times", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"),
        row_files(total),
    )
    following = made.select(F.col("place").alias("following"), F.col("fingerprint").alias("next_fingerprint"))
    if repeated:
        following = following.dropDuplicates(["following"])
    out = made.join(following, F.col("next") == F.col("following")).select(
        F.when(~F.col("place.none"), F.col("place.id")).alias(id_col),
        "times",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
    return (out.withColumn("times", F.explode(F.expr("sequence(1L, times)"))) if repeated else out).drop("times")
