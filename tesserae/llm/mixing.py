"""Mixing sources to target weights.

Documents get hash-random keys; inside each source, ordered by key, distributed prefix sums of the word counts are cut
at the source's exact budget. Whole epochs are taken first, the rest from the front of the order; the document at the
cut gives its first words only, so that a source's taken words equal its rounded target.

Null text has no words and is never taken. Null sources form one source, ranked last. A source without words gets target
0. Repeated rows count each; equal rows (one id, text and source) are counted together and told apart only at a cut. An empty table gives an empty result. Other columns of the input are ignored (`mix_plan`) or
kept (`mix_documents`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, files_for, grouped_prefix, unsigned_order

#: A table of sources up to this many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _random_key(id_col: str, text_col: str, seed: int):
    """Rows with one id and one text share a key and are counted together; other rows have keys of their own."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string"))


def _sources(narrow: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, rank, source_size, weight): rank by code point, null last, from counts over range partitions."""
    sums = durable(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), 24)
    n = max(1, sums.count() // 8192)
    ranged = durable(sums.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()), 24)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("pid").count().select("pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last()))
    ranked = ranged.withColumn("n", inside).join(starts, "pid").withColumn("rank", F.col("start") + F.col("n") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", "rank", "source_size", weight.alias("weight"))


def source_targets(narrow: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """(source, rank, source_size, target): shares of `share` of all words by weight; a target stops at `epochs` times its
    source's size and the excess is shared again, until none is above. Each round is one small aggregation."""
    s = durable(_sources(narrow, weights), 24)
    cap = F.col("source_size") * float(epochs)
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    amount, level, capped = share * total[0], share * total[0] / (total[1] or 1.0), -1
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        n, held, open_weight = s.agg(
            F.coalesce(F.sum(above.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (amount - held) / open_weight
    return s.select("source", "rank", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, epochs, seed) -> tuple[DataFrame, DataFrame]:
    """(rows, targets): one row for each set of equal rows (one id, text and source) with their number `copies`, the running sum `start` of words
    before the first of them, and `full`, the epochs that every row gets, and `rest`, the words of the last, broken epoch."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _random_key(id_col, text_col, seed).alias("key")
    )
    narrow = durable(narrow.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), files_for(docs.count(), 100_000, 24))
    targets = durable(source_targets(narrow.withColumn("size", F.col("size") * F.col("copies")), weights, share, epochs), 24)
    small = targets.count() <= BROADCAST_ROWS
    joined = narrow.join(F.broadcast(targets) if small else targets, narrow["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = grouped_prefix(joined, "rank", "key", ["id", "size"], F.col("size") * F.col("copies"), "start", narrow.count())
    budget = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long")
    return placed.withColumn("full", full).withColumn("rest", budget - F.col("full") * F.col("source_size")), targets


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(id, size, source_size, target, taken) for each row. The n-th source by code point has the n-th weight, repeating."""
    placed, _ = _plan(docs, id_col, text_col, source_col, weights, share, epochs, seed)
    rows = placed.withColumn("at", F.explode(F.expr("sequence(0L, copies - 1)")))
    last = F.greatest(F.least(F.col("rest") - F.col("start") - F.col("at") * F.col("size"), F.col("size")), F.lit(0))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("full") * F.col("size") + last).cast("long").alias("taken"))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """The mixed documents with the columns of docs: a row for each time a document is taken; the text of the document at
    a source's cut ends after its last taken word. Texts are not shuffled: each source's plan comes down to one key."""
    placed, targets = _plan(docs, id_col, text_col, source_col, weights, share, epochs, seed)
    # the equal rows among which a source's rest ends: so many of them are taken whole, then one in part
    whole = F.least(F.col("copies"), F.expr("(rest - start) div size"))
    last = F.struct("start", "id")
    cuts = placed.where("size > 0 and rest > start").withColumn("whole", whole).groupBy("rank").agg(
        *[F.max_by(c, last).alias(f"__cut_{c}") for c in ("id", "key", "whole", "copies")],
        F.max_by(F.when(F.col("whole") < F.col("copies"), F.col("rest") - F.col("start") - F.col("whole") * F.col("size")).otherwise(F.lit(0)), last).alias("__cut_last"),
    )
    full = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("int")
    plan = durable(targets.join(cuts, "rank", "left").select(F.col("source").alias("__source"), full.alias("__full"), *[f"__cut_{c}" for c in ("id", "key", "whole", "copies", "last")]), 24)
    small, repeated = plan.count() <= BROADCAST_ROWS, not plan.where("__cut_copies > 1").isEmpty()
    plan = F.broadcast(plan) if small else plan
    order = lambda key, i: F.struct(unsigned_order(key), i)
    size, own = word_count(F.col(text_col)), order(_random_key(id_col, text_col, seed), F.col(id_col))
    cut = order(F.col("__cut_key"), F.col("__cut_id"))
    words = F.regexp_extract_all(F.col(text_col), F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    out = docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("__source"))).where(size > 0)
    out = out.withColumn("__side", F.when(own < cut, F.lit(-1)).when(own == cut, F.lit(0)).otherwise(F.lit(1)))
    if repeated:  # only the equal rows at the cuts are numbered; which of them comes first does not matter
        at_cut = Window.partitionBy("__source").orderBy(F.xxhash64(*docs.columns))
        out = out.where("__side <> 0").withColumn("__n", F.lit(1)).unionByName(out.where("__side = 0").withColumn("__n", F.row_number().over(at_cut)))
    else:
        out = out.withColumn("__n", F.lit(1))
    at = F.col("__side") == 0
    taken = F.when((F.col("__side") < 0) | at & (F.col("__n") <= F.col("__cut_whole")), F.array(F.lit(False)))
    taken = taken.when(at & (F.col("__n") == F.col("__cut_whole") + 1) & (F.col("__cut_last") > 0), F.array(F.lit(True)))
    copies = F.concat(F.array_repeat(F.lit(False), F.col("__full")), taken.otherwise(F.array().cast("array<boolean>")))
    out = out.withColumn("__part", F.explode(copies))
    text = F.when(F.col("__part"), F.array_join(F.slice(words, 1, F.col("__cut_last").cast("int")), "")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns)
