"""Joins that Spark has no single operator for, and joins with defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import base_id, with_suffix
from .ordered import numbered, summed_up_to


def left_with_defaults(left: DataFrame, right: DataFrame, left_key: str, right_key: str, defaults: Mapping[str, object]) -> DataFrame:
    """left and the columns of `defaults` from right, or all the defaults together where the key is missing on the right."""
    r = right.select(F.col(right_key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in defaults], F.lit(True).alias("__hit"))
    got = left.join(r, F.col(left_key) == F.col("__key"), "left")
    return got.select(*left.columns, *[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()])


def required_grid(units: DataFrame, grid: DataFrame, parent: str, unit: str, defaults: Mapping[str, object]) -> DataFrame:
    """units and the columns of `defaults` from grid (parent, unit, ..). A parent without any row in the grid aborts the query; a unit that its parent's
    rows lack gets the defaults."""
    parents = grid.select(F.col(parent).alias("__parent")).distinct()
    rows = grid.select(F.col(parent).alias("__p"), F.col(unit).alias("__u"), *[F.col(c).alias(f"__{c}") for c in defaults])
    got = units.join(parents, F.col(parent) == F.col("__parent"), "left").join(rows, (F.col(parent) == F.col("__p")) & (F.col(unit) == F.col("__u")), "left")
    missing = F.raise_error(F.concat(F.lit("no timing for "), F.col(parent).cast("string")))
    checked = lambda c, v: F.when(F.col("__parent").isNull(), missing.cast(grid.schema[c].dataType)).otherwise(F.coalesce(f"__{c}", F.lit(v)))
    return got.select(*units.columns, *[checked(c, v).alias(c) for c, v in defaults.items()])


def first_candidate(wanted: DataFrame, candidates: DataFrame, existing: DataFrame, key: str, rank: str, path: str) -> DataFrame:
    """wanted with `found`: the first of a key's candidate paths (key, rank, path) that exists, or null."""
    hits = candidates.join(existing.select(F.col(path).alias("__path")).distinct(), F.col(path) == F.col("__path"), "left_semi")
    first = hits.groupBy(F.col(key).alias("__key")).agg(F.min_by(path, rank).alias("found"))
    return wanted.join(first, F.col(key) == F.col("__key"), "left").drop("__key")


def attach_by_file(units: DataFrame, unit_id: str, files: DataFrame, path: str) -> DataFrame:
    """units with `file`: the first path whose name without folder and extension ends with the unit's id after a `-` or is the id; null if none."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", "")
    # every tail of the stem after a `-` is a key, so the suffix match is an equi-join
    parts = F.split(stem, "-")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    keyed = files.select(F.col(path).alias("__path"), F.explode(tails).alias("__tail"))
    first = keyed.groupBy("__tail").agg(F.min("__path").alias("file"))
    return units.join(first, F.col(unit_id) == F.col("__tail"), "left").drop("__tail")


def name_or_id(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str, order: str | None = None) -> DataFrame:
    """The name for a key, or the key itself. Of repeated keys in `names` the last in `order` wins (without an order: by name)."""
    unique = names.groupBy(F.col(name_key).alias("__key")).agg(F.max_by(name, order or name).alias("__name"))
    return df.join(unique, F.col(key) == F.col("__key"), "left").withColumn(out, F.coalesce("__name", F.col(key).cast("string"))).drop("__key", "__name")


#: Items up to this many, and this many characters in all, are sent to every executor.
BROADCAST_ITEMS, BROADCAST_CHARS = 100_000, 64_000_000


def first_contained(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(id, item_id): the smallest item whose text a document contains.

    An item's longest inner word (between two single spaces) is a whole word of every document that contains the item. Documents keep those of their
    words that are such keys - inside their row, while the items fit the broadcast limits, else by a join - and only the
    hits are compared. Items without an inner word are looked for one by one inside the row, in blocks; there may be at most BROADCAST_ITEMS of these.
    """
    tokens = F.split(F.col(item_text), " ")
    inner = F.filter(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    i = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("__item"), F.col(item_text).alias("__body"), F.when(F.size(inner) > 0, longest).alias("__key"))
    n, chars, n_plain = i.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("__body")), F.lit(0)), F.count_if(F.col("__key").isNull())).first()
    small = n <= BROADCAST_ITEMS and chars <= BROADCAST_CHARS
    keyed = i.where("__key is not null")
    d = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    words = F.array_distinct(F.split("__text", " "))
    if small:
        known = [r[0] for r in keyed.select("__key").distinct().collect()]
        probes = d.select(id_col, "__text", F.explode(F.array_distinct(F.filter(F.split("__text", " "), lambda w: w.isin(*known)))).alias("__key")) if known else None
        hits = probes.join(F.broadcast(keyed), "__key").where(F.contains("__text", "__body")).select(id_col, "__item") if known else None
    else:
        candidates = d.select(id_col, F.explode(words).alias("__key")).join(keyed.select("__key", "__item"), "__key").select(id_col, "__item").distinct()
        hits = candidates.join(keyed.select("__item", "__body"), "__item").join(d, id_col).where(F.contains("__text", "__body")).select(id_col, "__item")
    if n_plain:
        if n_plain > BROADCAST_ITEMS:
            raise ValueError(f"more than {BROADCAST_ITEMS} items without an inner word")
        plain = i.where("__key is null").select("__item", "__body").collect()
        for at in range(0, n_plain, 1000):
            held = F.array(*[F.when(F.contains("__text", F.lit(r[1])), F.lit(r[0])) for r in plain[at : at + 1000]])
            rest = d.select(id_col, F.array_min(held).alias("__item")).where("__item is not null")
            hits = rest if hits is None else hits.unionByName(rest)
    if hits is None:
        return docs.select(id_col, F.lit(None).cast(items.schema[item_id].dataType).alias(item_id)).limit(0)
    return hits.groupBy(id_col).agg(F.min("__item").alias(item_id))


def range_join(left: DataFrame, right: DataFrame, low: str, high: str, point: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high, by an equi-join on buckets of `width`: an interval is repeated for each bucket it meets."""
    buckets = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    l = left.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(buckets))  # noqa: E741
    r = right.withColumn("__bucket", F.floor(F.col(point) / width))
    return l.join(r, "__bucket").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__bucket")


def range_counts(left: DataFrame, keys: Sequence[str], right: DataFrame, low: str, high: str, point: str, out: str) -> DataFrame:
    """For each of left's keys (null keys are a key) the number of pairs with low <= point <= high, 0 without any, and no pair is formed: points up to
    high less points below low, looked up in running counts over the distinct values of all three columns. Work grows with the rows, not with the pairs."""
    valid = F.when(F.col(low) <= F.col(high), 1).otherwise(0)
    ends = F.array(F.struct(F.col(high).alias("v"), valid.alias("sign")), F.struct(F.col(low).alias("v"), (-valid).alias("sign")))
    e = left.select(*keys, F.explode(ends).alias("__end")).select(*keys, F.col("__end.v").alias("__v"), F.col("__end.sign").alias("__sign"))
    values = right.select(F.col(point).alias("__v"), F.lit(1).alias("__n")).unionByName(e.select("__v", F.lit(0).alias("__n"))).where("__v is not null")
    counts = summed_up_to(values.groupBy("__v").agg(F.sum("__n").alias("__n")), "__v", "__n", "__upto").withColumnRenamed("__v", "__value")
    points = F.when(F.col("__sign") > 0, F.col("__upto")).when(F.col("__sign") < 0, F.col("__n") - F.col("__upto")).otherwise(0)
    return e.join(counts, F.col("__v") == F.col("__value"), "left").groupBy(*keys).agg(F.sum(points).alias(out))


def positional_zip(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """The i-th row of left with the i-th row of right, up to the shorter, by the order columns ascending."""
    return numbered(left, [], left_order, "__i").join(numbered(right, [], right_order, "__i"), "__i").drop("__i")


def harmonize_ids(units: DataFrame, unit_id: str, requests: DataFrame, request_id: str, order: str, out: str) -> DataFrame:
    """Unit ids rewritten to the requested ids: requested ids get `_01` if they have no number; a unit id matches a full id or
    its base, the last request in order wins; unknown ids stay."""
    full = requests.select(with_suffix(F.col(request_id)).alias("full"), F.col(order).alias("ord"))
    keys = full.select(base_id(F.col("full")).alias("__key"), "full", "ord").unionByName(full.select(F.col("full").alias("__key"), "full", "ord"))
    last = keys.groupBy("__key").agg(F.max_by("full", "ord").alias("__full"))
    return units.join(last, F.col(unit_id) == F.col("__key"), "left").withColumn(out, F.coalesce("__full", F.col(unit_id))).drop("__key", "__full")
