"""Order-aware operators: first wins, latest, forward fill, islands, sessions, as-of, running sums.

Spark rows have no order of their own, so each takes an explicit order. Keys with very many rows: aggregations use
min_by/max_by over structs (combined before the shuffle) where the rule allows it, windows only where it does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, null keys forming a key. Pre-aggregated: a hot key is never gathered."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    cols = [c for c in df.columns]
    return df.groupBy(*keys).agg(best.alias("__best")).select(*[F.col(c) if c in keys and c not in order else F.col(f"__best.{c}") for c in cols])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*[F.col(c) if c in keys and c not in order else F.col(f"__best.{c}") for c in df.columns])


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


#: Rows that one task numbers by sorting them.
ROWS_PER_BUCKET = 8192
#: Quantiles of an order column at which its rows can be cut.
QUANTILES = 1024


def _as_number(df: DataFrame, name: str) -> Column:
    """A double that never falls as the column rises: numbers and times as they are, strings by their first six bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, K.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, K.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, K.TimestampNTZType):  # to the second; a cast would pass through the session's time zone
        return F.unix_date(F.col(name).cast("date")) * 86400.0 + F.hour(name) * 3600 + F.minute(name) * 60 + F.second(name)
    if isinstance(kind, K.TimestampType):
        return F.unix_micros(name).cast("double")
    return F.col(name).cast("double")


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value that is never null, so that null keys meet in a plain equi-join."""
    return F.struct(*keys) if keys else F.lit(0)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds each row's position (long, from 1) within its keys by `order` (columns, ascending, nulls first; null keys are a key).

    A key may hold any share of the rows: the range of the first order column is cut into equal buckets, a bucket's rows are
    sorted in a task of their own, and the buckets' counts are added up apart. Values of that column that very many rows share
    stay together. Positions of rows that are equal in `order` are arbitrary among them.
    """
    x = _as_number(df, order[0])
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    rows, low, high = df.agg(F.count(F.lit(1)), F.min(finite), F.max(finite)).first()
    n = max(1, -(-rows // rows_per_bucket))
    width = ((high - low) / n if low is not None else 0) or 1.0
    at = F.floor(F.greatest(F.least((x - F.lit(low or 0.0)) / F.lit(width), F.lit(float(n - 1))), F.lit(0.0)))
    b = df.withColumn("__bucket", F.when(x.isNull(), -1).otherwise(at).cast("long")).withColumn("__key", _key(keys))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__key", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = b.withColumn("__inner", F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(*order)))
    return inside.join(starts, ["__key", "__bucket"]).select(*df.columns, (F.col("__start") + F.col("__inner")).alias(out))


def quantile_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, out: str) -> DataFrame:
    """Adds the number (long, from 1) of the row's part among `parts` parts of its keys, equal but for one row, the larger ones first."""
    placed = numbered(df, keys, order, "__at").withColumn("__key", _key(keys))
    sizes = df.groupBy(_key(keys).alias("__key")).agg(F.count(F.lit(1)).alias("__size"))
    q, r, at = F.floor(F.col("__size") / parts), F.col("__size") % parts, F.col("__at")
    part = F.when(at <= r * (q + 1), F.ceil(at / (q + 1))).otherwise(r + F.ceil((at - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return placed.join(sizes, "__key").select(*df.columns, part.cast("long").alias(out))


def dense_ranked(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the rank (long, from 1, nulls first) of the row's value among the distinct values of its keys, which are found before anything is sorted."""
    ranks = numbered(df.select(*keys, value).distinct(), keys, [value], out).select(_key([*keys, value]).alias("__key"), out)
    return df.withColumn("__key", _key([*keys, value])).join(ranks, "__key").select(*df.columns, out)


def summed_up_to(df: DataFrame, by: str, value: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the sum of `value` over all rows whose `by` is at most the row's. `by` has to be distinct and not null.

    The rows are cut at quantiles of `by` into buckets of about `rows_per_bucket`, at most QUANTILES of them, whatever the distribution; a bucket is
    summed in a task of its own, and the buckets' sums are added up apart. The quantiles are approximate, the sums do not depend on them.
    """
    x = _as_number(df, by)
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    rows, found = df.agg(F.count(F.lit(1)), F.percentile_approx(finite, [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES)).first()
    n = min(QUANTILES, max(1, -(-rows // rows_per_bucket)))
    cuts = sorted({found[i * QUANTILES // n - 1] for i in range(1, n)}) if found else []
    b = df.withColumn("__bucket", _cuts_up_to(x, cuts))
    totals = b.groupBy("__bucket").agg(F.sum(value).alias("__total")).withColumn("__all", F.lit(0))
    before = Window.partitionBy("__all").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = b.withColumn("__inner", F.sum(value).over(Window.partitionBy("__bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(starts, "__bucket").select(*df.columns, (F.col("__start") + F.col("__inner")).alias(out))


def _cuts_up_to(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts are at most x, by binary search."""
    if not cuts:
        return F.lit(0)
    at = F.lit(cuts)
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.try_element_at(at, n + step) <= x, n + step).otherwise(n))


def running_before(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Sum of the value over all earlier rows of the key; 0 for the first."""
    return F.coalesce(F.sum(value).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def next_or(value: Column, default: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.coalesce(F.lead(value).over(_window(keys, order)), default)


def forward_fill(value: Column, default: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last known value, the default before the first."""
    filled = F.last(value, ignorenulls=True).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(filled, default)


def with_islands(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "island") -> DataFrame:
    """Adds the number of the run of equal values, from 0; a value that comes again later starts a new run."""
    w = _window(keys, order)
    changed = df.withColumn("__change", F.when((F.row_number().over(w) > 1) & F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    return changed.withColumn(out, F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__change")


def marker_session(marker: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Number of markers met so far: 0 before the first."""
    return F.sum(F.when(marker, 1).otherwise(0)).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def keep_first_non_null(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Only the first non-null value of each key survives; later ones become null."""
    seen = F.count(value).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(seen == 1, value)


def gap_to_next(start: Column, end: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lead(start).over(_window(keys, order)) - end


def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], ties: str) -> DataFrame:
    """left and, for each row, the `values` of the last row of right of the same keys at or before it (null if none).

    One shuffle: both sides are stacked and the last right row is carried forward; `ties` orders left rows of one time.
    """
    l = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.col(ties).alias("__tie"))  # noqa: E741
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__carried"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__carried", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select(*left.columns, *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def fold_budget(sizes: Column, limit: int) -> Column:
    """Block number of each element of an array of sizes: a new block starts when the sum would pass the limit and the block is
    not empty."""

    def step(acc: Column, size: Column) -> Column:
        fresh = (acc["filled"] > 0) & (acc["total"] + size > limit)
        block = F.when(fresh, acc["block"] + 1).otherwise(acc["block"])
        return F.struct(
            block.alias("block"),
            F.when(fresh, size).otherwise(acc["total"] + size).alias("total"),
            F.when(fresh, 1).otherwise(acc["filled"] + 1).alias("filled"),
            F.array_append(acc["out"], block).alias("out"),
        )

    start = F.struct(F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])
