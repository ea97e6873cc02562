"""Validation, flags, JSON salvage and merge folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of roles in merges.
ROLES = {"primary": 3, "secondary": 2, "tactical": 1}


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that do not hold (null counts as not holding)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def flags(tests: Mapping[str, Column]) -> Column:
    """Names of the tests that hold, in order; `OK` if none does."""
    got = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return F.when(F.size(got) == 0, F.array(F.lit("OK"))).otherwise(got)


def quarantine(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with a `violations` column)."""
    marked = df.withColumn("violations", violations(checks))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def filled(*columns: str) -> Column:
    """Whether none of the columns is null or empty."""
    return reduce(and_, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in columns])


def input_checks(payload: Column) -> dict[str, Column]:
    """Checks of a stage's JSON input by name: it has entities and relations, a block and a collection under one of their two names."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    has = lambda *names: reduce(or_, [F.array_contains(keys, n) for n in names])
    return {"entities": has("entities"), "relations": has("relations"), "block_id": has("block_id", "chunk_label"), "project_id": has("project_id", "book_id")}


def member_counts(payload: Column, *names: str) -> list[Column]:
    """`{name}_count` for each list of a JSON object; 0 where it is missing."""
    return [F.coalesce(F.json_array_length(F.get_json_object(payload, f"$.{n}")), F.lit(0)).alias(f"{n}_count") for n in names]


def severities(flagged: DataFrame, flags_col: str, critical: Sequence[str]) -> DataFrame:
    """(flag, n, critical): how often each flag but `OK` stands, and whether it is a critical one."""
    rows = flagged.select(F.explode(flags_col).alias("flag")).where("flag <> 'OK'")
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).withColumn("critical", F.col("flag").isin(*critical))


def any_filled(*arrays: str) -> Column:
    """Whether any of the arrays holds something."""
    return sum((F.coalesce(F.size(a), F.lit(0)) for a in arrays), F.lit(0)) > 0


def salvage_json(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """df with `parsed` and `broken`: the first JSON object in a text that may have fences and prose around it. One bad field
    makes the whole record broken."""
    body = F.regexp_extract(payload, "(?s)(\\{.*)", 1)
    parsed = F.from_json(body, f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    got = df.withColumn("__p", parsed)
    broken = F.col("__p").isNull() | F.col("__p._corrupt_record").isNotNull() | (body == "")
    return got.withColumn("broken", F.coalesce(broken, F.lit(True))).withColumn("parsed", F.when(~F.col("broken"), F.col("__p"))).drop("__p")


def salvage_json_list(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """df with `parsed` (array of records) and `broken`: whichever of `[` and `{` comes first; an object counts as a list of one."""
    first = F.regexp_extract(payload, "(?s)^[^\\[{]*([\\[{].*)", 1)
    many = F.from_json(first, f"array<struct<{schema}>>")
    one = F.from_json(first, f"struct<{schema}>")
    parsed = F.when(F.startswith(first, F.lit("[")), many).when(F.startswith(first, F.lit("{")), F.array(one))
    return df.withColumn("parsed", parsed).withColumn("broken", F.col("parsed").isNull())


def between_fences(x: Column) -> Column:
    """What stands between the first pair of code fences, or the text itself."""
    inner = F.regexp_extract(x, "(?s)```(?:json)?\\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(x), "^\\s+|\\s+$", "")


def merge_sections(rows: DataFrame, keys: Sequence[str], name: str, order: str) -> DataFrame:
    """keys, name, ord, section_id: first appearance of each trimmed lower-case name, renumbered `001` on."""
    clean = F.trim(F.lower(F.col(name)))
    first = rows.where(F.coalesce(clean, F.lit("")) != "").groupBy(*keys, clean.alias("name")).agg(F.min(order).alias("ord"))
    w = Window.partitionBy(*keys).orderBy("ord")
    return first.withColumn("section_id", F.format_string("%03d", F.row_number().over(w)))


def best_record(rows: DataFrame, keys: Sequence[str], order: str, score: str, role: str) -> DataFrame:
    """One record for each key: in order, a strictly higher score replaces the record but keeps the better role so far; a record
    of a lower score never changes the role.

    As a window this is: running maxima of the score mark the replacements, and the result is the last replacement with the
    best role among all replacements.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(score).over(w)
    taken = rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(score) > F.col("__before"))).drop("__before")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for item in ROLES.items() for v in item]), F.col(role)), F.lit(0))
    rest = [c for c in rows.columns if c not in (*keys, role)]
    got = taken.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.max_by(role, F.struct(rank, -F.col(order))).alias(role))
    return got.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], role)


def missing_members(have: Column, wanted: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(x) for x in wanted]), have)
