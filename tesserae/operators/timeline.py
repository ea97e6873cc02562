"""Timelines: running offsets, roll-ups, section marks, arcs and cue placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import forward_fill, running_before, with_islands

#: Volumes in decibels, ducking depths in decibels and fades in milliseconds.
VOLUMES = {"ambient": -28.0, "spot": -12.0, "accent": -6.0, "motif": -10.0}
DUCK_DEPTH = {"none": 0.0, "light": -8.0, "shallow": -8.0, "medium": -14.0, "deep": -20.0, "heavy": -20.0}
FADE_MS = {"instant": 30, "snap": 30, "sharp": 60, "smooth": 180, "slow": 400}


def offsets(units: DataFrame, keys: Sequence[str], order: Sequence[str], voice: str, pause: str) -> DataFrame:
    """units with start_offset (all earlier voice and pause) and total_time."""
    total = F.col(voice) + F.col(pause)
    return units.withColumn("start_offset", running_before(total, keys, order)).withColumn("total_time", total)


def roll_up(units: DataFrame, levels: Sequence[str], start: str, total: str) -> DataFrame:
    """first start and summed time for each level of the hierarchy and overall, with `level` = number of keys given."""
    got = units.rollup(*levels).agg(F.min(start).alias("first_start"), F.sum(total).alias("total_time"), F.grouping_id().alias("gid"))
    return got.withColumn("level", F.lit(len(levels)) - F.bit_count(F.col("gid"))).drop("gid")


def section_marks(units: DataFrame, keys: Sequence[str], order: Sequence[str], section: str, duration_ms: str, first: str = "chapter_001", pause_ms: str | None = None) -> DataFrame:
    """keys, mark, section, start_ms, end_ms: a mark for each run of units of one section; unknown sections go on with the
    previous one. Pauses count only if their column is named."""
    length = F.col(duration_ms) + (F.coalesce(F.col(pause_ms), F.lit(0)) if pause_ms else F.lit(0))
    filled = units.withColumn("__section", forward_fill(F.col(section), F.lit(first), keys, order)).withColumn("__ms", length.cast("bigint"))
    placed = filled.withColumn("__start", running_before(F.col("__ms"), keys, order))
    runs = with_islands(placed, "__section", keys, order, "mark")
    return runs.groupBy(*keys, "mark").agg(
        F.first("__section").alias("section"), F.min("__start").cast("bigint").alias("start_ms"), F.max(F.col("__start") + F.col("__ms")).cast("bigint").alias("end_ms")
    )


def arc_tags(segments: DataFrame, keys: Sequence[str], order: Sequence[str], intensity: str) -> DataFrame:
    """segments with tag: Intro for the first, Outro for the last, Pre-Chorus for a mid one before a high one, none for low ones, Chorus for high ones, else Verse."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    level = F.coalesce(F.col(intensity), F.lit("mid"))
    tag = (
        F.when(F.row_number().over(w) == 1, "Intro")
        .when(F.row_number().over(w) == n, "Outro")
        .when((level == "mid") & (F.lead(level).over(w) == "high"), "Pre-Chorus")
        .when(level == "high", "Chorus")
        .when(level != "low", "Verse")
    )
    return segments.withColumn("tag", tag)


def placement(kind: Column, timing: Column, start: Column, voice: Column, length: Column, offset: Column) -> Column:
    """Second at which a cue begins, by its kind and timing word; a word that is not known means the unit's start."""
    zero = F.lit(0.0)
    spot = F.when(timing == "middle", start + voice / 2).when(timing == "end", start + voice - length).otherwise(start)
    accent = F.when(timing == "end", start + voice).when(timing == "middle", start + voice / 2).otherwise(start)
    motif = F.when(timing == "end", F.greatest(zero, start + voice - length / 2)).when(timing == "middle", start + voice / 2).otherwise(start)
    return F.when(kind == "ambient", start + offset).when(kind == "spot", F.greatest(zero, spot + offset)).when(kind == "accent", accent).when(kind == "motif", motif)


def duck_depth(word: Column) -> Column:
    """Decibels for a depth word; -14 for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for x in DUCK_DEPTH.items() for v in x]), word), F.lit(-14.0))


def fade_ms(word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for x in FADE_MS.items() for v in x]), word), F.lit(180))
