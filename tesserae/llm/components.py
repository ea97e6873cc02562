"""Connected components of a distributed link list, by alternating large-star and small-star rounds.

Each round takes one minimum per node (combined before the shuffle) and joins the link list with these minima. Those of the large star,
where a node can have very many links, are written first, so the join is a plain join of two tables: adaptive execution broadcasts a small one and splits the links of
such a node. Rounds end when the links no longer change; the files of a finished round are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, files_for, release


def _large_star(e: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """e: links (a > b). Every neighbour of u that is larger than u is linked to the smallest node around u. (links, minima)"""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), files)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(e: DataFrame) -> DataFrame:
    """e: links (a > b). Every smaller neighbour of a, and a itself, is linked to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    out = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges: (a long, b long), any direction, repeats and loops allowed, nulls ignored. most: about how many there are at most, if known.

    Returns (node, root) for every node that is not the smallest of its component. No edges: no rows.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most and files_for(most))
    state = _state(e)
    while state[0]:
        files = files_for(state[0])  # the number of links never grows
        large, least = _large_star(e, files)
        large = durable(large, files)
        new_e = durable(_small_star(large), files)
        release(e, least, large)
        e, new = new_e, _state(new_e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
