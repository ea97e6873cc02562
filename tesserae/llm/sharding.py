"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together; sorted by size, each goes to the least-loaded shard through a heap. Groups of one size are
interchangeable, so the driver needs only how many groups each size has: all groups of a size are placed at once,
as the heap would place them one by one. There are at most sqrt(2 * bytes) different sizes, however the texts are spread (their sum is at
most the total), and in practice about as many as there are lengths of texts. Groups find their shard by
their distributed rank among the groups of their size.

Null text has size 8 and checksum 0 and groups with other nulls only. Repeated rows count each. Rows with a null id are
sharded like others. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, files_for, grouped_prefix


class Schedule:
    """Longest processing time over a histogram (size, number of groups) onto n_shards.

    Groups are numbered through all sizes, largest size first; `starts` and `shards` are the intervals of these numbers."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, n_shards: int):
        order = np.argsort(-sizes, kind="stable")
        self.sizes, counts = -sizes[order], counts[order]  # ascending, for searching
        self.first = np.cumsum(counts) - counts
        heap = [(0, s) for s in range(n_shards)]
        starts, shards = [], []
        for size, n, at in zip((-self.sizes).tolist(), counts.tolist(), self.first.tolist(), strict=True):
            dealt = [0] * n_shards
            if n > 2 * n_shards:
                # the heap pops the n smallest of load + k * size: all below the level that does not yet use up n come first
                loads, low, high = [load for load, _ in sorted(heap, key=lambda x: x[1])], 0, max(heap)[0] + size * n + 1
                below = lambda level, loads=loads, size=size: [max(0, -((load - level) // size)) for load in loads]
                while high - low > 1:
                    level = (low + high) // 2
                    low, high = (level, high) if sum(below(level)) <= n else (low, level)
                dealt = below(low)
                heap = [(load + k * size, s) for s, (load, k) in enumerate(zip(loads, dealt, strict=True))]
                heapq.heapify(heap)
            for _ in range(n - sum(dealt)):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                dealt[shard] += 1
            for shard, k in enumerate(dealt):
                if k:
                    starts.append(at)
                    shards.append(shard)
                    at += k
        self.starts, self.shards = np.array(starts, np.int64), np.array(shards, np.int32)
        self.loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]

    def find(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The shard of the rank-th group of each size."""
        number = self.first[np.searchsorted(self.sizes, -size)] + rank
        return self.shards[np.searchsorted(self.starts, number, "right") - 1]


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row; the law is `bytes`."""
    text, n_rows = F.col(text_col).cast("string"), docs.count()
    files = files_for(n_rows, 100_000, 24)
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("text_key"),
        ),
        files,
    )
    groups = durable(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).withColumn("key", F.xxhash64("text_key")), files)
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    plan = Schedule(histogram.column("bytes").to_numpy(), histogram.column("n").to_numpy(), n_shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = plan.find(batch.column("bytes").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(shard)], names=["text_key", "shard"])

    ranked = grouped_prefix(groups, "bytes", "key", ["text_key"], F.lit(1), "rank", groups.count())
    placed = durable(ranked.select("text_key", "bytes", F.col("rank").cast("long").alias("rank")).mapInArrow(place, "text_key binary, shard int"), files)
    put = rows.join(placed, "text_key").select("id", "size", "text_crc32", "shard", F.xxhash64("id", "text_key").alias("key"))
    return grouped_prefix(put, "shard", "key", ["id", "text_crc32"], F.lit(1), "slot", n_rows).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
