"""Queues as Spark sources and sinks: messages with a sequence number, at the tail or the head, and a data source that reads them.

Spark reads a queue without removing what it reads; its checkpoint keeps the position, so each message is processed exactly
once for each checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "queue STRING, seq BIGINT, head BOOLEAN, payload STRING"


def push(spark: SparkSession, path: str, rows: DataFrame, head: bool = False) -> None:
    """Append (queue, seq, payload) rows, to be taken before all others if `head`."""
    rows.select("queue", F.col("seq").cast("bigint").alias("seq"), F.lit(head).alias("head"), "payload").write.mode("append").parquet(path)


def peek(spark: SparkSession, path: str, queue: str) -> DataFrame:
    """Messages of one queue with their positions from 1."""
    from ..operators.tasks import queue_order

    return queue_order(spark.read.schema(SCHEMA).parquet(path).where(F.col("queue") == queue), "queue", "head", "seq")


def parse(messages: DataFrame, schema: str) -> DataFrame:
    """Payloads as columns; payloads that do not parse are in `_corrupt_record`."""
    got = messages.withColumn("p", F.from_json("payload", f"{schema}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return got.select("queue", "seq", "p.*")


class QueueSource(DataSource):
    """`spark.read.format("json_queue").option("messages", "[...]")`: a queue given as a JSON list, in order, for tests and small
    control messages; also as a stream of `per_batch` messages at a time."""

    @classmethod
    def name(cls) -> str:
        return "json_queue"

    def schema(self) -> str:
        return "seq BIGINT, payload STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def _messages(options: dict) -> list[str]:
    return [json.dumps(m) for m in json.loads(options.get("messages", "[]"))]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from enumerate(_messages(self.options))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.rows, self.step = _messages(options), int(options.get("per_batch", "100"))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["at"] + self.step, len(self.rows))
        return iter([(k, self.rows[k]) for k in range(start["at"], end)]), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k, self.rows[k]) for k in range(start["at"], end["at"])])

    def commit(self, end: dict) -> None:
        pass
