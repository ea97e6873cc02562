"""Structured Streaming forms: task state, daily counts, deduplication, queue workers.

Each run reads what is there (availableNow), writes Parquet with a checkpoint in the shared folder, and can be started
again on the same folder. Event time needs a timestamp with a zone, so `ts` is cast in the session's zone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What each kind of event does to its task.
STATUS_OF_EVENT = {"signup": "PENDING", "click": "IN_FLIGHT", "error": "FAILED", "purchase": "COMPLETED"}
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a temporary one only on a single machine."""
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    if shared.isDefined():
        return f"{shared.get()}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (file or folder) as a stream, with its own schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(
        schema
    ).option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and read what it wrote."""
    spark, at = stream.sparkSession, work_folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/table")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) for each day that the watermark has closed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("w.start").alias("day"), "event_type", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


class TaskState(StatefulProcessor):
    """The registry: status, attempts and last update of a task; each batch of a task gives its state after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "status string, attempts long, updated_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, updated = self.state.get() if self.state.exists() else (None, 0, 0)
        for r in pd.concat(list(rows)).sort_values(["us", "event_id"]).itertuples(index=False):
            if r.status == "IN_FLIGHT" and status is not None:
                attempts += 1
            status, updated = r.status, int(r.us)
        self.state.update((status, int(attempts), int(updated)))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "attempts": [int(attempts)], "updated_us": [int(updated)]})

    def close(self) -> None:
        pass


class TimedTaskState(TaskState):
    """The registry with a processing-time timer: a task that stays IN_FLIGHT for `timeout_ms` becomes TIMEOUT."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for out in super().handleInputRows(key, rows, timerValues):
            if out["status"].iloc[0] == "IN_FLIGHT":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, _ = self.state.get() if self.state.exists() else (None, 0, 0)
        if status == "IN_FLIGHT":
            now = int(timerValues.getCurrentProcessingTimeInMs()) * 1000
            self.state.update(("TIMEOUT", int(attempts), now))
            yield pd.DataFrame({"user_id": [key[0]], "status": ["TIMEOUT"], "attempts": [int(attempts)], "updated_us": [now]})


def task_states(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """(user_id, status, attempts, updated_us) after each micro-batch in which a task changed; with `timeout_ms` (1,800,000 is the usual half hour) also
    when a task has been in flight for so long. Such a stream has always another batch to run: start it with a processing-time trigger, not with
    `availableNow`."""
    mapping = F.create_map(*[F.lit(v) for item in STATUS_OF_EVENT.items() for v in item])
    changes = events.where(F.col("event_type").isin(*STATUS_OF_EVENT)).select(
        "user_id", "event_id", mapping[F.col("event_type")].alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    return changes.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=TimedTaskState(timeout_ms) if timeout_ms else TaskState(),
        outputStructType="user_id long, status string, attempts long, updated_us long",
        outputMode="Append",
        timeMode="ProcessingTime" if timeout_ms else "None",
    )


def correlated(requests: DataFrame, replies: DataFrame, key: str, wait: str = "20 minutes") -> DataFrame:
    """Requests (key, at, ..) with their replies (key, at, ..) that come within `wait`; a request without one comes out with
    nulls once the watermark has passed its time."""
    q = requests.withWatermark("at", wait).alias("q")
    r = replies.select(F.col(key).alias("reply_key"), F.col("at").alias("reply_at"), *[F.col(c).alias(f"reply_{c}") for c in replies.columns if c not in (key, "at")]).withWatermark("reply_at", wait)
    within = (F.col(key) == F.col("reply_key")) & (F.col("reply_at") >= F.col("at")) & (F.col("reply_at") <= F.col("at") + F.expr(f"INTERVAL {wait}"))
    return q.join(r, within, "leftOuter")


def work_queue(
    messages: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    paused: Callable[[SparkSession], DataFrame],
    out: str,
    quarantine: str,
    key: str,
    pauses: str | None = None,
    checkpoint: str | None = None,
) -> None:
    """A worker: each micro-batch leaves the messages of paused collections for later (they are written to `quarantine` with a reason), runs the
    stage on the rest and appends its rows to `out`.

    With `pauses`, a batch whose stage fails is put back as a whole (into `quarantine`, reason `failed`), a pause of each of its collections (key, reason)
    is appended there, and the worker stops; without, the failure is raised. `resumable` gives what may be taken up again. A
    `checkpoint` folder lets the next worker go on where this one ended."""
    stopped: list[str] = []

    def put_back(rows: DataFrame, reason: str) -> None:
        rows.withColumn("reason", F.lit(reason)).write.mode("append").parquet(quarantine)

    def batch(df: DataFrame, batch_id: int) -> None:
        gate = paused(df.sparkSession).select(key).distinct()
        free = df.join(gate, key, "left_anti")
        put_back(df.join(gate, key, "left_semi"), "paused")
        if stopped:
            put_back(free, "failed")
            return
        try:
            process(free).write.mode("append").parquet(out)
        except Exception as failed:
            if pauses is None:
                raise
            stopped.append(str(failed))
            put_back(free, "failed")
            free.select(key).distinct().withColumn("reason", F.lit(str(failed)[:500])).write.mode("append").parquet(pauses)

    at = checkpoint or f"{work_folder(messages.sparkSession)}/checkpoint"
    messages.writeStream.foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def resumable(held: DataFrame, paused: DataFrame, key: str) -> DataFrame:
    """Messages that were put back and whose collections are no longer paused, as they came."""
    return held.join(paused.select(key).distinct(), key, "left_anti").drop("reason")
