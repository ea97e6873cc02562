"""Task registry, queues and retries as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

#: Delays before each retry in seconds.
RETRY_SECONDS = (60, 120, 180, 300, 600)
ZOMBIE_MINUTES = 30


def latest_state(events: DataFrame, task: str, order: Sequence[str], status: str) -> DataFrame:
    """(task, status, updated_at, attempts) from status changes: the last status; attempts count the IN_FLIGHT marks, but not
    the one that creates the task."""
    key = F.struct(*order)
    marks = F.count_if(F.col(status) == "IN_FLIGHT")
    first = F.min_by(status, key) == "IN_FLIGHT"
    return events.groupBy(task).agg(
        F.max_by(status, key).alias("status"), F.max(order[0]).alias("updated_at"), (marks - F.when(first, 1).otherwise(0)).alias("attempts")
    )


def is_zombie(status: Column, updated_at: Column, now: Column) -> Column:
    return (status == "IN_FLIGHT") & (updated_at < now - F.expr(f"INTERVAL {ZOMBIE_MINUTES} MINUTES"))


def with_readiness(tasks: DataFrame, now: Column) -> DataFrame:
    """tasks with status (TIMEOUT for IN_FLIGHT of over 30 minutes) and ready: whether a worker may take the task."""
    zombie = is_zombie(F.col("status"), F.col("updated_at"), now)
    status = F.when(zombie, "TIMEOUT").otherwise(F.col("status"))
    return tasks.withColumn("status", status).withColumn("ready", F.coalesce(F.col("status").isin("PENDING", "FAILED", "TIMEOUT"), F.lit(True)))


def queue_order(rows: DataFrame, queue: str, head: str, seq: str) -> DataFrame:
    """rows with position (long): those pushed to the head first, the latest of them first, then the others in order. One queue may hold
    all rows. A null head counts as not pushed."""
    pushed = F.coalesce(F.col(head), F.lit(False))
    lane = rows.withColumn("__tail", ~pushed).withColumn("__seq", F.when(pushed, -F.col(seq)).otherwise(F.col(seq)))
    placed = numbered(lane, [queue, "__tail"], ["__seq"], "__position").withColumn("__key", F.struct(queue))
    ahead = rows.groupBy(F.struct(queue).alias("__key")).agg(F.count_if(pushed).alias("__ahead"))
    at = F.col("__position") + F.when(F.col("__tail"), F.col("__ahead")).otherwise(0)
    return placed.join(ahead, "__key").select(*rows.columns, at.alias("position"))


def pause_gate(messages: DataFrame, paused: DataFrame, key: str) -> DataFrame:
    """Messages of collections that are not paused."""
    return messages.join(paused.select(key).distinct(), key, "left_anti")


def retry_schedule(failures: DataFrame, task: str, time: str, tie: str) -> DataFrame:
    """failures with attempt (from 1), delay_s and paused (no delay is left)."""
    n = F.row_number().over(Window.partitionBy(task).orderBy(time, tie))
    delay = F.try_element_at(F.array(*map(F.lit, RETRY_SECONDS)), n)
    return failures.withColumn("attempt", n).withColumn("delay_s", delay).withColumn("paused", delay.isNull())


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output: what is left to do."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def replay_or_submit(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """requests with action: `replay` where a result is done, `resubmit` where it failed, `submit` where there is none."""
    r = results.groupBy(F.col(key).alias("__key")).agg(F.max_by("status", "updated_at").alias("__status"))
    action = F.when(F.col("__status") == "done", "replay").when(F.col("__status").isNotNull(), "resubmit").otherwise("submit")
    return requests.join(r, F.col(key) == F.col("__key"), "left").withColumn("action", action).drop("__key", "__status")


def run_batches(rows: DataFrame, process, schema: str) -> DataFrame:
    """The user's stage function over Arrow batches: pandas frame in, pandas frame out; rows that it leaves out are dropped."""
    return rows.mapInPandas(lambda batches: (process(b) for b in batches), schema)


def last_checkpoint(marks: DataFrame, key: str, stage: str, time: str) -> DataFrame:
    """(key, stage, at): the stage written last for each collection."""
    return marks.groupBy(key).agg(F.max_by(stage, time).alias(stage), F.max(time).alias("at"))


def stage_barrier(totals: DataFrame, completed: DataFrame, queued: DataFrame, key: Sequence[str]) -> DataFrame:
    """totals (key, total) with completed, queued and open: a stage is passed when all of it is completed and nothing is queued."""
    got = totals.join(completed.groupBy(*key).agg(F.count(F.lit(1)).alias("completed")), list(key), "left")
    got = got.join(queued.groupBy(*key).agg(F.count(F.lit(1)).alias("queued")), list(key), "left").fillna(0, ["completed", "queued"])
    return got.withColumn("open", ~((F.col("completed") >= F.col("total")) & (F.col("queued") == 0)))


def control_states(actions: DataFrame, key: str, action: str, time: str) -> DataFrame:
    """(key, status, semaphore) after the actions start, resume, suspend and stop; suspending leaves the status; other actions are none."""
    known = actions.where(F.col(action).isin("start", "resume", "suspend", "stop"))
    status = F.max_by(F.when(F.col(action) == "stop", "stopped").otherwise("running"), F.when(F.col(action) != "suspend", F.col(time)))
    return known.groupBy(key).agg(status.alias("status"), F.when(F.max_by(action, time).isin("start", "resume"), "green").otherwise("red").alias("semaphore"))


def gated(rows: DataFrame, auto_push: bool = False) -> DataFrame:
    """Rows for the next stage: none unless pushing is switched on."""
    return rows if auto_push else rows.limit(0)


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    """tasks, zombies rewritten as TIMEOUT with the time of the reading."""
    zombie = is_zombie(F.col("status"), F.col("updated_at"), now)
    return tasks.withColumns({"updated_at": F.when(zombie, now).otherwise(F.col("updated_at")), "status": F.when(zombie, "TIMEOUT").otherwise(F.col("status"))})
