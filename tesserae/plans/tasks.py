"""Queries over events as task changes and queue messages, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import tasks as K
from ..session import table
from ..streaming import tasks as S

STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'IN_FLIGHT' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' END"
LATEST_SQL = f"""c AS (SELECT user_id, event_id, ts, {STATUS_SQL} AS status FROM events WHERE event_type <> 'view'),
  t AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) FILTER (status = 'IN_FLIGHT') - CASE WHEN arg_min(status, (ts, event_id)) = 'IN_FLIGHT' THEN 1 ELSE 0 END AS attempts FROM c GROUP BY user_id)"""


def changes(spark, sf_dir):
    mapping = F.create_map(*[F.lit(v) for item in S.STATUS_OF_EVENT.items() for v in item])
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*S.STATUS_OF_EVENT))
    return e.select("user_id", "event_id", "ts", mapping[F.col("event_type")].alias("status"))


@query("task_latest_state", f"WITH {LATEST_SQL} SELECT user_id, status, attempts FROM t")
def task_latest_state(spark, sf_dir):
    return K.latest_state(changes(spark, sf_dir), "user_id", ["ts", "event_id"], "status").select("user_id", "status", "attempts")


@query("zombie_tasks", f"""WITH {LATEST_SQL} SELECT user_id, CASE WHEN status = 'IN_FLIGHT' AND updated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 MINUTE THEN 'TIMEOUT' ELSE status END AS status,
  status IN ('PENDING', 'FAILED') OR (status = 'IN_FLIGHT' AND updated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 MINUTE) AS ready FROM t""")
def zombie_tasks(spark, sf_dir):
    latest = K.latest_state(changes(spark, sf_dir), "user_id", ["ts", "event_id"], "status")
    return K.with_readiness(latest, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).select("user_id", "status", "ready")


@query("queue_order", """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY (value > 90) DESC, CASE WHEN value > 90 THEN -event_id ELSE event_id END) AS position FROM events""")
def queue_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("head", F.col("value") > 90)
    return K.queue_order(e, "event_type", "head", "event_id").select("event_id", "position")


@query("retry_schedule", """WITH r AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events WHERE event_type = 'error')
  SELECT event_id, attempt, CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 120 WHEN 3 THEN 180 WHEN 4 THEN 300 WHEN 5 THEN 600 END AS delay_s, attempt > 5 AS paused FROM r""")
def retry_schedule(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return K.retry_schedule(errors, "user_id", "ts", "event_id").select("event_id", "attempt", "delay_s", "paused")


@query("pause_gate", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def pause_gate(spark, sf_dir):
    paused = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return K.pause_gate(table(spark, sf_dir, "events").select("event_id", "user_id"), paused, "user_id")


@query("queue_purge", "SELECT event_id FROM events WHERE NOT (user_id % 10 = 3)")
def queue_purge(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~(F.col("user_id") % 10 == 3)).select("event_id")


@query("registry_reset", "SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '7$|#0000001')")
def registry_reset(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(~F.col("c_name").rlike("7$|#0000001")).select("c_custkey", "c_name")


@query("mailbox_replay", """WITH r AS (SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END, (ts, event_id)) AS status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
  SELECT c_custkey, CASE status WHEN 'done' THEN 'replay' WHEN 'error' THEN 'resubmit' ELSE 'submit' END AS action FROM customer LEFT JOIN r ON c_custkey = user_id""")
def mailbox_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    results = e.select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "purchase", "done").otherwise("error").alias("status"), F.struct("ts", "event_id").alias("updated_at"))
    return K.replay_or_submit(table(spark, sf_dir, "customer").select("c_custkey"), results, "c_custkey")


@query("fresh_heartbeats", """SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) < 86400 AS alive FROM events GROUP BY user_id""")
def fresh_heartbeats(spark, sf_dir):
    micros = F.unix_micros(F.max(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(((F.lit(1706659200000000) - micros) / 1e6 < 86400).alias("alive"))


@query("stream_task_state", f"WITH {LATEST_SQL} SELECT user_id, status, attempts FROM t")
def stream_task_state(spark, sf_dir):
    """The state machine as a stream; its last word for each task equals the batch fold."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    written = S.run_to_table(S.task_states(S.read_stream(session, f"{sf_dir}/events.parquet")))
    last = written.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("updated_us", "attempts")).alias("s"))
    return last.select("user_id", "s.status", "s.attempts")


@query("stream_daily_counts", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_daily_counts(spark, sf_dir):
    return S.run_to_table(S.daily_counts(S.read_stream(spark, f"{sf_dir}/events.parquet")))


@query("stream_deduplicated")
def stream_deduplicated(spark, sf_dir):
    got = S.run_to_table(S.deduplicated(S.read_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "1 hour"))
    return got.select("event_id", "user_id", "event_type")


@query("stream_correlated", """SELECT q.event_id, r.event_id AS reply_event_id FROM events q JOIN events r ON q.user_id = r.user_id AND q.event_type = 'click' AND r.event_type = 'purchase' AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 20 MINUTE""")
def stream_correlated(spark, sf_dir):
    """Clicks and the purchases of the same user within 20 minutes, as a stream-stream join."""
    e = S.read_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    got = S.correlated(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), "user_id")
    return S.run_to_table(got).where("reply_event_id IS NOT NULL").select("event_id", "reply_event_id")
