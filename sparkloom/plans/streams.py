"""Streaming jobs run over the event file to its end. Windows that the watermark hasn't passed are not given out, in the SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.paths import shared_path
from sparkloom.sources.tables import table
from sparkloom.streaming import jobs
from sparkloom.streaming.visits import capped_visits, keyed_state_store

#: Events for each group of users that shares a state.
GROUP_EVENTS = 1 << 14


def _run(spark: SparkSession, sf_dir: str, job, mode: str = "append", batch=None) -> DataFrame:
    stream = job(jobs.event_stream(spark, sf_dir, "events.parquet"))
    return jobs.available(stream, shared_path(spark, "stream"), shared_path(spark, "stream-state"), mode, batch)


@query(
    "stream_tumbling",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP AS began, event_type, count(*) AS n, round(sum(value), 8) AS total FROM events
    GROUP BY 1, 2 HAVING began + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, jobs.tumbling_counts)
    return rows.select(F.col("began").cast("timestamp_ntz").alias("began"), "event_type", "n", F.round("total", 8).alias("total"))


@query(
    "stream_sessions",
    """
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, jobs.session_counts)
    return rows.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("stream_without_repeats", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, lambda e: jobs.without_repeats(e.unionByName(e)).select("event_id", "user_id", "event_type"))


@query(
    "stream_join",
    """
    SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id
    AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, jobs.purchases_with_view)


@query("stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 8) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user."""
    rows = _run(spark, sf_dir, jobs.spending, "update")
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n")))
    return rows.withColumn("_last", last).where("_last = 1").select("user_id", "n", F.round("total", 8).alias("total"))


@query(
    "stream_visits",
    """
    WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
    v AS (
      SELECT user_id, no, ts, value, ts AS began FROM e WHERE no = 1
      UNION ALL
      SELECT e.user_id, e.no, e.ts, e.value, CASE WHEN e.ts - v.ts <= INTERVAL 12 HOUR AND e.ts - v.began <= INTERVAL 1 DAY THEN v.began ELSE e.ts END
      FROM v JOIN e ON e.user_id = v.user_id AND e.no = v.no + 1)
    SELECT user_id, began, max(ts) AS ended, count(*) AS n, round(sum(value), 8) AS total FROM v GROUP BY user_id, began
    HAVING least(max(ts) + INTERVAL 12 HOUR, began + INTERVAL 1 DAY) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a day at most, by keyed state with timers; the file is one micro-batch, so the groups grow with it."""
    groups = max(64, -(-table(spark, sf_dir, "events").count() // GROUP_EVENTS))
    with keyed_state_store(spark):
        rows = _run(spark, sf_dir, lambda e: capped_visits(e, 12 * 3600, 24 * 3600, groups=groups))
    return rows.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n", F.round("total", 8).alias("total"))
