"""Window functions: ranking, neighbours, frames by rows and by time, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "ranking",
    """
    SELECT p_partkey, p_brand, rank() OVER w AS r, dense_rank() OVER w AS d,
           round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query(
    "tiles",
    """
    SELECT o_orderkey, ntile(4) OVER w AS quarter, first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER w AS second_key
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""",
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.first("o_orderkey").over(w).alias("first_key"), F.nth_value("o_orderkey", 2).over(w).alias("second_key"))


@query(
    "neighbours",
    """
    SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after,
           date_diff('microsecond', lag(ts) OVER w, ts) AS gap
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"), (at - F.lag(at).over(w)).alias("gap"))


@query(
    "frames",
    """
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 8) AS running,
           round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 10) AS smooth,
           count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day
    FROM events""",
)
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("user_id")
    rows = by.orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day = by.orderBy(at).rangeBetween(-86_400_000_000, 0)
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.sum(v).over(rows.rowsBetween(W.unboundedPreceding, 0)), 8).alias("running"),
        F.round(F.avg(v).over(rows.rowsBetween(-2, 2)), 10).alias("smooth"),
        F.count(F.lit(1)).over(day).alias("last_day"),
    )


@query(
    "sessions",
    """
    SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (
      SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, session""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query(
    "tumbling_windows",
    """
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS began, event_type, count(*) AS n, round(sum(value), 8) AS total
    FROM events GROUP BY 1, 2""",
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 8).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "total")


@query(
    "gap_fill",
    """
    WITH d AS (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY)) AS day FROM (SELECT min(date_trunc('day', ts))::TIMESTAMP AS low, max(date_trunc('day', ts))::TIMESTAMP AS high FROM events)),
    c AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND user_id < 3 GROUP BY 1)
    SELECT d.day::TIMESTAMP AS day, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY d.day)::BIGINT AS so_far FROM d LEFT JOIN c ON c.day = d.day""",
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day that the table spans: the last window runs over one row a day."""
    events = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    days = events.agg(F.min(day).alias("low"), F.max(day).alias("high")).select(F.explode(F.expr("sequence(low, high, interval 1 day)")).alias("day"))
    errors = events.where("event_type = 'error' AND user_id < 3").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = days.join(errors, F.col("day") == F.col("at"), "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("so_far", F.sum("n").over(W.orderBy("day")))
