"""Stored states: aggregates under corrections, bitmaps, histories, layouts, sketches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.bitmaps import bitmap_table, distinct_by
from sparkloom.operators.maintained import MaintainedAggregate
from sparkloom.operators.sketches import frequent_items, sketch_table
from sparkloom.operators.versions import history, temporal_join
from sparkloom.plans.registry import query
from sparkloom.sources.layout import read_by_curve, write_by_curve
from sparkloom.sources.paths import shared_path
from sparkloom.sources.tables import table


@query(
    "maintained_aggregate",
    """
    SELECT o_orderpriority, count(*) AS n, sum(price)::DOUBLE AS total, min(price)::DOUBLE AS least, max(price)::DOUBLE AS greatest, count(DISTINCT price) AS distinct_values
    FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 3 THEN (o_totalprice + 100)::DECIMAL(20, 2) ELSE o_totalprice::DECIMAL(20, 2) END AS price FROM orders WHERE o_orderstatus <> 'P')
    GROUP BY o_orderpriority""",
)
def maintained_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders come in three batches, a seventh is corrected, pending ones go, and two batches come twice, one of them after a compaction."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    kept = MaintainedAggregate(spark, shared_path(spark, "maintained"), ["o_orderpriority"], "price", "decimal(20,2)")
    came = lambda n: orders.where(F.col("o_orderkey") % 3 == n).withColumn("sign", F.lit(1))
    wrong = orders.where("o_orderkey % 7 = 3")
    right = wrong.withColumn("price", (F.col("price") + 100).cast("decimal(20,2)"))
    kept.apply(1, came(0))
    kept.apply(2, came(1))
    kept.apply(2, came(1))
    kept.compact()
    kept.apply(1, came(0))
    kept.apply(3, came(2))
    kept.apply(4, wrong.withColumn("sign", F.lit(-1)).unionByName(right.withColumn("sign", F.lit(1))))
    now = orders.where("o_orderkey % 7 <> 3").unionByName(right)
    kept.apply(5, now.where("o_orderstatus = 'P'").withColumn("sign", F.lit(-1)))
    found = kept.result()
    return found.select("o_orderpriority", "n", *[F.col(c).cast("double").alias(c) for c in ("total", "least", "greatest")], "distinct_values")


@query(
    "bitmap_cube",
    """
    SELECT event_type, date_trunc('week', ts)::DATE AS week, value > 50 AS large, count(DISTINCT user_id) AS users
    FROM events GROUP BY CUBE (1, 2, 3)""",
)
def bitmap_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users over every subset of three dimensions, from bitmaps that are stored once."""
    dims = ["event_type", "week", "large"]
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("week", "ts").cast("date").alias("week"), (F.col("value") > 50).alias("large"))
    path = shared_path(spark, "bitmaps")
    bitmap_table(events, dims, "user_id").write.parquet(path)
    sets = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(8)]
    return distinct_by(spark.read.parquet(path), dims, sets, "users").drop("grouped")


@query(
    "temporal_join",
    """
    WITH c AS (SELECT user_id, ts, event_id, event_type AS mode, CASE WHEN value >= 60 THEN 'high' WHEN value >= 10 THEN 'low' END AS band FROM events),
    m AS (SELECT user_id, mode, ts AS since FROM (SELECT *, lag(mode) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM c) WHERE prior IS DISTINCT FROM mode),
    b AS (SELECT user_id, band, ts AS since FROM (SELECT *, lag(band) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM c) WHERE no = 1 OR prior IS DISTINCT FROM band),
    m2 AS (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY since) AS until FROM m),
    b2 AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY since) AS until FROM b) WHERE band IS NOT NULL)
    SELECT m2.user_id, mode, band, greatest(m2.since, b2.since) AS since, least(m2.until, b2.until) AS until
    FROM m2 JOIN b2 ON m2.user_id = b2.user_id AND (b2.until IS NULL OR m2.since < b2.until) AND (m2.until IS NULL OR b2.since < m2.until)""",
)
def temporal_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histories of each user, what they last did and how large its value was, cut against each other."""
    events = table(spark, sf_dir, "events").withColumn("band", F.when(F.col("value") >= 60, "high").when(F.col("value") >= 10, "low"))
    modes = history(events.withColumnRenamed("event_type", "mode"), ["user_id"], "ts", ["mode"], ["event_id"])
    bands = history(events, ["user_id"], "ts", ["band"], ["event_id"])
    return temporal_join(modes, bands, ["user_id"]).select("user_id", "mode", "band", "since", "until")


@query(
    "curve_layout",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND l_extendedprice BETWEEN 20000 AND 26000""",
)
def curve_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on two columns of a table that is laid out for both: about a tenth of the files are opened."""
    path = shared_path(spark, "curve")
    write_by_curve(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"), path, ["l_shipdate", "l_extendedprice"], files=64)
    return read_by_curve(spark, path, {"l_shipdate": (dt.datetime(1997, 1, 1), dt.datetime(1997, 6, 30)), "l_extendedprice": (20000.0, 26000.0)})


@query(
    "frequent_items",
    """
    SELECT l_returnflag, l_partkey, count(*) AS rows FROM lineitem JOIN (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1) ON f = l_returnflag
    GROUP BY l_returnflag, l_partkey HAVING count(*) > 0.0008 * any_value(n)""",
)
def frequent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with more than 0.08 % of the lines of their flag: candidates from sketches stored by flag and year, counted exactly."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice", F.year("l_shipdate").alias("year"))
    path = shared_path(spark, "sketches")
    sketch_table(lines, ["l_returnflag", "year"], "l_partkey", "l_extendedprice", 0.0008).write.parquet(path)
    return frequent_items(spark.read.parquet(path), lines, ["l_returnflag"], "l_partkey", 0.0008)
