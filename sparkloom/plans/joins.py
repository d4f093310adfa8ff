"""Joins of every kind over the star tables. Which physical join runs is left to the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.asof import asof_join
from sparkloom.operators.ranges import range_join
from sparkloom.operators.skew import hot_key_join, salted_join
from sparkloom.plans.registry import query
from sparkloom.plans.relational import day, net
from sparkloom.sources.tables import table


@query(
    "shipping_priority",
    """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate""",
)
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day("1998-03-15"))
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day("1998-03-15"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(building, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(net()), 4).alias("revenue"))


@query(
    "local_supplier_volume",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(customers, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(net()), 4).alias("revenue"))


@query(
    "left_outer_join",
    """
    SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    AND l_quantity > 45 GROUP BY o_orderkey""",
)
def left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(
    "full_outer_join",
    """
    SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_customers, n_suppliers
    FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    FULL JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey""",
)
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "n_customers", "n_suppliers")


@query(
    "semi_join",
    """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) GROUP BY o_orderpriority""",
)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    rows = table(spark, sf_dir, "orders").join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate")), "left_semi")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("anti_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


@query(
    "theta_join",
    """
    SELECT a.n_nationkey AS a, count(*) AS n_less FROM nation a JOIN nation b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey""",
)
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    rows = a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    return rows.groupBy(F.col("a.n_nationkey").alias("a")).agg(F.count(F.lit(1)).alias("n_less"))


@query(
    "top_per_key",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 3""",
)
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark trims each key to three rows before the shuffle (a window group limit)."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(
    "correlated_subquery",
    """
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l
    WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""",
)
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle: the average is a window over the lines of a part."""
    mean = F.avg("l_quantity").over(W.partitionBy("l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("_mean", mean).where(F.col("l_quantity") < 0.2 * F.col("_mean")).select("l_orderkey", "l_partkey", "l_quantity")


_LAST_VIEW = """
    SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _views_and_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return events.where("event_type = 'purchase'").drop("event_type"), events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))


@query("asof_join", _LAST_VIEW)
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(*_views_and_purchases(spark, sf_dir), "ts", ["user_id"]).select("event_id", "user_id", "view_id")


@query("asof_join_split", _LAST_VIEW)
def last_view_of_busy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a user may have most events: users are split by day."""
    return asof_join(*_views_and_purchases(spark, sf_dir), "ts", ["user_id"], cell=F.to_date("ts")).select("event_id", "user_id", "view_id")


@query("salted_join", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def salted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region's key has five values, each with a fifth of all rows: these are dealt over salts."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey").select("r_regionkey", "o_orderkey")
    return salted_join(facts, table(spark, sf_dir, "region"), "r_regionkey").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_join",
    """
    SELECT a.event_id AS error_id, count(*) AS n FROM events a JOIN events b
    ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY a.event_id""",
)
def purchases_after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    spans = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("low"), (F.col("at") + 600_000_000).alias("high"))
    points = events.where("event_type = 'purchase'").select("at")
    return range_join(points, spans, "at", "low", "high", width=600_000_000).groupBy("error_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hot_key_join",
    """
    SELECT event_id, users, round(value / total, 9) AS share FROM events
    JOIN (SELECT event_type AS t, count(DISTINCT user_id) AS users, sum(value) AS total FROM events GROUP BY event_type) ON t = event_type""",
)
def events_of_their_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with figures of its type; each of the few types holds a fifth of all rows, and is found to be hot."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    types = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.sum("value").alias("total"))
    return hot_key_join(events, types, ["event_type"]).select("event_id", "users", F.round(F.col("value") / F.col("total"), 9).alias("share"))
