"""Scans, aggregates, grouping sets and pivots over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.operators.skew import salted_distinct_count
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

def net() -> Column:
    """Price after discount."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def day(text: str) -> Column:
    """A literal of the tables' timestamp type, so that comparisons reach the Parquet scan."""
    return F.lit(f"{text} 00:00:00").cast("timestamp_ntz")


@query(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
           round(avg(l_discount), 10) AS avg_disc, count(*) AS n_lines
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01 00:00:00'
    GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= day("2001-08-01"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(net()), 4).alias("revenue"),
            F.round(F.avg("l_discount"), 10).alias("avg_disc"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


@query(
    "filter_projection",
    """
    SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def filter_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")))
    rows = rows.where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.select("l_orderkey", "l_partkey", net().alias("net"))


@query(
    "forecast_revenue",
    """
    SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity < 24""",
)
def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(
    "distinct_aggregates",
    """
    SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders,
           min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n
    FROM lineitem GROUP BY l_suppkey""",
)
def distinct_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "having",
    """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey HAVING count(*) > 12""",
)
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.where(F.col("n") > 12)


@query(
    "statistics",
    """
    SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice), 2) AS var,
           round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
           round(corr(o_totalprice, o_custkey), 8) AS r
    FROM orders GROUP BY o_orderpriority""",
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by one aggregate, exact quantiles by two passes: no task holds a priority's orders."""
    p, by = F.col("o_totalprice"), "o_orderpriority"
    orders = table(spark, sf_dir, "orders")
    moments = orders.groupBy(by).agg(F.round(F.stddev_samp(p), 4).alias("sd"), F.round(F.var_pop(p), 2).alias("var"), F.round(F.corr(p, F.col("o_custkey").cast("double")), 8).alias("r"))
    quantiles = exact_quantiles(orders, by, "o_totalprice", {"med": 0.5, "p90": 0.9})
    return moments.join(quantiles, by).select(by, "sd", "var", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"), "r")


@query(
    "filtered_aggregates",
    """
    SELECT event_type, count(*) FILTER (value > 50) AS above, round(sum(value) FILTER (user_id % 2 = 0), 6) AS even_sum,
           max_by(event_id, value) AS top_event, bool_or(value > 99) AS any_99
    FROM events GROUP BY event_type""",
)
def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count_if(v > 50).alias("above"), F.round(F.sum(F.when(F.col("user_id") % 2 == 0, v)), 6).alias("even_sum"), F.max_by("event_id", v).alias("top_event"), F.bool_or(v > 99).alias("any_99"))
    )


@query(
    "grouping_sets",
    """
    SELECT event_type, third, count(*) AS n, (grouping(event_type) * 2 + grouping(third))::BIGINT AS level
    FROM (SELECT event_type, user_id % 3 AS third FROM events)
    GROUP BY GROUPING SETS ((event_type, third), (event_type), ())""",
)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("third"))
    a, b = F.col("event_type"), F.col("third")
    return rows.groupingSets([[a, b], [a], []], a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level")).select("event_type", "third", "n", "level")


@query(
    "rollup",
    """
    SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)""",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pivot",
    """
    SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
           count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""",
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count()
    return rows.fillna(0)


@query(
    "unpivot",
    """
    SELECT p_partkey, 'size' AS measure, p_size::DOUBLE AS value FROM part
    UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
)
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("salted_distinct", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def salted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows each."""
    return salted_distinct_count(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("approximate_distinct")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each supplier status by HyperLogLog sketches that are merged: the estimate is engine-specific, so its error is tested instead."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.hll_sketch_agg("l_partkey", 12).alias("sketch"))
    merged = rows.groupBy("l_returnflag").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("l_returnflag", F.hll_sketch_estimate("sketch").alias("parts"))
