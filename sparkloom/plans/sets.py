"""Set operations, sorting, limits and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.reach import reachable
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"))
    return c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))


_C, _S = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS nation FROM supplier"


@query("union_distinct", f"{_C} UNION {_S}")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query("union_all", f"{_C} UNION ALL {_S}")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b)


@query("intersect", f"{_C} INTERSECT {_S}")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("intersect_all", f"{_C} INTERSECT ALL {_S}")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersectAll(b)


@query("except_distinct", f"{_C} EXCEPT {_S}")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.subtract(b)


@query("except_all", f"{_C} EXCEPT ALL {_S}")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.exceptAll(b)


@query("top_k", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit over a sort: each task keeps its first hundred."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey").limit(100)


@query("offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(40).limit(20)


@query(
    "recursive",
    """
    WITH RECURSIVE e AS (SELECT l_orderkey * 2 AS o, l_partkey * 2 + 1 AS p FROM lineitem WHERE l_quantity >= 47),
    t(node, steps) AS (
      SELECT DISTINCT p, 0 FROM e WHERE p < 40
      UNION
      SELECT x.b, t.steps + 1 FROM t JOIN (SELECT o AS a, p AS b FROM e UNION ALL SELECT p, o FROM e) x ON x.a = t.node WHERE t.steps < 12)
    SELECT (node - 1) // 2 AS part, (min(steps) // 2)::BIGINT AS orders FROM t WHERE node % 2 = 1 GROUP BY node""",
)
def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that large order lines connect with the first twenty, through six orders at most: orders and parts are nodes."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 47").select((F.col("l_orderkey") * 2).alias("o"), (F.col("l_partkey") * 2 + 1).alias("p"))
    found = reachable(lines.unionByName(lines.select(F.col("p").alias("o"), F.col("o").alias("p"))), lines.where("p < 40").select("p"), most_steps=12)
    return found.where("node % 2 = 1").select(F.expr("(node - 1) div 2").alias("part"), F.expr("steps div 2").alias("orders"))


@query(
    "latest_version",
    """
    SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key as an aggregate, which is combined before the shuffle."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "e.event_id", "e.value")
