"""Sinks and sources: what is written is read back and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.sources.ipc import register
from sparkloom.sources.paths import shared_path
from sparkloom.sources.tables import table

_SAME = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _there_and_back(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(*_COLUMNS)
    path = shared_path(spark, kind)
    files.write(rows, path, kind, **options)
    return files.read(spark, path, kind, rows.schema).select(*_COLUMNS)


@query("sink_csv", _SAME)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, sf_dir, "csv")


@query("sink_json", _SAME)
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, sf_dir, "json")


@query("sink_orc", _SAME)
def sink_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _there_and_back(spark, sf_dir, "orc")


@query("sink_partitioned", f"{_SAME} WHERE o_orderstatus = 'F'")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on the folder's column prunes whole folders."""
    rows = _there_and_back(spark, sf_dir, "parquet", partition_by=("o_orderstatus",))
    return rows.where(F.col("o_orderstatus") == "F")


@query("bucketed_join", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are bucketed by the order's key once; joins on it then need no exchange."""

    made = []

    def bucketed(name: str, *columns: str) -> DataFrame:
        path = shared_path(spark, f"{name}_by_order")
        made.append(path.rpartition("/")[2].replace("-", "_"))
        return files.write_bucketed(table(spark, sf_dir, name).select(*columns), made[-1], path, columns[:1], 8)

    orders, lines = bucketed("orders", "o_orderkey", "o_orderstatus"), bucketed("lineitem", "l_orderkey")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    counted = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    for name in made:  # the plan has their files; the catalog keeps no names of one call
        spark.sql(f"DROP TABLE {name}")
    return counted


@query("ipc_source", "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 1100 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def ipc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a Python data source and back; the filters skip files there. Written twice, the second time over the first."""
    register(spark)
    path = shared_path(spark, "ipc")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    orders.limit(10).write.format("arrow_ipc").mode("append").save(path)
    orders.repartitionByRange(8, "o_orderkey").write.format("arrow_ipc").mode("overwrite").save(path)
    return spark.read.format("arrow_ipc").load(path).where("o_orderkey BETWEEN 100 AND 1100 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
