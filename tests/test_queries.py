"""Every query with SQL against DuckDB, and the driver's contract."""

import io
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.plans import QUERIES, SQL
from tests.oracles import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert QUERIES.keys() <= queries.keys() and SQL.keys() <= sql.keys() <= queries.keys()


def test_approximate_distinct(spark, sf_dir):
    """Within three standard errors of a sketch of 2^12 registers."""
    exact = {r.l_returnflag: r.n for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n")).collect()}
    got = {r.l_returnflag: r.parts for r in QUERIES["approximate_distinct"](spark, sf_dir).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[k] - n) <= 3 * 1.04 / 2**6 * n for k, n in exact.items())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    with redirect_stdout(io.StringIO()) as out:
        QUERIES["filter_projection"](spark, sf_dir).explain("formatted")
    plan = out.getvalue()
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_quantity,24.0)" in pushed
    assert "l_suppkey" not in next(x for x in plan.splitlines() if x.startswith("ReadSchema"))


def test_bucketed_join_has_no_exchange_below_it(spark, sf_dir):
    with redirect_stdout(io.StringIO()) as out:
        QUERIES["bucketed_join"](spark, sf_dir).explain("formatted")
    assert "hashpartitioning(o_orderkey" not in out.getvalue() and "hashpartitioning(l_orderkey" not in out.getvalue()


def test_smoothing_over_many_batches_and_odd_values(spark, tmp_path):
    """Groups go over the ends of batches; null and NaN values stay what they are, null users and times are groups; no data frame for each group."""
    duckdb.sql(f"""
        COPY (
          SELECT i AS event_id, CASE WHEN i % 97 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (i * 7919 % 40) HOUR * 10 END AS ts, CASE WHEN i % 31 <> 0 THEN i % 13 END AS user_id,
                 'view' AS event_type, CASE i % 150 WHEN 7 THEN NULL WHEN 20 THEN 'nan'::DOUBLE WHEN 33 THEN 'inf'::DOUBLE ELSE i * 0.37 END AS value, '' AS props
          FROM range(600) r(i)
        ) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        same(QUERIES["grouped_map"](spark, str(tmp_path)), SQL["grouped_map"], str(tmp_path))
    finally:
        spark.conf.set(name, before)
    with redirect_stdout(io.StringIO()) as out:
        QUERIES["grouped_map"](spark, str(tmp_path)).explain()
    assert "FlatMapGroups" not in out.getvalue()
