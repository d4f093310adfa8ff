"""User code in the plan: Arrow-batched scalar functions, maps over ordered groups, table functions. Built-in functions come first wherever they can say it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def jaro_winkler(a: str, b: str) -> float:
    """Likeness of two short strings from common characters near each other, their order, and a common beginning."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, own = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    if not own:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(own, other, strict=True)) // 2
    n = len(own)
    like = (n / len(a) + n / len(b) + (n - moved) / n) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return like + 0.1 * same * (1 - like) if like > 0.7 else like


@query("scalar_udf", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS likeness FROM part")
def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure of strings that Spark has no function for, once for each distinct pair of a batch."""

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        found = {p: None if None in p else jaro_winkler(*p) for p in set(pairs)}
        return pd.Series([found[p] for p in pairs], dtype="float64")

    return table(spark, sf_dir, "part").select("p_partkey", F.round(likeness("p_name", "p_type"), 6).alias("likeness"))


def exact_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total): sums of doubles without rounding until the end, so they don't depend on the order of rows or on partitions.

    A finite double is a whole number of 53 bits and a power of two. Batches add up the whole numbers for each (key, power) in two halves, which
    doesn't overflow; these are added up by Spark, and a key's powers, some 2,100 at most, are put together as whole numbers of any length. Null and non-finite values don't count.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["value"].to_numpy(float)
            fine = np.isfinite(x)
            m, e = np.frexp(x[fine])
            whole = (m * 2.0**53).astype(np.int64)
            rows = pd.DataFrame({"key": pdf["key"].to_numpy()[fine], "power": e.astype(np.int64) - 53, "high": whole >> 26, "low": whole & ((1 << 26) - 1)})
            yield rows.groupby(["key", "power"], as_index=False, dropna=False).sum()

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    added = rows.mapInPandas(parts, f"key {kind}, power long, high long, low long").groupBy("key", "power").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))

    @F.pandas_udf("double")
    def together(all_: pd.Series) -> pd.Series:
        def total(powers: list[dict]) -> float:
            least = min(p["power"] for p in powers)
            whole = sum(((int(p["high"]) << 26) + int(p["low"])) << int(p["power"] - least) for p in powers)
            return whole / (1 << -least) if least < 0 else float(whole << least)

        return all_.map(total)

    return added.groupBy("key").agg(F.collect_list(F.struct("power", "high", "low")).alias("p")).select(F.col("key").alias(key), together("p").alias("total"))


@query("aggregate_udf", "SELECT event_type, round(fsum(value), 9) AS total FROM events GROUP BY event_type")
def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum that is the same for every order of the rows."""
    return exact_sum(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("total", 9).alias("total"))


@query(
    "grouped_map",
    """
    SELECT user_id, date_trunc('week', ts)::DATE AS week, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.7 * s + 0.3 * x), 8) AS smoothed
    FROM events GROUP BY ALL""",
)
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing, in which each value needs the one before: a loop over the events of each user's week.

    The groups of a partition come one after the other, in order, and go through one loop: a grouped map of Spark's own would make a data frame for each
    group, at some milliseconds, and hold the group. Here one batch is held and one running value, however many groups there are and however large.
    """

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.int64(), pa.date32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["user_id", "week", "smoothed"])

        key, s = None, None
        for batch in batches:
            done = []
            for user, week, x in zip(*(batch.column(c).to_pylist() for c in ("user_id", "week", "value")), strict=True):
                if (user, week) == key:
                    s = None if s is None or x is None else 0.7 * s + 0.3 * x
                else:
                    if key is not None:
                        done.append((*key, s))
                    key, s = (user, week), x
            yield batch_of(done)
        if key is not None:
            yield batch_of([(*key, s)])

    rows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), "ts", "event_id", "value")
    order = [F.asc_nulls_last(c) for c in ("user_id", "week", "ts", "event_id", "value")]
    rows = rows.repartition("user_id", "week").sortWithinPartitions(*order).select("user_id", "week", "value")
    return rows.mapInArrow(smooth, "user_id long, week date, smoothed double").withColumn("smoothed", F.round("smoothed", 8))


@query(
    "table_function",
    """
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no FROM orders),
    t AS (
      SELECT o_custkey, o_orderkey, no, o_totalprice AS held, 1::BIGINT AS parcel FROM o WHERE no = 1
      UNION ALL
      SELECT o.o_custkey, o.o_orderkey, o.no, CASE WHEN t.held + o.o_totalprice <= 400000 THEN t.held + o.o_totalprice ELSE o.o_totalprice END,
             t.parcel + CASE WHEN t.held + o.o_totalprice <= 400000 THEN 0 ELSE 1 END
      FROM t JOIN o ON o.o_custkey = t.o_custkey AND o.no = t.no + 1)
    SELECT o_custkey, parcel, count(*) AS orders, round(max(held), 4) AS value FROM t GROUP BY ALL""",
)
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over ordered partitions: a customer's orders go into parcels of up to 400,000, a new one where the next doesn't fit. A running value that starts anew by its own state is no window function; one row is held at a time."""

    @F.udtf(returnType="o_custkey: bigint, parcel: bigint, orders: bigint, value: double")
    class Parcels:
        def __init__(self):
            self.parcel, self.orders, self.held, self.key = 1, 0, 0.0, None

        def eval(self, row):
            self.key = row["o_custkey"]
            if self.orders and self.held + row["o_totalprice"] > 400_000:
                yield self.key, self.parcel, self.orders, self.held
                self.parcel, self.orders, self.held = self.parcel + 1, 0, 0.0
            self.orders += 1
            self.held += row["o_totalprice"]

        def terminate(self):
            if self.orders:
                yield self.key, self.parcel, self.orders, self.held

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    parcels = Parcels(orders.asTable().partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return parcels.select("o_custkey", "parcel", "orders", F.round("value", 4).alias("value"))
