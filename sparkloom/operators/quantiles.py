"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import scan


def exact_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], partitions: int | None = None) -> DataFrame:
    """(key, names of ``shares``): interpolated quantiles of the non-null values of each key.

    Repeated values are counted first; the distinct ones are dealt by ranges of (key, value), so no task holds all values of a key however
    they are spread, and their counts are added up by a prefix scan, which says which of them stand at the wanted ranks.
    Null is a key like others; keys without a value are left out.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = scan.in_order(counted, ["_k"], ["_v"], partitions).scan(_upto=scan.total("_c"), _n=scan.total("_c", "all")).result()
    # The two ranks (from 0) around each share.
    at = {name: (F.col("_n") - 1) * F.lit(p) for name, p in shares.items()}

    def here(rank: Column) -> Column:
        return (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))

    ranks = F.array(*[r for x in at.values() for r in (F.floor(x), F.ceil(x))])
    held = counted.where(F.exists(ranks, here))
    found = []
    for name, x in at.items():
        low, high = (F.max(F.when(here(r), F.col("_v"))) for r in (F.floor(x), F.ceil(x)))
        found.append((low + (high - low) * F.max(x - F.floor(x))).alias(name))
    return held.groupBy(F.col("_k").alias(key)).agg(*found)
