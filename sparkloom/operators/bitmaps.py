"""Exact distinct counts from stored bitmaps.

The ids of each combination of dimensions are kept as bits: a row for each bucket of 32,768 ids holds 4 KB, whatever
the number of rows behind it. Counting over any subset of the dimensions is an or of bitmaps and a sum of bit counts, from the
stored table alone; counts of distinct ids can't be added up otherwise. Buckets are part of the key until the last
step, so a combination with most ids is dealt over as many tasks as it has buckets, and ors are combined before the shuffle.

Ids are whole numbers, best dense; null ids don't count; negative ids have buckets of their own; null dimensions are values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap_table(df: DataFrame, dims: Sequence[str], id_: str) -> DataFrame:
    """(dims, side, bucket, bits) of the distinct ids of each combination, to be stored. Negative ids are on a side of their own."""
    v = F.col(id_).cast("long")
    place = F.when(v < 0, -(v + 1)).otherwise(v)
    rows = df.where(v.isNotNull()).select(*dims, (v < 0).alias("side"), F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    return rows.groupBy(*dims, "side", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(*tables: DataFrame) -> DataFrame:
    """Several bitmap tables as one, as of several days."""
    first = tables[0]
    rows = first
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(*[c for c in first.columns if c != "bits"]).agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_by(table: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], count: str = "n") -> DataFrame:
    """(dims, grouped, n): distinct ids for each grouping set; ``grouped`` has a bit for each dimension that is not in the set, the last dimension lowest."""
    own = [[F.col(d) for d in s] for s in sets]
    within = table.groupingSets([[*s, F.col("side"), F.col("bucket")] for s in own], *dims, "side", "bucket").agg(F.bitmap_or_agg("bits").alias("_bits"), F.shiftright(F.grouping_id(), 2).alias("grouped"))
    return within.groupBy(*dims, "grouped").agg(F.sum(F.bitmap_count("_bits")).alias(count))
