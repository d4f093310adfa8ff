"""As-of joins: for each left row the latest right row that isn't later."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], tolerance: str | None = None, cell: Column | None = None) -> DataFrame:
    """``left`` with the other columns of the right row of the same ``by`` and the greatest ``on`` up to the left's; null where there is none.

    Both sides are put together and sorted within each ``by`` once: one shuffle, no pair is
    built, however many rows a key has. Ties on the right go to the greatest row in the order
    of its other columns. ``tolerance``, a SQL interval, bounds how far back a match may be.
    Rows with a null ``on`` match nothing; a null ``by`` is a key like others.

    ``cell``, a column over ``on`` that never falls as it grows (a day of a time, say), splits the
    keys: rows are sorted within (``by``, cell), and what the cells before hold is carried in
    from one row for each cell, so that a key with most rows isn't one task's work.
    """
    carried = [c for c in right.columns if c != on and c not in by]
    taken = [c for c in carried if c in left.columns]
    if taken:
        raise ValueError(f"both sides have {taken}")
    found = F.struct(F.col(on).alias("_on"), *carried)
    a = left.select(F.lit(1).alias("_side"), *by, F.col(on), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_found"))
    b = right.where(F.col(on).isNotNull()).select(F.lit(0).alias("_side"), *by, F.col(on), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), found.alias("_found"))
    both = a.unionByName(b)
    if cell is not None:
        both = both.withColumn("_cell", cell)
    keys = by if cell is None else [*by, "_cell"]
    w = W.partitionBy(*keys).orderBy(on, "_side", "_found").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    if cell is not None:
        cells = both.groupBy(*keys).agg(F.max("_found").alias("_end"))
        before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        carry = cells.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
        out = out.join(carry.where("_carry IS NOT NULL"), reduce(and_, same), "left").withColumn("_last", F.coalesce("_last", "_carry"))
    near = F.col("_row")[on].isNotNull()
    if tolerance is not None:
        near &= F.col("_last._on") >= F.col("_row")[on] - F.expr(f"INTERVAL {tolerance}")
    return out.select("_row.*", *[F.when(near, F.col("_last")[c]).alias(c) for c in carried])
