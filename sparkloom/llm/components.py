"""Connected components of an edge table, by rounds of large-star and small-star joins.

Each round hangs every node's larger neighbours on its smallest one, then its smaller
ones (Kiveris et al., 2014). Edges never grow in number, the rounds are about log(n),
and each is a pair of aggregates and joins on a node, with its result in a checkpoint;
no node list, link list or component is ever in one task or on the driver. The smallest
neighbour of a node is a min, combined before the shuffle; the join back is an equi-join
that adaptive execution splits where one node has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

MOST_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the smallest node of its component.

    Null ends and loops are left out; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut(e)
    seen = _mark(e)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        e = cut(_small_star(_large_star(e)))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
