"""What can be reached over the edges of a table, and in how many steps: semi-naive rounds with a visited set.

Each round joins only the nodes that were new in the last one with the edges, and leaves out what was visited before; nodes
are distinct before they are joined, so a round costs its new nodes' edges and no path is met twice. Rounds end when
nothing is new: as many as the longest shortest path. Frontier and visited set are tables in the shared folder, and lineage doesn't grow.

A node with a third of all edges is one key of the join of a round in which it is new; adaptive execution splits it.
Null nodes are reached by nothing and lead nowhere; loops and repeated edges change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.paths import shared_path


def reachable(edges: DataFrame, sources: DataFrame, most_steps: int | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(node, steps) of every node that ``edges``, its first two columns from and to, lead to from ``sources``, its first column; the sources themselves are at 0."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("from"), F.col(b).alias("node")).where("from IS NOT NULL AND node IS NOT NULL AND from <> node").distinct()
    path = shared_path(spark, "reach")
    e.write.parquet(f"{path}/edges")
    e = spark.read.parquet(f"{path}/edges")
    new = sources.select(F.col(sources.columns[0]).alias("node")).where("node IS NOT NULL").distinct()
    for step in range(most_rounds):
        here = f"{path}/visited/steps={step}"
        new.write.parquet(here)
        if most_steps is not None and step >= most_steps:
            break
        front = spark.read.parquet(here)
        if front.isEmpty():
            break
        visited = spark.read.parquet(*[f"{path}/visited/steps={s}" for s in range(step + 1)])
        new = e.join(front.withColumnRenamed("node", "from"), "from", "left_semi").select("node").distinct().join(visited, "node", "left_anti")
    else:
        raise RuntimeError(f"there was something new in each of {most_rounds} rounds")
    kind = dict(e.dtypes)["node"]
    return spark.read.schema(f"node {kind}, steps int").parquet(f"{path}/visited")
