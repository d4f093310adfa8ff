"""Range joins without comparing all pairs: the axis is cut into cells and joined by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Each point with each span that holds it, ends included; ``at``, ``low`` and ``high`` are whole numbers.

    Spans go by levels: the cells of a level are twice as wide as those of the one before, from
    ``width`` on, and a span stands in the cells of the first level that are as wide as it, two
    at most. A point stands in one cell of each level that there is, so each pair is met once
    and the copies of a row are few however long a span is. Rows with a null, and spans that
    end before they begin, match nothing.
    """
    length = (F.col(high) - F.col(low)).cast("double") / width
    level = F.when(length > 1, F.ceil(F.log2(length))).otherwise(0).cast("int")
    spans = spans.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # 64 at most
    cell = lambda c, of: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), of)))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(low, F.col("_level")), cell(high, F.col("_level")))))
    each = F.array(*map(F.lit, levels)).cast("array<int>")
    points = points.where(F.col(at).isNotNull()).withColumn("_at_level", F.explode(each))
    points = points.withColumn("_at_cell", cell(at, F.col("_at_level")))
    met = points.join(spans, (F.col("_at_level") == F.col("_level")) & (F.col("_at_cell") == F.col("_cell")))
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("_cell", "_level", "_at_cell", "_at_level")
