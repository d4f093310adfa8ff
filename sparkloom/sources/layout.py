"""Tables laid out along a space-filling curve, so that a filter on any of some columns reads few files.

Each column is cut into ``2**BITS`` parts of about equal numbers of rows, by quantiles of the data; the bits of the parts'
numbers are interleaved (Morton, 1966), rows are dealt and sorted by ranges of that number, and so a file is a small box in all columns at
once. The least and greatest values of each file are kept in a table beside them; a read with ranges looks there first and opens only the
files whose box meets the ranges, whose row groups Spark prunes further.

Rows with a null in a column lie with its least part; as in SQL they pass no range, and a file's box is that of its values that aren't null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 6


def _number(c: str, kind: str) -> Column:
    """A column as a double that grows with it."""
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def curve(df: DataFrame, columns: Sequence[str], bits: int = BITS, error: float = 0.002) -> Column:
    """The place of a row on the curve. Takes quantiles of the columns, ``2**bits`` numbers each."""
    kinds = dict(df.dtypes)
    numbers = df.select(*[_number(c, kinds[c]).alias(c) for c in columns])
    shares = [i / 2**bits for i in range(1, 2**bits)]
    bounds = numbers.stat.approxQuantile(list(columns), shares, error)
    place = F.lit(0).cast("long")

    def part_of(number: Column, edges: list[float]) -> Column:
        held = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
        return F.when(number.isNull(), 0).otherwise(F.size(F.filter(held, lambda e: e <= number))).cast("long")

    for j, (c, edges) in enumerate(zip(columns, bounds, strict=True)):
        part = part_of(_number(c, kinds[c]), edges)
        for i in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(part, i).bitwiseAND(F.lit(1)), len(columns) * i + j))
    return place


def write_by_curve(df: DataFrame, path: str, columns: Sequence[str], files: int) -> None:
    """Write ``df`` to about ``files`` files along the curve of ``columns``, and the boxes of the files to ``path/_boxes``, which Spark's readers of ``path`` pass over."""
    (place,) = ("_place",) if "_place" not in df.columns else ("_place_of_curve",)
    rows = df.withColumn(place, curve(df, columns))
    rows.repartitionByRange(files, place).sortWithinPartitions(place).drop(place).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    boxes = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max))])
    boxes.coalesce(1).write.parquet(f"{path}/_boxes")


def files_for(spark: SparkSession, path: str, ranges: Mapping[str, tuple[Any, Any]]) -> tuple[list[str], int]:
    """The files whose boxes meet all ranges (ends included), and how many there are in all."""
    boxes = spark.read.parquet(f"{path}/_boxes")
    met = boxes
    for c, (low, high) in ranges.items():
        met = met.where((F.col(f"greatest_{c}") >= F.lit(low)) & (F.col(f"least_{c}") <= F.lit(high)))
    return [r.file for r in met.select("file").collect()], boxes.count()


def read_by_curve(spark: SparkSession, path: str, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """The rows within all ranges, from the files that can hold some."""
    files, _ = files_for(spark, path, ranges)
    schema = spark.read.parquet(path).schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for c, (low, high) in ranges.items():
        rows = rows.where(F.col(c).between(F.lit(low), F.lit(high)))
    return rows
