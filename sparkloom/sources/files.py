"""Sources and sinks: columnar and text files with stated schemas, partitioned and bucketed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Options under which each text format gives back what was written; in CSV a null is \\N, so that empty texts stay apart.
TEXT_OPTIONS = {"csv": {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N"}, "json": {"ignoreNullFields": "false"}}
FORMATS = ("parquet", "orc", "csv", "json")


def write(df: DataFrame, path: str, kind: str = "parquet", *, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write to a folder of any file system that Spark knows. Partition columns should be few-valued: each value is a folder."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    writer = df.write.format(kind).mode(mode).options(**TEXT_OPTIONS.get(kind, {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read a folder. Text formats need a schema: inferring one reads all files twice."""
    if kind in TEXT_OPTIONS and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**TEXT_OPTIONS.get(kind, {}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """An external table, bucketed and sorted by keys, at a path: tables of equal buckets join on them without a shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
