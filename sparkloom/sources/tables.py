"""The tables of a data folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple(
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table. The path goes to Spark as it is, so any file system that Spark knows will do."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
