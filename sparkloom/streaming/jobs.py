"""Structured Streaming over event files: event-time windows, sessions, deduplication, stream joins, keyed state.

Each function takes a streaming (or batch) DataFrame of events and returns one, to be
started with any sink; ``available`` runs a job over all files that are there, into a
Parquet table, and stops. State is bounded by the watermark, but for ``spending``, which keeps a row for each
user for ever; ``visits`` has keyed state that expires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet", schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet event files of a folder whose names match. Watermarks need an instant, so ``ts`` becomes one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(began, event_type, n, total) of each window that the watermark has passed."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("began"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, began, ended, n) of each session that the watermark has closed."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, if its repeats come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def purchases_with_view(events: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(event_id, view_id): purchases with the same user's views up to ``within`` before; both sides' state ends with the watermark."""
    own = events.withWatermark("ts", late)
    buys = own.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("at"))
    views = own.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    on = (F.col("u") == F.col("user_id")) & (F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - F.expr(f"INTERVAL {within}"))
    return buys.join(views, on).select("event_id", "view_id")


def spending(events: DataFrame) -> DataFrame:
    """(user_id, n, total) of each user's purchases so far, updated with every batch: state is one row for each user."""

    def add(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    buys = events.where("event_type = 'purchase'").select("user_id", "value")
    return buys.groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def available(job: DataFrame, path: str, checkpoint: str, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a job over all that is there and read its output. ``batch`` turns each micro-batch (with its number) into the rows to write; a batch that is done again replaces its folder."""

    def put(df: DataFrame, number: int) -> None:
        out = batch(df, number) if batch else df
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = job.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put)
    run = writer.start()
    run.awaitTermination()
    return job.sparkSession.read.schema(job.schema).parquet(path).select(*job.columns)
