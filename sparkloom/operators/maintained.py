"""Aggregates kept up to date under inserts, deletes and corrections.

A change is a row with a sign: 1 where it comes, -1 where it goes; a correction is both. Each batch of changes is
aggregated by key before anything is stored, and what is stored is its signed partial state: counts and sums add up, and
least, greatest and distinct values come from signed counts of each value, so a value that went is
gone. Reading is one sum over the states of all batches.

A batch writes its own folder and replaces it when it is done again, so a repeated batch changes nothing. ``compact``
adds the states of all batches so far up into a base, and its last act, the list of the batches that are in it, is
what makes it count: a compaction that is broken off leaves all as it was, and a batch that comes again later is
known to be in the base. Folders go through Spark's committers, on any file system that it knows.

Sums of decimals and whole numbers are exact; give money as a decimal. Defined cases: a null key is a key like others; null
values don't count; a key whose rows have all gone has no row; an empty batch is a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MaintainedAggregate:
    """Count, sum, least, greatest and distinct values of ``value`` for each ``keys``, stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], value: str, kind: str = "decimal(20,4)"):
        self.spark, self.path, self.keys, self.value = spark, path.rstrip("/"), list(keys), value
        self.kind = kind

    def apply(self, batch: int, changes: DataFrame, sign: str = "sign") -> None:
        """Store the partial state of a batch of signed rows. Each (key, value) is one row, added up before it is shuffled."""
        if batch in self._merged()[1]:
            return
        rows = changes.select(*[F.col(k).alias(k) for k in self.keys], F.col(self.value).cast(self.kind).alias("value"), F.col(sign).cast("long").alias("n"))
        self._states(rows).write.mode("overwrite").parquet(f"{self.path}/batches/batch={int(batch)}")
        self.spark.createDataFrame([(int(batch),)], "id long").write.mode("overwrite").parquet(f"{self.path}/log/entry={int(batch)}")

    def _states(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys, "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def _read(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return None
            raise

    def _merged(self) -> tuple[int, set[int]]:
        """The number of the last whole compaction (0: none) and the batches that are in it: one number for each batch."""
        done = self._read(f"{self.path}/compactions")
        if done is None:
            return 0, set()
        number = done.agg(F.max("number")).first()[0]
        return number, {r.id for r in done.where(F.col("number") == number).select("id").collect()}

    def batches(self) -> set[int]:
        """The batches that were applied."""
        log = self._read(f"{self.path}/log")
        return set() if log is None else {r.id for r in log.select("id").collect()}

    def _state(self) -> DataFrame | None:
        """(keys, value, n) over the base and the batches that aren't in it."""
        number, merged = self._merged()
        paths = [f"{self.path}/base/number={number}"] if number else []
        paths += [f"{self.path}/batches/batch={b}" for b in sorted(self.batches() - merged)]
        if not paths:
            return None
        return self._states(self.spark.read.parquet(*paths).select(*self.keys, "value", "n"))

    def compact(self) -> None:
        """Put all that is there into one base."""
        number, _ = self._merged()
        done, state = self.batches(), self._state()
        if state is None:
            return
        state.write.mode("overwrite").parquet(f"{self.path}/base/number={number + 1}")
        rows = self.spark.createDataFrame([(b,) for b in sorted(done)], "id long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/compactions/number={number + 1}")

    def result(self) -> DataFrame:
        """(keys, n, total, least, greatest, distinct_values) of the keys that have rows."""
        state = self._state()
        if state is None:
            raise ValueError("nothing was applied yet")
        value, n = F.col("value"), F.col("n")
        there: Column = F.when(n > 0, value)
        out = state.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.sum(value * n).alias("total"), F.min(there).alias("least"), F.max(there).alias("greatest"), F.count_if((n > 0) & value.isNotNull()).alias("distinct_values"))
        return out.where("n > 0")
