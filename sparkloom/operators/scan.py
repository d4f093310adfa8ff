"""Running values over the ordered rows of a key, where one key may hold most rows.

A window that sorts the rows of a key does so in one task. Here rows are dealt by ranges of
(key, order), so that a key with many rows lies in many blocks, one after the other, and are
stored in that order. Each block computes its own running values; what the blocks before it
hold of the key that it opens with is carried in. That works for every fold that can be put
together from parts: counts, sums, least and greatest values, exclusive ors, the latest value.

Only the key that a block opens with has rows in earlier blocks, so there are at most twice as
many carried rows as blocks, whatever the data: they are broadcast on that bound. Rows that
agree in key and order are kept apart by a hash of the whole row, so a tie of any size is
dealt too (but for rows that are repeated whole).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.columns import fresh
from sparkloom.sources.paths import shared_path

#: ``monotonically_increasing_id`` has the partition above this bit and the row within it below.
_BLOCK_BITS = 33
FRAMES = ("upto", "before", "after", "all")


@dataclass(frozen=True)
class Fold:
    """A running value: what is folded, over which rows of the key (up to this one, before it, after it, all)."""

    kind: str
    of: Column
    frame: str = "upto"

    def __post_init__(self) -> None:
        if self.frame not in FRAMES:
            raise ValueError(f"no such frame: {self.frame}")


def count(frame: str = "upto") -> Fold:
    """Rows."""
    return Fold("count", F.lit(1), frame)


def total(of: Column | str, frame: str = "upto") -> Fold:
    """The sum of non-null values; null where there is none. Sums of floating-point numbers depend on where blocks end, in their last digits."""
    return Fold("total", _col(of), frame)


def least(of: Column | str, frame: str = "upto") -> Fold:
    return Fold("least", _col(of), frame)


def greatest(of: Column | str, frame: str = "upto") -> Fold:
    return Fold("greatest", _col(of), frame)


def xor(of: Column | str, frame: str = "upto") -> Fold:
    return Fold("xor", _col(of), frame)


def latest(of: Column | str, frame: str = "upto") -> Fold:
    """The nearest non-null value: the last one of the rows up to or before this one, the first one of those after it. In a struct, nulls count too."""
    if frame == "all":
        raise ValueError("the latest of all rows has no nearest end")
    return Fold("latest", _col(of), frame)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _aggregate(kind: str, c: Column, place: Column) -> Column:
    if kind == "latest":
        return F.max_by(c, F.when(c.isNotNull(), place))
    return {"count": F.count, "total": F.sum, "least": F.min, "greatest": F.max, "xor": F.bit_xor}[kind](c)


def _within(kind: str, c: Column) -> Column:
    return F.last(c, ignorenulls=True) if kind == "latest" else _aggregate(kind, c, c)


def _both(kind: str, far: Column, near: Column) -> Column:
    """The fold of two parts, of which ``near`` lies next to the row."""
    if kind == "latest":
        return F.coalesce(near, far)
    if kind == "count":
        return F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))
    if kind in ("least", "greatest"):
        return {"least": F.least, "greatest": F.greatest}[kind](far, near)
    put = far + near if kind == "total" else far.bitwiseXOR(near)
    return F.when(far.isNull(), near).when(near.isNull(), far).otherwise(put)


@dataclass(frozen=True)
class Sorted:
    """Rows in the order of their keys; ``place`` names the column that holds it."""

    rows: DataFrame
    keys: tuple[str, ...]
    place: str

    def with_rows(self, rows: DataFrame) -> Sorted:
        """The same order with other columns, or fewer rows; keys and place must be as they were, no row may be added."""
        return Sorted(rows, self.keys, self.place)

    def result(self) -> DataFrame:
        return self.rows.drop(self.place)

    def scan(self, **folds: Fold) -> Sorted:
        """One column more for each fold."""
        if clash := [n for n in folds if n.lower() in {c.lower() for c in self.rows.columns}]:
            raise ValueError(f"columns that are there already: {clash}")
        taken = [*self.rows.columns, *folds]
        block, *rest = fresh(taken, "_block", *[f"_of{i}" for i, _ in enumerate(folds)], *[f"_far{i}" for i, _ in enumerate(folds)], "_to", *[f"_key{i}" for i, _ in enumerate(self.keys)])
        of, far, to, there = rest[: len(folds)], rest[len(folds) : 2 * len(folds)], rest[2 * len(folds)], rest[2 * len(folds) + 1 :]
        place, each = F.col(self.place), list(zip(folds.items(), of, far, strict=True))
        rows = self.rows.withColumn(block, F.shiftright(place, _BLOCK_BITS)).withColumns({o: f.of for (_, f), o, _ in each})

        # The keys that blocks open with: one row for each block at most.
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(self.keys, there, strict=True)], F.lit(True))
        spanning = rows
        if self.keys:
            first = F.min_by(F.struct(*[F.col(k).alias(t) for k, t in zip(self.keys, there, strict=True)]), place).alias(to)
            spanning = rows.join(F.broadcast(rows.groupBy(block).agg(first).select(f"{to}.*").distinct()), same, "left_semi")
        parts = spanning.groupBy(block, *self.keys).agg(*[_aggregate(f.kind, F.col(o), -place if f.frame == "after" else place).alias(o) for (_, f), o, _ in each])
        by = W.partitionBy(*self.keys)
        frames = {"upto": by.orderBy(block).rowsBetween(W.unboundedPreceding, -1), "before": by.orderBy(block).rowsBetween(W.unboundedPreceding, -1), "after": by.orderBy(F.desc(block)).rowsBetween(W.unboundedPreceding, -1), "all": by}
        carried = parts.select(F.col(block).alias(to), *[F.col(k).alias(t) for k, t in zip(self.keys, there, strict=True)], *[_within("total" if f.kind == "count" else f.kind, F.col(o)).over(frames[f.frame]).alias(r) for (_, f), o, r in each])

        mine = W.partitionBy(block, *self.keys)
        near = {"upto": mine.orderBy(self.place).rowsBetween(W.unboundedPreceding, 0), "before": mine.orderBy(self.place).rowsBetween(W.unboundedPreceding, -1), "after": mine.orderBy(F.desc(self.place)).rowsBetween(W.unboundedPreceding, -1), "all": mine}
        rows = rows.withColumns({o: _within(f.kind, F.col(o)).over(near[f.frame]) for (_, f), o, _ in each})
        rows = rows.join(F.broadcast(carried), (F.col(block) == F.col(to)) & same, "left")
        # What is carried into an "all" frame holds this block already.
        values = [(F.coalesce(F.col(r), F.col(o)) if f.frame == "all" else _both(f.kind, F.col(r), F.col(o))).alias(n) for (n, f), o, r in each]
        return self.with_rows(rows.select(*self.rows.columns, *values))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], partitions: int | None = None) -> Sorted:
    """Deal rows by ranges of (keys, order), sort them and store them so, in the shared folder: what is computed from them doesn't depend on where range bounds fall if a task is done again.

    ``order`` may hold sort orders (``F.desc("x")``). Rows that tie are ordered by a hash of all columns but maps. No key at all makes one order of the whole table.
    """
    spark = df.sparkSession
    (place,) = fresh(df.columns, "_place")
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]
    by = [*map(F.col, keys), *map(_col, order), F.xxhash64(*hashed)]
    dealt = df.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    path = shared_path(spark, "ordered")
    dealt.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    return Sorted(spark.read.schema(df.schema.add(place, "long")).parquet(path), tuple(keys), place)


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_number, rank, dense_rank, percent_rank, cume_dist, key_rows`` within keys of any size, ascending, nulls first. Rows that tie get row numbers by a hash of the row."""
    values = F.struct(*order)
    rows = in_order(df, keys, order, partitions).scan(row_number=count(), key_rows=count("all"), _prior=latest(values, "before"))
    (opens,) = fresh(rows.rows.columns, "_opens")
    rows = rows.with_rows(rows.rows.withColumn(opens, F.col("_prior").isNull() | ~F.col("_prior").eqNullSafe(values)))
    start = F.when(F.col(opens), F.col("row_number"))
    rows = rows.scan(rank=greatest(start), dense_rank=total(F.col(opens).cast("long")), _next=least(start, "after"))
    n = F.col("key_rows")
    out = rows.result().withColumn("percent_rank", F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(0.0)).withColumn("cume_dist", F.coalesce(F.col("_next") - 1, n) / n)
    return out.drop("_prior", opens, "_next")


def tile(row_number: Column, rows: Column, tiles: int) -> Column:
    """Which of ``tiles`` nearly equal runs a row is in, the longer ones first."""
    size, longer = F.floor(rows / tiles), rows % tiles
    edge = longer * (size + 1)
    return F.when(row_number <= edge, F.floor((row_number - 1) / (size + 1)) + 1).otherwise(longer + F.floor((row_number - 1 - edge) / F.greatest(size, F.lit(1))) + 1).cast("long")
