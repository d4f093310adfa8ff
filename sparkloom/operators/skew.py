"""Hot keys: aggregates in two steps and joins with salted keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import fresh


def salted_distinct_count(df: DataFrame, key: str, value: str, salts: int = 32) -> DataFrame:
    """(key, n): distinct non-null values of each key, where one key may hold most rows. Values are dealt by their hash, so each is counted in one place."""
    rows = df.where(F.col(value).isNotNull()).select(key, value, F.pmod(F.xxhash64(value), F.lit(salts)).alias("_salt")).distinct()
    part = rows.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    return part.groupBy(key).agg(F.sum("_n").alias("n"))


def salted_join(facts: DataFrame, dims: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``facts`` may have hot keys: its rows are dealt over salts, and each row of ``dims`` stands in all of them. ``how``: inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("copies of dims allow inner and left joins alone")
    rest = [c for c in facts.columns if c != key]
    dealt = facts.withColumn("_salt", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(salts)).cast("int"))
    copied = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def hot_key_join(facts: DataFrame, dims: DataFrame, keys: Sequence[str], how: str = "inner", most: int = 10_000, least: int = 1000) -> DataFrame:
    """Join on ``keys``, which ``dims`` holds once each, finding the hot keys of ``facts`` itself.

    A key is hot if it has more than one in ``most`` of the rows of ``facts`` and at least ``least``: there are fewer
    than ``most`` such keys, so their rows of ``dims`` are broadcast on that bound, and rows of hot keys aren't
    shuffled. All others are joined by a shuffle in which no key has more than that share. ``how``: inner or left.
    ``facts`` is read three times: let it be a stored table. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("hot keys allow inner and left joins alone")
    if clash := [c for c in dims.columns if c in facts.columns and c not in keys]:
        raise ValueError(f"both sides have {clash}")
    there = fresh([*facts.columns, *dims.columns], *[f"_hot{i}" for i, _ in enumerate(keys)])
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = facts.count()
    hot = facts.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias(there[0] + "n")).where(F.col(there[0] + "n") > max(least, rows // most))
    hot = F.broadcast(hot.select(*[F.col(k).alias(t) for k, t in zip(keys, there, strict=True)]))
    same = reduce(and_, [F.col(k) == F.col(t) for k, t in zip(keys, there, strict=True)])
    busy = facts.join(hot, same, "left_semi").join(F.broadcast(dims.join(hot, same, "left_semi")), list(keys), how)
    return busy.unionByName(facts.join(hot, same, "left_anti").join(dims, list(keys), how))
