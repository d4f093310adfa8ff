"""Versions of a key over time: from changes to intervals, and joins of two histories by validity.

A history is a set of half-open intervals [since, until) that don't overlap within a key; the last one is open (until is
null). ``history`` makes it from changes: the value of a change holds until the next one, of changes at one time the last counts, and
equal values that follow each other are one version.

Two histories of a key are cut against each other in one ordered pass: where a piece begins, a version of one side begins, and
the version of the other side that holds there is the latest one before it. So the pass finds all pieces with a running value, builds no pairs
and has no trouble with long intervals, and a key with most versions is dealt over blocks (``operators.scan``).

Rows with a null key or time are left out; a null value is a value (nothing holds): it ends the version before it and makes none itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import scan


def history(changes: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], order: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """(keys, since, until, values) of the versions that changes make. ``order`` tells which of the changes at one time is the last."""
    here = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    rows = changes.where(here).select(*keys, F.col(at).alias("since"), F.struct(*values).alias("_value"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    by = [f"_order{i}" for i, _ in enumerate(order)]
    rows = scan.in_order(rows, keys, ["since", *by, "_value"], partitions)
    rows = rows.scan(_next=scan.latest("since", "after"))
    # Of one time the last; of equal values in a row the first.
    rows = rows.with_rows(rows.rows.where(F.col("_next").isNull() | (F.col("_next") > F.col("since")))).scan(_prior=scan.latest("_value", "before"))
    rows = rows.with_rows(rows.rows.where(F.col("_prior").isNull() | ~F.col("_prior").eqNullSafe(F.col("_value"))))
    out = rows.scan(until=scan.latest("since", "after")).result()
    something = reduce(lambda a, b: a | b, [F.col(f"_value.{v}").isNotNull() for v in values])
    return out.where(something).select(*keys, "since", "until", *[F.col(f"_value.{v}").alias(v) for v in values])


def temporal_join(a: DataFrame, b: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """(keys, since, until, values of both) of every piece of time in which a version of each holds. Both are histories: (keys, since, until, values)."""
    sides = [[c for c in df.columns if c not in (*keys, "since", "until")] for df in (a, b)]
    if clash := set(sides[0]) & set(sides[1]):
        raise ValueError(f"both sides have {sorted(clash)}")
    kinds = [df.select(F.struct("until", *own).alias("x")).schema["x"].dataType for df, own in zip((a, b), sides, strict=True)]
    both = []
    for i, (df, own) in enumerate(zip((a, b), sides, strict=True)):
        held = [F.struct("until", *own) if i == j else F.lit(None).cast(kinds[j]) for j in (0, 1)]
        both.append(df.select(*keys, "since", F.lit(i).alias("_side"), held[0].alias("_a"), held[1].alias("_b")))
    rows = scan.in_order(both[0].unionByName(both[1]), keys, ["since", "_side"], partitions).scan(_la=scan.latest("_a"), _lb=scan.latest("_b")).result()
    # Of two that begin together the second side's row makes the piece.
    until = F.least("_la.until", "_lb.until")
    rows = rows.where(F.col("_la").isNotNull() & F.col("_lb").isNotNull()).where(until.isNull() | (until > F.col("since")))
    return rows.select(*keys, "since", until.alias("until"), *[F.col(f"_l{s}.{c}").alias(c) for s, own in zip("ab", sides, strict=True) for c in own])
