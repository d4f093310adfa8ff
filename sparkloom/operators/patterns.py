"""Patterns over ordered events: which runs of a key's events go through given steps.

A pattern is a row of steps, each some symbols with how often they may come: ``view{1,}``, then ``click|error{0,2}``,
then ``purchase``. Matches are found from the first event on, each step taking as many events as it
can, and don't overlap. No match goes over a gap longer than ``gap``, nor over an event that stands in no
step, so such events cut a key's events into segments. Where the cuts are is a running value (``operators.scan``): a key with
most rows is dealt over blocks for it, and its segments then go to many tasks. Each task runs its segments, sorted, through
one automaton, a segment's symbols as one character each.

A segment is in one task and one row of characters in memory; a key that never pauses and does nothing but what the pattern
names is one segment. Defined cases: rows with a null key, time or symbol are left out; events of
one time go by the tie column; an empty table has no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import scan

#: Characters that symbols are coded by, in order; none has a meaning in a pattern.
_FIRST = 0x4E00


@dataclass(frozen=True)
class Step:
    """One of ``symbols``, at least ``least`` and at most ``most`` times (None: any number)."""

    symbols: tuple[str, ...]
    least: int = 1
    most: int | None = 1

    def __post_init__(self) -> None:
        if not self.symbols or self.least < 0 or (self.most is not None and self.most < max(1, self.least)):
            raise ValueError(f"not a step: {self}")


def steps_of(pattern: str) -> list[Step]:
    """Steps from text: ``view{1,} click|error{0,2} purchase``; +, * and ? are as usual."""
    out = []
    for part in pattern.split():
        m = re.fullmatch(r"([^{}+*?]+)(?:\{(\d+)(,?)(\d*)\}|([+*?]))?", part)
        if m is None:
            raise ValueError(f"not a step: {part}")
        names, low, comma, high, short = m.groups()
        least, most = {None: (1, 1), "+": (1, None), "*": (0, None), "?": (0, 1)}[short]
        if low is not None:
            least, most = int(low), int(high) if high else None if comma else int(low)
        out.append(Step(tuple(names.split("|")), least, most))
    if not any(s.least for s in out):
        raise ValueError("a pattern needs a step that must come")
    return out


def _compiled(steps: Sequence[Step], code: dict[str, str]) -> re.Pattern:
    return re.compile("".join(f"([{''.join(code[s] for s in step.symbols)}]{{{step.least},{'' if step.most is None else step.most}}})" for step in steps))


def match_events(events: DataFrame, pattern: str | Sequence[Step], *, key: str, at: str, symbol: str, tie: str, gap: str, partitions: int | None = None) -> DataFrame:
    """(key, first, last, began, ended, n, steps) of every match: the tie columns and times of its first and last event, its events, and how many each step took.

    ``at`` is a timestamp and ``tie`` a whole number that tells events of one time apart; ``gap`` is a SQL interval.
    """
    steps = steps_of(pattern) if isinstance(pattern, str) else list(pattern)
    symbols = list(dict.fromkeys(s for step in steps for s in step.symbols))
    code = {s: chr(_FIRST + i) for i, s in enumerate(symbols)}
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(symbol).alias("symbol")).where("key IS NOT NULL AND at IS NOT NULL AND symbol IS NOT NULL")
    known = F.col("symbol").isin(symbols)
    ordered = scan.in_order(rows, ["key"], ["at", "tie"], partitions).scan(prior=scan.latest(F.struct("at", known.alias("known")), "before"))
    opens = F.coalesce(~F.col("prior.known") | (F.col("at") > F.col("prior.at") + F.expr(f"INTERVAL {gap}")), F.lit(True))
    ordered = ordered.with_rows(ordered.rows.withColumn("opens", opens.cast("long"))).scan(segment=scan.total("opens"))
    place = ordered.place
    rows = ordered.rows.where(known).select("key", "segment", F.col(place).alias("place"), "at", "tie", "symbol")
    rows = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "place").drop("place")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _compiled(steps, code)
        now, held, out = None, [], []

        def close() -> None:
            for m in automaton.finditer("".join(code[s] for _, _, s in held)):
                (a, x, _), (b, y, _) = held[m.start()], held[m.end() - 1]
                out.append((now[0], x, y, a, b, m.end() - m.start(), [len(g) for g in m.groups()]))

        for pdf in batches:
            for k, segment, t, tie_, s in pdf.itertuples(index=False):
                if (k, segment) != now:
                    close()
                    now, held = (k, segment), []
                held.append((t, tie_, s))
            yield pd.DataFrame(out, columns=["key", "first", "last", "began", "ended", "n", "steps"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["key", "first", "last", "began", "ended", "n", "steps"])

    found = rows.mapInPandas(run, f"key {kinds['key']}, first long, last long, began {kinds['at']}, ended {kinds['at']}, n long, steps array<long>")
    return found.withColumnRenamed("key", key)
