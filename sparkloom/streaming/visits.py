"""Visits in a stream, with keyed state, event-time timers and expiry.

An event belongs to its user's visit if it comes within ``gap`` of the visit's last event and within ``cap`` of its
first; otherwise it begins the next one. Because of the cap a visit's bounds depend on the order of events, which no window function of
Spark has; and events come out of order, up to the watermark's delay. So events wait in a list state, a timer at the
first of them; when the watermark has passed it, all that it has passed are taken in order, and what they
open, extend or close is final. A visit is given out when nothing can join it any more, by the same timer, and a user
without events waiting or an open visit has no state left.

A call for a key, with its data frame, its states and its timer, takes some milliseconds whatever it holds; so a key is a group of users, by a hash,
and not one user. A group's events of a micro-batch and its open visits are in memory at once: ``groups`` is to grow with these, and has to stay
what it was for a checkpoint that is gone on with.

The result doesn't depend on how events are cut into batches or on their order in these, so long as none comes later than the
watermark allows; Spark drops those that do, and counts them.

Events of one time are taken by ``event_id``. Rows with a null user or time are left out; a null value counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "user_id long, began long, ended long, n long, total double"


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """State stores that hold several states and timers for each key, for queries started within; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Visits(StatefulProcessor):
    """Visits of a group of users. Times are microseconds in the state, and milliseconds, rounded up, in timers."""

    def __init__(self, gap: int, cap: int):
        self.gap, self.cap = gap, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "user long, at long, id long, value double")
        self.visit = handle.getListState("visit", "user long, began long, last long, n long, total double")

    def _closes(self, visit: tuple) -> int:
        """The time from which nothing can join any more."""
        return min(visit[1] + self.gap, visit[0] + self.cap)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*(pdf[c].tolist() for c in ("user_id", "at", "id", "value")), strict=True)]
        self.waiting.appendList(new)
        # One timer, at a time; timers fire once the watermark is beyond them.
        wake = -(-min(r[1] for r in new) // 1000)
        before = list(self.handle.listTimers())
        if not before or wake < min(before):
            for old in before:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(wake)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        visits = {v[0]: tuple(v[1:]) for v in self.visit.get()} if self.visit.exists() else {}
        done = []
        for user, at, _, value in sorted(w for w in waiting if w[1] <= passed):
            visit = visits.get(user)
            if visit and at - visit[1] <= self.gap and at - visit[0] <= self.cap:
                visits[user] = visit[0], at, visit[2] + 1, visit[3] + value
            else:
                done += [(user, *visit)] if visit else []
                visits[user] = at, at, 1, value
        waiting = [w for w in waiting if w[1] > passed]
        done += [(user, *v) for user, v in visits.items() if self._closes(v) <= passed]
        visits = {user: v for user, v in visits.items() if self._closes(v) > passed}
        for state, rows in ((self.waiting, waiting), (self.visit, [(user, *v) for user, v in visits.items()])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if nexts := [w[1] for w in waiting] + [self._closes(v) for v in visits.values()]:
            self.handle.registerTimer(-(-min(nexts) // 1000))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "began", "ended", "n", "total"])

    def close(self) -> None:
        pass


def capped_visits(events: DataFrame, gap_seconds: int, cap_seconds: int, late: str = "1 hour", groups: int = 256) -> DataFrame:
    """(user_id, began, ended, n, total) of every visit that the watermark has closed. To be started within ``keyed_state_store``."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("of"), "user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("id"), F.coalesce("value", F.lit(0.0)).alias("value"))
    found = rows.groupBy("of").transformWithStateInPandas(Visits(gap_seconds * 1_000_000, cap_seconds * 1_000_000), _OUT, "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n", "total")
