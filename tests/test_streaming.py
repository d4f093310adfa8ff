"""Streaming jobs over files that come one by one: late rows, repeats, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.sources.paths import shared_path
from sparkloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def event(n, minutes, user=1, kind="view", value=1.0):
    return (n, T0 + dt.timedelta(minutes=minutes), user, kind, value, "{}")


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, job, state, out, mode="append"):
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.available(job(stream), out, state, mode)


def test_late_rows_and_restart(spark):
    folder, state, out = (shared_path(spark, n) for n in ("in", "state", "out"))
    job = lambda e: jobs.tumbling_counts(e, "10 minutes", "5 minutes")
    put(spark, folder, "a", [event(1, 1), event(2, 3), event(3, 30)])
    got = run(spark, folder, job, state, out).collect()
    assert [(r.began.minute, r.n) for r in got] == [(0, 2)]
    put(spark, folder, "b", [event(4, 2), event(5, 31), event(6, 60)])  # the first is later than the watermark lets in
    got = run(spark, folder, job, state, out).collect()
    assert sorted((r.began.minute, r.n) for r in got) == [(0, 2), (30, 2)]


def test_repeats_across_batches(spark):
    folder, state, out = (shared_path(spark, n) for n in ("in", "state", "out"))
    put(spark, folder, "a", [event(1, 1), event(1, 1), event(2, 2)])
    run(spark, folder, jobs.without_repeats, state, out)
    put(spark, folder, "b", [event(2, 2), event(3, 3)])
    got = run(spark, folder, jobs.without_repeats, state, out).collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3]


def test_state_across_restarts(spark):
    folder, state, out = (shared_path(spark, n) for n in ("in", "state", "out"))
    put(spark, folder, "a", [event(1, 1, kind="purchase", value=2.0), event(2, 1, user=2)])
    run(spark, folder, jobs.spending, state, out, "update")
    put(spark, folder, "b", [event(3, 2, kind="purchase", value=3.0)])
    got = run(spark, folder, jobs.spending, state, out, "update").collect()
    assert sorted((r.user_id, r.n, r.total) for r in got) == [(1, 1, 2.0), (1, 2, 5.0)]


def test_sessions_and_join(spark):
    folder = shared_path(spark, "in")
    put(spark, folder, "a", [event(1, 0), event(2, 20, kind="purchase"), event(3, 500), event(4, 2000)])
    got = run(spark, folder, lambda e: jobs.session_counts(e, "1 hour", "0 seconds"), shared_path(spark, "s"), shared_path(spark, "o")).collect()
    assert sorted(r.n for r in got) == [1, 2]
    got = run(spark, folder, jobs.purchases_with_view, shared_path(spark, "s"), shared_path(spark, "o")).collect()
    assert [(r.event_id, r.view_id) for r in got] == [(2, 1)]
