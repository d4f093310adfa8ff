"""Patterns, maintained aggregates, bitmaps, reachability, visits, histories and layouts against small brute force."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.bitmaps import bitmap_table, distinct_by, merged
from sparkloom.operators.maintained import MaintainedAggregate
from sparkloom.operators.patterns import Step, match_events, steps_of
from sparkloom.operators.reach import reachable
from sparkloom.operators.sketches import frequent_items, merged_quantiles, sketch_table
from sparkloom.operators.versions import history, temporal_join
from sparkloom.sources.layout import files_for, read_by_curve, write_by_curve
from sparkloom.sources.paths import shared_path
from sparkloom.streaming import jobs
from sparkloom.streaming.visits import capped_visits, keyed_state_store

T0 = dt.datetime(2024, 1, 1)


def test_steps():
    assert steps_of("view+ click|error{0,3} buy{2} x* y? z{1,}") == [Step(("view",), 1, None), Step(("click", "error"), 0, 3), Step(("buy",), 2, 2), Step(("x",), 0, None), Step(("y",), 0, 1), Step(("z",), 1, None)]
    for wrong in ("a{2,1}", "a{0}", "a* b?", "{1}"):
        with pytest.raises(ValueError):
            steps_of(wrong)


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("pattern", ["a+ b|c{0,2} d", "a b", "a|b{2,3} a", "d{1,} a? b*"])
def test_patterns(spark, parts, pattern):
    """One user with most rows, ties in time, nulls, symbols in no step."""
    r = random.Random(5)
    rows = [(n, r.choice(["hot"] * 8 + ["u", None]), r.choice([None, *[T0 + dt.timedelta(minutes=r.randrange(2000))] * 9]), r.choice("aaabbcdde") if r.random() < 0.98 else None) for n in range(600)]
    code = "".join(f"([{''.join(s.symbols)}]{{{s.least},{'' if s.most is None else s.most}}})" for s in steps_of(pattern))
    want = []
    for u in ("hot", "u"):
        own = sorted((t, n, s) for n, k, t, s in rows if k == u and t and s)
        runs, prior = [[]], None
        for t, n, s in own:
            if prior and t - prior > dt.timedelta(minutes=10):
                runs.append([])
            runs[-1].append((t, n, s))
            prior = t
        for run in runs:
            for m in re.finditer(code, "".join(s for _, _, s in run)):
                a, b = run[m.start()], run[m.end() - 1]
                want.append((u, a[1], b[1], a[0], b[0], m.end() - m.start(), [len(g) for g in m.groups()]))
    df = spark.createDataFrame(rows, "n long, u string, t timestamp_ntz, s string").repartition(4)
    got = match_events(df, pattern, key="u", at="t", symbol="s", tie="n", gap="10 MINUTES", partitions=parts)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
    assert match_events(df.limit(0), pattern, key="u", at="t", symbol="s", tie="n", gap="10 MINUTES").count() == 0


def test_maintained(spark):
    """Random inserts and deletes in batches, repeated and compacted anywhere, against all rows at once."""
    r = random.Random(2)
    kept = MaintainedAggregate(spark, shared_path(spark, "maintained"), ["k"], "v")
    with pytest.raises(ValueError, match="nothing"):
        kept.result()
    live, batches = [], []
    for batch in range(5):
        changes = [(r.choice(["a", "b", None]), r.choice([None, *map(Decimal, range(5))]), 1) for _ in range(12)]
        live += [c[:2] for c in changes]
        for _ in range(6 if batch else 0):
            gone = live.pop(r.randrange(len(live)))
            changes.append((*gone, -1))
        batches.append(changes)
        for again in [batch] + ([r.randrange(batch + 1)] if batch % 2 else []):
            kept.apply(again, spark.createDataFrame(batches[again], "k string, v decimal(20,4), sign int"))
        if batch in (1, 3):
            kept.compact()
    kept.apply(9, spark.createDataFrame([], "k string, v decimal(20,4), sign int"))
    kept.apply(10, spark.createDataFrame([(k, v, -1) for k, v in live if k == "b"], "k string, v decimal(20,4), sign int"))
    of = defaultdict(list)
    for k, v in live:
        of[k].append(v)
    del of["b"]
    want = {(k, len(vs), sum(x for x in vs if x is not None), min(x for x in vs if x is not None), max(x for x in vs if x is not None), len({x for x in vs if x is not None})) for k, vs in of.items()}
    assert {tuple(x) for x in kept.result().collect()} == want
    # A compaction that didn't come to its end doesn't count.
    number, _ = kept._merged()
    spark.createDataFrame([("a", Decimal(1), 99)], "k string, value decimal(20,4), n long").write.parquet(f"{kept.path}/base/number={number + 1}")
    assert {tuple(x) for x in kept.result().collect()} == want
    kept.compact()
    kept.compact()
    assert {tuple(x) for x in kept.result().collect()} == want


def test_bitmaps(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2]), r.choice([None, 0, -1, -2, 32767, 32768, 70_000, 2**40, *range(50)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "a string, b int, id long")
    halves = [bitmap_table(df.where(c), ["a", "b"], "id") for c in ("b = 1 OR id > 20", "b = 2 OR id <= 20 OR id IS NULL")]
    stored = merged(*halves)
    sets = [["a", "b"], ["a"], ["b"], []]
    got = {(x.a, x.b, x.grouped): x.n for x in distinct_by(stored, ["a", "b"], sets).collect()}
    want = defaultdict(set)
    for a, b, i in rows:
        if i is not None:
            for s in sets:
                want[a if "a" in s else None, b if "b" in s else None, 2 * ("a" not in s) + ("b" not in s)].add(i)
    assert got == {k: len(v) for k, v in want.items()}
    assert distinct_by(bitmap_table(df.limit(0), ["a", "b"], "id"), ["a", "b"], sets).where("n > 0").count() == 0


def test_reachable(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(0, n) for n in range(100, 160)] + [(None, 3), (3, None), (5, 5)]
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    for sources in ([0, 7], [59, 59, None], [999], []):
        want, front, step = {s: 0 for s in sources if s is not None}, set(sources) - {None}, 0
        while front:
            step += 1
            front = {b for a in front for b in to[a] if b is not None and b not in want}
            want |= dict.fromkeys(front, step)
        df = spark.createDataFrame(edges, "a long, b long")
        start = spark.createDataFrame([(s,) for s in sources], "s long")
        assert {x.node: x.steps for x in reachable(df, start).collect()} == want
        assert {x.node: x.steps for x in reachable(df, start, most_steps=1).collect()} == {n: s for n, s in want.items() if s <= 1}


def test_visits_across_batches(spark):
    """Out of order within the watermark, over several batches and a restart: as if all came at once; state goes."""
    r = random.Random(8)
    events, minute = [], {1: 0, 2: 0}
    for n in range(120):
        u = 1 if r.random() < 0.8 else 2
        minute[u] += r.choice([1, 5, 9, 31, 70])
        events.append((n, T0 + dt.timedelta(minutes=minute[u]), u, "view", float(n), "{}"))
    end = max(e[1] for e in events) + dt.timedelta(days=2)
    gap, cap = dt.timedelta(minutes=30), dt.timedelta(minutes=60)
    want = []
    for u in (1, 2):
        own = sorted(e[:2][::-1] + (e[4],) for e in events if e[2] == u)
        visit = None
        for t, _, v in own:
            if visit and t - visit[1] <= gap and t - visit[0] <= cap:
                visit = [visit[0], t, visit[2] + 1, visit[3] + v]
            else:
                want += [visit] if visit else []
                visit = [t, t, 1, v]
        want.append(visit)
    folder, state, out = (shared_path(spark, n) for n in ("in", "state", "out"))

    def put(name, rows):
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")

    def run():
        stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))
        with keyed_state_store(spark):
            return jobs.available(capped_visits(stream, 1800, 3600, "3 hours"), out, state)

    order = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=r.randrange(120)))
    put("a", order[:40])
    put("b", order[40:80])
    run()
    put("c", [*order[80:], (999, T0 - dt.timedelta(days=1), 1, "view", 1.0, "{}")])  # the last is too late
    put("d", [(1000, end, 3, "view", 0.0, "{}")])
    got = run()
    assert sorted((x.began, x.ended, x.n, x.total) for x in got.collect()) == sorted(map(tuple, want))
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "visit").load()
    assert [x.key[0] for x in left.select("key").collect()] in ([], [3])


def test_visits_of_many_users_share_states(spark):
    """Users of one group go on, close and wait at different times, over batches; there are as many states as groups, not as users."""
    r = random.Random(3)
    events = [(n, T0 + dt.timedelta(minutes=r.randrange(600)), r.randrange(60), "view", float(n), "{}") for n in range(500)]
    gap, cap = dt.timedelta(minutes=30), dt.timedelta(minutes=60)
    want = []
    for u in range(60):
        visit = None
        for t, _, v in sorted((e[1], e[0], e[4]) for e in events if e[2] == u):
            if visit and t - visit[2] <= gap and t - visit[1] <= cap:
                visit = [u, visit[1], t, visit[3] + 1, visit[4] + v]
            else:
                want += [visit] if visit else []
                visit = [u, t, t, 1, v]
        want += [visit] if visit else []
    folder, state, out = (shared_path(spark, n) for n in ("in", "state", "out"))
    events.sort(key=lambda e: e[1] + dt.timedelta(minutes=r.randrange(50)))

    def run(name, rows):
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))
        with keyed_state_store(spark):
            return jobs.available(capped_visits(stream, 1800, 3600, "1 hour", groups=3), out, state)

    run("a", events[:300])
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "visit").load().select("key.*", "list_element.*").collect()
    assert {x.of for x in left} <= {0, 1, 2} and len({x.user for x in left}) > 3
    got = run("b", [*events[300:], (1000, T0 + dt.timedelta(days=1), 99, "view", 0.0, "{}")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_histories(spark):
    """Against a walk over every moment: ties, repeated values, gaps, open ends, long versions, a hot key."""
    r = random.Random(4)

    def changes(n, values):
        return [(r.choice(["hot"] * 5 + ["u", "v", None]), r.choice([None, *range(200)]), i, r.choice(values)) for i in range(n)]

    def walk(rows):
        last = {}
        for k, t, i, v in rows:
            if k is not None and t is not None and i >= last.get((k, t), (-1, None))[0]:
                last[k, t] = (i, v)
        at, now = {}, {}
        for t in range(201):
            for k in ("hot", "u", "v"):
                if (k, t) in last:
                    now[k] = last[k, t][1]
                at[k, t] = now.get(k)
        return at

    a, b = changes(120, ["x", "y", None]), changes(25, [1, 2, None])
    frames = [spark.createDataFrame(rows, f"k string, t int, i int, {c} {kind}").repartition(3) for rows, c, kind in ((a, "p", "string"), (b, "q", "int"))]
    for parts in (1, 11):
        one, two = (history(df, ["k"], "t", [c], ["i"], parts) for df, c in zip(frames, "pq", strict=True))
        for got, rows, c in ((one, a, "p"), (two, b, "q")):
            found, want = {}, {x: v for x, v in walk(rows).items() if v is not None}
            for x in got.collect():
                for t in range(x.since, 201 if x.until is None else x.until):
                    assert (x.k, t) not in found
                    found[x.k, t] = x[c]
            assert found == want
        pieces, wa, wb = temporal_join(one, two, ["k"], parts).collect(), walk(a), walk(b)
        found = {}
        for x in pieces:
            for t in range(x.since, 201 if x.until is None else x.until):
                assert (x.k, t) not in found
                found[x.k, t] = (x.p, x.q)
        assert found == {x: (wa[x], wb[x]) for x in wa if wa[x] is not None and wb[x] is not None} and len(pieces) > 20
    with pytest.raises(ValueError, match="both sides"):
        temporal_join(one, one, ["k"])


def test_curve_opens_few_files(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = shared_path(spark, "curve")
    write_by_curve(lines, path, ["l_shipdate", "l_extendedprice"], 64)
    ranges = {"l_shipdate": (dt.datetime(1997, 1, 1), dt.datetime(1997, 6, 30)), "l_extendedprice": (20000.0, 26000.0)}
    files, all_ = files_for(spark, path, ranges)
    assert all_ >= 50 and len(files) <= all_ * 0.15
    got = read_by_curve(spark, path, ranges)
    assert got.count() == lines.where("l_shipdate BETWEEN '1997-01-01' AND '1997-06-30' AND l_extendedprice BETWEEN 20000 AND 26000").count() > 0
    assert got.columns == lines.columns and spark.read.parquet(path).count() == lines.count()
    assert read_by_curve(spark, path, {"l_extendedprice": (-2.0, -1.0)}).count() == 0
    few = spark.createDataFrame([(None, 1), (2.0, None), (None, None)], "x double, y int")
    write_by_curve(few, path := shared_path(spark, "curve"), ["x", "y"], 3)
    assert read_by_curve(spark, path, {"x": (0, 9)}).count() == 1


def test_sketches(spark):
    """Frequent items are exact after merging; quantiles keep their bound."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(5), r.choice([None, *[int(r.paretovariate(0.6)) % 5000] * 9]), r.gauss(0, 1)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, d int, item long, x double")
    table = sketch_table(df, ["g", "d"], "item", "x", 0.01)
    of = defaultdict(lambda: defaultdict(int))
    for g, _, i, _ in rows:
        if i is not None:
            of[g][i] += 1
    want = {(g, i, n) for g, c in of.items() for i, n in c.items() if n > 0.01 * sum(c.values())}
    assert {tuple(x) for x in frequent_items(table, df, ["g"], "item", 0.01).collect()} == want and len(want) > 20
    for x in merged_quantiles(table, ["g"], [0.1, 0.5, 0.99]).collect():
        own = sorted(v for g, _, _, v in rows if g == x.g)
        assert abs(sum(v <= x.value for v in own) / len(own) - x.share) < 0.03
    assert frequent_items(sketch_table(df.limit(0), ["g"], "item", "x", 0.01), df, ["g"], "item", 0.01).count() == 0
