"""Running values of hot keys against plain windows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.operators import scan
from sparkloom.operators.skew import hot_key_join


def rows(spark, n=600, hot=0.9, seed=3):
    r = random.Random(seed)
    data = [(i, "hot" if r.random() < hot else r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.choice([None, *range(-9, 9)])) for i in range(n)]
    return spark.createDataFrame(data, "n long, k string, t int, v long").repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("keys", [["k"], [], ["k", "t"]])
def test_folds(spark, parts, keys):
    df = rows(spark)
    s = scan.in_order(df, keys, ["t", "n"], parts)
    assert s.rows.select(F.spark_partition_id()).count() == 600
    folds = {f"{kind}_{frame}": (getattr(scan, kind)(*([] if kind == "count" else ["v"]), frame)) for kind in ("count", "total", "least", "greatest", "xor", "latest") for frame in scan.FRAMES if (kind, frame) != ("latest", "all")}
    got = s.scan(**folds).result()
    w = W.partitionBy(*keys).orderBy("t", "n")
    frames = {"upto": w.rowsBetween(W.unboundedPreceding, 0), "before": w.rowsBetween(W.unboundedPreceding, -1), "after": w.rowsBetween(1, W.unboundedFollowing), "all": W.partitionBy(*keys)}
    plain = {"count": F.count(F.lit(1)), "total": F.sum("v"), "least": F.min("v"), "greatest": F.max("v"), "xor": F.bit_xor("v")}
    want = df.select("n", "k", "t", "v", *[(F.first("v", ignorenulls=True).over(frames["after"]) if (f.kind, f.frame) == ("latest", "after") else F.last("v", ignorenulls=True).over(frames[f.frame]) if f.kind == "latest" else plain[f.kind].over(frames[f.frame])).alias(name) for name, f in folds.items()])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_rows_left_out_between_scans(spark):
    """Blocks whose first rows are gone still take over what lies before them."""
    df = rows(spark)
    s = scan.in_order(df, ["k"], ["t", "n"], 40).scan(no=scan.count())
    got = s.with_rows(s.rows.where("no % 3 = 0")).scan(sum=scan.total("no"), rest=scan.count("after")).result()
    w = W.partitionBy("k").orderBy("no")
    want = got.select("n", F.sum("no").over(w).alias("sum"), F.count(F.lit(1)).over(w.rowsBetween(1, W.unboundedFollowing)).alias("rest"))
    assert sorted(map(tuple, got.select("n", "sum", "rest").collect())) == sorted(map(tuple, want.collect())) and got.count() > 150


def test_no_block_holds_a_hot_key(spark):
    """With nine tenths of the rows in one key, and these all tied, blocks stay near their share."""
    df = rows(spark, 3000).withColumn("t", F.when(F.col("k") == "hot", 1).otherwise(F.col("t")))
    s = scan.in_order(df, ["k"], ["t"], 20)
    most = s.rows.groupBy(F.shiftright(s.place, 33)).count().agg(F.max("count")).first()[0]
    assert most < 3 * 3000 / 20


@pytest.mark.parametrize("parts", [1, 13])
def test_ranks(spark, parts):
    df = rows(spark).withColumn("_prior", F.lit("kept"))
    with pytest.raises(ValueError, match="there already"):
        scan.ranks(df, ["k"], ["t"], parts)
    df = df.drop("_prior")
    w = W.partitionBy("k").orderBy("t")
    want = df.select("n", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.round(F.percent_rank().over(w), 12).alias("p"), F.round(F.cume_dist().over(w), 12).alias("c"))
    got = scan.ranks(df, ["k"], ["t"], parts)
    assert sorted(map(tuple, got.select("n", "rank", "dense_rank", F.round("percent_rank", 12), F.round("cume_dist", 12)).collect())) == sorted(map(tuple, want.collect()))
    numbers = got.groupBy("k").agg(F.count_distinct("row_number").alias("d"), F.max("row_number").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.d == r.m == r.n for r in numbers)
    assert scan.ranks(df.limit(0), ["k"], ["t"]).count() == 0


def test_tile(spark):
    for n in (0, 1, 3, 4, 10, 11):
        df = spark.range(n).select((F.col("id") + 1).alias("i"), F.lit(n).cast("long").alias("n"))
        assert all(r.a == r.b for r in df.select(scan.tile(F.col("i"), F.col("n"), 4).alias("a"), F.ntile(4).over(W.orderBy("i")).alias("b")).collect())


def test_bad_frames():
    with pytest.raises(ValueError, match="no such frame"):
        scan.Fold("count", None, "sideways")
    with pytest.raises(ValueError, match="nearest"):
        scan.latest(None, "all")
    assert fresh(["a", "_X"], "_x", "_x", "b") == ["_x_1", "_x_2", "b"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_join(spark, how):
    facts = rows(spark).select("n", "k", "t")
    dims = spark.createDataFrame([("hot", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, d int, e string")
    got = hot_key_join(facts, dims, ["k"], how, most=10, least=20)
    assert sorted(map(str, got.select("n", "k", "t", "d", "e").collect())) == sorted(map(str, facts.join(dims, ["k"], how).select("n", "k", "t", "d", "e").collect()))
    with pytest.raises(ValueError, match="both sides"):
        hot_key_join(facts, dims.withColumnRenamed("d", "t"), ["k"])
    with pytest.raises(ValueError, match="inner and left"):
        hot_key_join(facts, dims, ["k"], "full")
