"""Joins by time and by range, skewed keys, files and vectors, on small rows."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import vectors
from sparkloom.operators.asof import asof_join
from sparkloom.operators.quantiles import exact_quantiles
from sparkloom.operators.ranges import range_join
from sparkloom.operators.scan import in_order
from sparkloom.operators.skew import salted_distinct_count, salted_join
from sparkloom.plans.udfs import exact_sum, jaro_winkler
from sparkloom.sources import files
from sparkloom.sources.paths import shared_path
from sparkloom.sources.tables import table


def test_asof(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 5, "a"), (3, 10, None), (4, None, "a"), (5, 1, "b")], "n int, t int, k string")
    right = spark.createDataFrame([(10, "a", "x"), (10, "a", "y"), (4, "a", "w"), (9, None, "z"), (None, "a", "q")], "t int, k string, v string")
    assert {r.n: r.v for r in asof_join(left, right, "t", ["k"]).collect()} == {1: "y", 2: "w", 3: "z", 4: None, 5: None}
    times = lambda rows, names: spark.createDataFrame(rows, names).withColumn("t", F.timestamp_seconds("t"))
    got = asof_join(times([(1, 100), (2, 1000)], "n int, t int"), times([(90, 7)], "t int, v int"), "t", [], "60 SECONDS")
    assert {r.n: r.v for r in got.collect()} == {1: 7, 2: None}
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, right.withColumn("n", F.lit(1)), "t", ["k"])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_asof_in_cells(spark, size):
    """Split or not, the same rows: ties, nulls, cells with one side alone, a hot key."""
    r = random.Random(size)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = spark.createDataFrame([(n, r.choice([None, *range(-20, 60)]), key()) for n in range(200)], "n int, t int, k string")
    right = spark.createDataFrame([(r.choice([None, *range(-20, 60)]), key(), n) for n in range(80)], "t int, k string, v int")
    whole, split = (sorted(map(str, asof_join(left, right, "t", ["k"], cell=c).collect())) for c in (None, F.floor(F.col("t") / size)))
    assert whole == split


def test_exact_quantiles(spark):
    r = random.Random(4)
    rows = [("a", r.gauss(0, 1)) for _ in range(501)] + [("b", 7.0)] * 40 + [("c", float(r.choice([1, 1, 1, 1, 2, 1e9]))) for _ in range(100)] + [("d", None), (None, 3.0), ("e", -1e308), ("e", 1e308)]
    df = spark.createDataFrame(rows, "k string, v double")
    for partitions in (1, 16, None):
        got = {x.k: (x.p0, x.med, x.p9) for x in exact_quantiles(df, "k", "v", {"p0": 0.0, "med": 0.5, "p9": 0.9}, partitions).collect()}
        assert got.keys() == {"a", "b", "c", None, "e"}
        for k in ("a", "b", "c", None):
            assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], [0, 0.5, 0.9]))


def test_quantiles_beside_an_outlier(spark):
    """One far value doesn't put the others into one task: the blocks that the scan runs over stay near their share."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 2e9).otherwise(F.col("id") / 7).alias("v"))
    blocks = in_order(df, ["k"], ["v"], 20)
    assert blocks.rows.groupBy(F.shiftright(blocks.place, 33)).count().agg(F.max("count")).first()[0] < 3000
    assert exact_quantiles(df, "k", "v", {"med": 0.5}, 20).first().med == pytest.approx((10_000 + 10_001) / 2 / 7)


@pytest.mark.parametrize("width", [1, 7, 100])
def test_range(spark, width):
    spans = spark.createDataFrame([(0, -5, 5), (1, 5, 5), (2, 9, 3), (3, None, 4), (4, 0, 40)], "s int, low long, high long")
    points = spark.createDataFrame([(x,) for x in (-5, 0, 5, 6, 41, None)], "at long")
    got = {(r.s, r.at) for r in range_join(points, spans, "at", "low", "high", width).collect()}
    assert got == {(s, x) for s, lo, hi in ((0, -5, 5), (1, 5, 5), (4, 0, 40)) for x in (-5, 0, 5, 6, 41) if lo <= x <= hi}


def test_skew(spark):
    facts = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), (F.col("id") % 90).alias("v"))
    assert {r.k: r.n for r in salted_distinct_count(facts, "k", "v").collect()} == {"hot": 90, "k0": 30, "k1": 30, "k2": 30}
    dims = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, d int")
    want = sorted((r.k, r.v, r.d) for r in facts.join(dims, "k").collect())
    assert sorted((r.k, r.v, r.d) for r in salted_join(facts, dims, "k").collect()) == want
    assert salted_join(facts, dims, "k", how="left").count() == 500
    with pytest.raises(ValueError, match="inner and left"):
        salted_join(facts, dims, "k", how="full")


@pytest.mark.parametrize("kind", files.FORMATS)
def test_files_give_back_what_was_written(spark, kind):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', 1.5, "p"), (2, None, None, "q"), (3, "", -0.25, "p"), (None, "é 日", 1e300, "q")], "n long, s string, x double, k string")
    path = shared_path(spark, kind)
    files.write(rows, path, kind, partition_by=("k",))
    back = files.read(spark, path, kind, rows.schema).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_bad_names(spark, sf_dir):
    with pytest.raises(ValueError, match="no such table"):
        table(spark, sf_dir, "nothing")
    with pytest.raises(ValueError, match="no such format"):
        files.write(spark.range(1), "x", "xls")
    with pytest.raises(ValueError, match="needs a schema"):
        files.read(spark, "x", "csv")


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.distance(F.col("a"), F.col("b"))).first()
    assert got[:4] == (24.0, 5.0, 0.96, None) and math.isclose(got[4], math.sqrt(2))


def test_exact_sums(spark):
    r = random.Random(9)
    rows = [(k, v) for k in ("a", "b", None) for v in [1e308, -1e308, 1e-320, 0.1, -0.1, 1e16, 1.0, -1e16, *[r.uniform(-1, 1) * 10.0 ** r.randrange(-30, 30) for _ in range(200)]]] + [("c", None), ("a", math.inf), ("d", 5e-324), ("d", -0.0)]
    r.shuffle(rows)
    got = {x.k: x.total for x in exact_sum(spark.createDataFrame(rows, "k string, v double").repartition(7), "k", "v").collect()}
    assert got == {k: math.fsum(v for x, v in rows if x == k and v is not None and math.isfinite(v)) for k in ("a", "b", None, "d")}


def test_jaro_winkler():
    assert jaro_winkler("", "") == 1 and jaro_winkler("a", "") == 0 and jaro_winkler("ab", "cd") == 0 and jaro_winkler("same", "same") == 1
    assert math.isclose(jaro_winkler("MARTHA", "MARHTA"), 0.9611111, rel_tol=1e-6) and math.isclose(jaro_winkler("DIXON", "DICKSONX"), 0.8133333, rel_tol=1e-6)


def test_broken_optional_modules_are_told(monkeypatch, tmp_path):
    (tmp_path / "broken_part.py").write_text("import nothing_of_this_name\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="broken_part"):
        assert entry._optional("broken_part") is None
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert entry._optional("sparkloom.gone.queries") is None
