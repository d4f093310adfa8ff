import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import onebit
from sparkloom.llm.queries import op2_onebit_nearest


def brute(rows, k=5, divisor=50):
    out = set()
    for q, x in rows:
        if q % divisor == 0:
            scored = sorted(((-float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))), v) for v, y in rows if v != q))
            out |= {(q, v) for _, v in scored[:k]}
    return out


def test_recall_and_share_reranked(spark):
    path = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{path}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    got = op2_onebit_nearest(spark, path).collect()
    want = brute(rows)
    recall = len({(r.query_id, r.vec_id) for r in got} & want) / len(want)
    coded, _, asked, found = onebit.chosen(table, F.col("id") % 50 == 0)
    share = found.count() / coded.count() / asked.count()
    print("recall", recall, "share of pairs reranked", share)
    assert recall >= 0.99 and share < 0.2
    vectors = dict(rows)
    for r in got:
        x, y = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) < 1e-12


def test_estimates_lie_within_their_bounds():
    x = np.random.default_rng(1).standard_normal((400, 64))
    codes, fit = onebit.encode(x)
    near, sd = onebit.estimate(codes, fit, x[:50])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = np.abs(near - unit[:50] @ unit.T)
    assert (off <= 3 * sd).mean() > 0.99 and off.mean() < 0.04


def test_groups_of_copies(spark):
    """Many equal vectors, also among the queries, over several shards and blocks."""
    r = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else r.standard_normal(3).round(1).tolist()) for i in range(400)]
    rows = [(i, v) for i, v in rows if any(v)] + [(50, [0.5, 0.5, 0.5]), (51, [3.0, 2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in onebit.nearest(table, F.col("id") % 10 == 0, 5, sigmas=6.0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.score, x.vec_id))
    for q in {i for i, _ in rows if i % 10 == 0}:
        best = {}
        for i, v in rows:
            if i != q:
                for j, w in rows:
                    if j == q:
                        s = float(onebit.cosine(np.array([w], float), np.array([v], float))[0])
                        best[i] = max(best.get(i, -2), s)
        want = sorted(((-s, i) for i, s in best.items()))[:5]
        assert [(rank, v) for rank, _, v in sorted(got[q])] == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (50, None, 1), (1, [0.0, 0.0], 1), (2, [float("nan"), 1.0], 1), (3, [None, 1.0], 1), (4, [2.0, 0.0], 1), (5, [2.0, 0.0], 1), (5, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = [tuple(r) for r in onebit.nearest(table, F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 1.0), (0, 2, 5, 1.0)]
    assert onebit.nearest(table.where("false"), F.col("id") % 50 == 0).count() == 0


def test_many_shards_and_blocks(spark, monkeypatch):
    """Every shard meets every block; what is found doesn't depend on how rows are dealt, nor on whether queries are broadcast."""
    monkeypatch.setattr(onebit, "SHARD_ROWS", 100)
    monkeypatch.setattr(onebit, "BLOCK_ROWS", 8)
    monkeypatch.setattr("sparkloom.llm.common.BROADCAST_BYTES", 100)
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16 if i % 4 else 7).tolist()) for i in range(700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.vec_id) for x in onebit.nearest(table, F.col("id") % 20 == 0, 5, sigmas=6.0).collect()}
    want = set()
    for dim in (7, 16):
        same = [(i, np.array(v)) for i, v in rows if len(v) == dim]
        want |= brute(same, 5, 20)
    assert got == want and len(got) == 35 * 5
