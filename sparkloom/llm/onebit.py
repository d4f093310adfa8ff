"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to unit length and turned by one random matrix with orthonormal
columns into ``BITS`` dimensions (or its own number, if larger); its code is the signs of
the result, packed. With the code goes a scalar, ``fit``: the inner product of the turned
vector with its own code read as +-1/sqrt(bits). The inner product of a turned query and
the code, divided by ``fit``, estimates the cosine without bias, with a standard deviation
of about ``sqrt(1 - fit^2) / fit / sqrt(bits - 1)`` (Gao and Long, 2024). Queries are
rounded to ``PLANES`` bits a dimension, so inner products are counts of common bits, and
the rounding widens the bound by its own standard deviation.

A search goes over the codes twice, never over the vectors. First every query takes the
k + 1 rows of largest estimate; the least of their exact cosines is a bar that the k-th
best reaches for certain. Then every row whose upper bound (``sigmas`` standard deviations)
reaches the query's bar is reranked: its vector is fetched and its exact cosine taken.

Codes are dealt to shards and queries, as bit planes, to blocks, both of bounded size
whatever the vectors' length up to ``BITS``, and each shard meets each block once in a
task that holds one of either. A code is sent once for each block of queries, a query
once for each shard, so N rows and M queries shuffle about ``N * M * (100 / BLOCK_ROWS +
300 / SHARD_ROWS)`` bytes. Of equal vectors only the k + 1
smallest ids can be among anyone's k nearest, so the rest of a group of copies isn't
searched, and queries with equal vectors are searched once.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do rows without an id; repeated rows count once; an id
that stands on several different vectors is searched with each and has, with any
other id, the largest of their scores; vectors are compared only with vectors of
their length; equal scores go by the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import held, stored, tasks

BITS = 512
PLANES = 4
SHARD_ROWS = 131_072
BLOCK_ROWS = 32_768
#: Rows from which a shard is worth a task of its own.
LEAST_ROWS = 2048
#: Query vectors, of 64 MB together, up to which they are broadcast to be reranked; beyond that Spark picks the join.
BROADCAST_QUERIES = 200_000
SIGMAS = 3.0
SEED = 20240607


def bits_of(dim: int) -> int:
    return -(-max(BITS, dim) // 64) * 64


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random matrix of dim x bits with orthonormal rows, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((bits_of(dim), dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T.astype(np.float32))


def turned(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length and turned. The largest component is divided out first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32) @ rotation(x.shape[1])


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each vector, in words of 64 bits, and its fit."""
    t = turned(x)
    return np.packbits(t > 0, axis=1).view(np.uint64), np.abs(t).sum(axis=1) / np.float32(math.sqrt(t.shape[1]))


def rounded(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turned queries as bit planes (query, plane, word), least value, step, and sum of the rounded values."""
    t = turned(queries)
    low = t.min(axis=1, keepdims=True)
    step = np.maximum((t.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), np.float32(1e-9))
    level = np.rint((t - low) / step).astype(np.uint8)
    planes = np.stack([np.packbits(level >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)], axis=1)
    return planes, low[:, 0], step[:, 0], (low * t.shape[1] + step * level.sum(axis=1, keepdims=True))[:, 0]


def estimate(codes: np.ndarray, fit: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x codes) and their standard deviations."""
    return estimate_rounded(codes, fit, *rounded(queries))


def estimate_rounded(codes: np.ndarray, fit: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of ``rounded`` queries, from the bits that codes and planes have in common."""
    bits = codes.shape[1] * 64
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    out = np.empty((len(planes), len(codes)), np.float32)
    for i, own in enumerate(planes):
        common = sum(np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int32) << p for p, plane in enumerate(own))
        out[i] = (2 * (low[i] * ones + step[i] * common) - total[i]) / np.float32(math.sqrt(bits)) / fit
    own = np.maximum(0, 1 - fit * fit) / max(1, bits - 1)
    return out, np.sqrt(own[None, :] + step[:, None] ** 2 / 12) / fit[None, :]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid(vector: Column) -> Column:
    """Whether a vector can be compared."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def comparable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The distinct rows that take part: id, vector, its hash and its length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vector"))).dropDuplicates(["id", "vector"])
    return rows.withColumns({"h": F.xxhash64("vector"), "dim": F.size("vector")})


def index(rows: DataFrame) -> DataFrame:
    """``comparable`` rows with their codes: id, h, vector, dim, code, fit."""

    def coded(batches):
        for pdf in batches:
            for _, part in pdf.groupby("dim"):
                codes, fit = encode(np.stack(part["vector"].to_numpy()))
                yield part.assign(code=[c.tobytes() for c in codes], fit=fit.astype(np.float64))

    return rows.select("id", "h", "vector", "dim").mapInPandas(coded, "id long, h long, vector array<double>, dim int, code binary, fit double")


def planed(asked: DataFrame) -> DataFrame:
    """The queries (qid, qh, vector, dim) as they are sent to the codes: qid, qh, dim, planes, low, step, total."""

    def of(batches):
        for pdf in batches:
            for _, part in pdf.groupby("dim"):
                planes, low, step, total = rounded(np.stack(part["vector"].to_numpy()))
                yield part[["qid", "qh", "dim"]].assign(planes=[p.tobytes() for p in planes], low=low, step=step, total=total)

    return asked.select("qid", "qh", "vector", "dim").mapInPandas(of, "qid long, qh long, dim int, planes binary, low float, step float, total float")


_FOUND = ["qid", "qh", "id", "h"]


def _scan(codes: DataFrame, sent: DataFrame, shards: int, blocks: int, pick) -> DataFrame:
    """(qid, qh, id, h, near) of the rows that ``pick`` chooses of each shard for each query. A task holds one shard's codes and one block's queries; what it finds leaves it after every 16 queries."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None).cast("float")
    left = codes.withColumn("shard", F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    left = left.select("dim", "shard", "block", F.lit(False).alias("asks"), "id", "h", F.col("code").alias("bits"), F.col("fit").cast("float").alias("fit"), *[nothing.alias(c) for c in ("low", "step", "total", "bar")])
    right = sent.withColumn("block", F.pmod(F.xxhash64("qh", "qid"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    right = right.select("dim", "shard", "block", F.lit(True).alias("asks"), F.col("qid").alias("id"), F.col("qh").alias("h"), F.col("planes").alias("bits"), nothing.alias("fit"), "low", "step", "total", "bar")

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        base, queries = rows[~rows["asks"]], rows[rows["asks"]]
        if len(base) and len(queries):
            codes = np.frombuffer(b"".join(base["bits"]), np.uint64).reshape(len(base), -1)
            fit, ids, hashes = base["fit"].to_numpy(np.float32), base["id"].to_numpy(), base["h"].to_numpy()
            for at in range(0, len(queries), 16):
                part = queries.iloc[at : at + 16]
                planes = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), PLANES, -1)
                near, sd = estimate_rounded(codes, fit, planes, *[part[c].to_numpy(np.float32) for c in ("low", "step", "total")])
                q, x = pick(near, sd, part["bar"].to_numpy(np.float32))
                yield pd.DataFrame({"qid": part["id"].to_numpy()[q], "qh": part["h"].to_numpy()[q], "id": ids[x], "h": hashes[x], "near": near[q, x].astype(np.float64)})

    return left.unionByName(right).groupBy("dim", "shard", "block").applyInPandas(both, "qid long, qh long, id long, h long, near double")


def _exact(found: DataFrame, coded: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, qh, id, score): the exact cosines of what was found."""
    vectors = coded.select("id", "h", F.col("vector").alias("x"))
    queries = held(asked.select("qid", "qh", F.col("vector").alias("q")), BROADCAST_QUERIES, 8 * F.size("q"))
    rows = found.select(*_FOUND).join(vectors, ["id", "h"]).join(queries, ["qid", "qh"]).select("qid", "qh", "id", "x", "q")

    def scored(batches):
        for pdf in batches:
            if len(pdf):
                sizes = pdf["x"].map(len).to_numpy()
                for n in np.unique(sizes):
                    part = pdf[sizes == n]
                    yield part[["qid", "qh", "id"]].assign(score=cosine(np.stack(part["q"].to_numpy()), np.stack(part["x"].to_numpy())))

    got = rows.mapInPandas(scored, "qid long, qh long, id long, score double")
    return got.groupBy("qid", "qh", "id").agg(F.max("score").alias("score"))


def _first(rows: DataFrame, by: tuple, order: tuple, k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def chosen(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", sigmas: float = SIGMAS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The searched rows with their codes, the queries (id, qid, qh), their distinct vectors (qid, qh, vector, dim), and the rows that are reranked for each."""
    rows = stored(comparable(vectors, id_col, vector_col))
    searched = _first(rows, ("vector",), ("id",), k + 1)
    coded = stored(index(searched))
    asks = rows.where(queries)
    asked = stored(asks.groupBy("vector").agg(F.min("id").alias("qid")).select("qid", F.xxhash64("vector").alias("qh"), "vector", F.size("vector").alias("dim")))
    named = asks.select("id", "vector").join(asked.select("qid", "qh", "vector"), "vector").select("id", "qid", "qh")

    n, m = coded.count(), asked.count()
    shards = max(1, -(-n // SHARD_ROWS), min(tasks(rows.sparkSession), n // LEAST_ROWS))
    blocks = max(1, -(-m // BLOCK_ROWS))
    codes = coded.select("id", "h", "dim", "code", "fit")
    sent = stored(planed(asked))

    def best(near: np.ndarray, sd: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if near.shape[1] <= k + 1:
            return tuple(x.ravel() for x in np.indices(near.shape))
        x = np.argpartition(-near, k, axis=1)[:, : k + 1]
        return np.repeat(np.arange(len(near)), k + 1), x.ravel()

    def open_(near: np.ndarray, sd: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(near + sigmas * sd >= bar[:, None])

    first = _first(_scan(codes, sent.withColumn("bar", F.lit(None).cast("float")), shards, blocks, best), ("qid", "qh"), (F.desc("near"), "id", "h"), k + 1)
    least = _exact(first, coded, asked).groupBy("qid", "qh").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bars = stored(least.select("qid", "qh", F.when(F.col("n") > k, F.col("least") - 1e-6).otherwise(-2.0).alias("bar")))
    found = stored(_scan(codes, sent.join(bars, ["qid", "qh"]), shards, blocks, open_))
    return coded, named, asked, found


def nearest(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", sigmas: float = SIGMAS) -> DataFrame:
    """The k nearest rows by cosine of each row for which ``queries`` (over the column ``id``) holds: query_id, rank, vec_id, score."""
    coded, named, asked, found = chosen(vectors, queries, k, id_col=id_col, vector_col=vector_col, sigmas=sigmas)
    best = _first(_exact(found, coded, asked), ("qid", "qh"), (F.desc("score"), "id"), k + 1).select("qid", "qh", F.col("id").alias("vec_id"), "score")
    each = named.join(best, ["qid", "qh"]).where(F.col("id") != F.col("vec_id"))
    each = each.groupBy(F.col("id").alias("query_id"), "vec_id").agg(F.max("score").alias("score"))
    return _first(each, ("query_id",), (F.desc("score"), "vec_id"), k).select("query_id", "rank", "vec_id", "score")
