"""From buckets to verified links: what the two MinHash operators share.

A node is a distinct set of shingles. Nodes that agree in a band meet in a bucket. A
bucket may hold a third of all nodes, so its pairs are never made into rows. Instead:

1. every member is paired with a smaller one, as a rule the bucket's smallest (a bucket
   of two is its smallest and its largest, which one aggregate gives), and the pairs that a
   verifier confirms are joined into components;
2. where a bucket still holds several components, the members outside its largest one
   are compared with all members, block by block: a task holds one block of either side,
   skips what is already in one component, compares signatures, makes the sets of what is
   left once for each block, and returns only links.

A pair that meets in a bucket is then compared, in the first band that it shares, or in
one component already; what is not compared could change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import held, stored
from sparkloom.llm.components import components

#: Nodes in a block.
BLOCK = 512
#: Buckets of three and more up to which their numbers are broadcast; beyond that the bands are shuffled again.
BROADCAST_BUCKETS = 500_000
#: Standard deviations by which the share of equal places may stay below the threshold before a pair isn't compared.
SIGMAS = 5.0
#: Low bits of a bucket's number that hold its band.
BAND_BITS = 8
#: Pairs of signatures that are compared at once.
PAIRS = 1 << 14


def least_share(percent: int, places: int) -> float:
    """The share of equal places from which a pair of signatures is looked at."""
    p = percent / 100
    return p - SIGMAS * (p * (1 - p) / places) ** 0.5


def bucket_of(band: Column, places: Column) -> Column:
    """The number of the bucket of these places: their hash, with the band in its low bits."""
    return F.shiftleft(F.xxhash64(band, places), BAND_BITS).bitwiseOR(band.cast("long"))


def signature_rows(column: pd.Series, kind: type = np.uint16) -> np.ndarray:
    """Signatures as a matrix."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(few) < percent * len(many) or not len(few):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def buckets(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` and ``shared`` for ``link`` from all (bucket, node) rows."""
    met = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).cast("int").alias("members"))
    met = stored(met.where(F.col("first") != F.col("last")))
    large = held(stored(met.where("members > 2").select("bucket", "first")), BROADCAST_BUCKETS)
    return met.where("members = 2").select(F.col("first").alias("a"), F.col("last").alias("b")), stored(bands.join(large, "bucket").select("bucket", "first", "node"))


def starts(rows: pd.DataFrame) -> np.ndarray:
    """Whether a row is the first of its (bucket, p, q)."""
    out = np.ones(len(rows), bool)
    out[1:] = np.any([(v := rows[c].to_numpy())[1:] != v[:-1] for c in ("bucket", "p", "q")], axis=0)
    return out


def pairs_apart(rows: pd.DataFrame, percent: int, band: int, kind: type) -> Iterator[tuple[int, int, int]]:
    """(group, row, row) of the pairs of whole groups that signatures leave open, most alike first within a slice.

    Rows have bucket, p, q, x and y (on which side they stand), node, root, largest, n and sig; rows of a group follow each other.
    """
    start = starts(rows)
    group = np.cumsum(start) - 1
    band_of = rows["bucket"].to_numpy()[start] & (1 << BAND_BITS) - 1
    node, root = (pd.factorize(rows[c], sort=c == "node")[0] for c in ("node", "root"))
    outside = (rows["root"] != rows["largest"]).to_numpy()
    sig, size = signature_rows(rows["sig"], kind), rows["n"].to_numpy()
    least = np.ceil(least_share(percent, sig.shape[1]) * sig.shape[1])
    xs, ys = np.flatnonzero(rows["x"].to_numpy()), np.flatnonzero(rows["y"].to_numpy())
    first, count = np.searchsorted(group[ys], np.arange(group[-1] + 1)), np.bincount(group[ys], minlength=group[-1] + 1)
    ends = np.cumsum(count[group[xs]])
    at = 0
    while at < len(xs):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        each = count[group[xs[at:upto]]]
        x = np.repeat(xs[at:upto], each)
        y = ys[np.repeat(first[group[xs[at:upto]]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        at = upto
        open_ = (root[x] != root[y]) & (~outside[y] | (node[x] < node[y])) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
        x, y = x[open_], y[open_]
        for lo in range(0, len(x), PAIRS):
            a, b = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
            same = sig[a] == sig[b]
            share = same.sum(axis=1)
            near = np.flatnonzero(share >= least)
            near = near[same[near].reshape(len(near), sig.shape[1] // band, band).all(axis=2).argmax(axis=1) == band_of[group[a[near]]]]
            for i in near[np.lexsort((-share[near], group[a[near]]))].tolist():
                yield int(group[a[i]]), int(a[i]), int(b[i])


def links_in(rows: pd.DataFrame, percent: int, band: int, kind: type, unpack: Callable) -> list[tuple]:
    """(root, root) of the components of whole groups that a verified link joins. ``unpack`` makes a row's sorted set of its payload."""
    found, sets, of, now = [], {}, {}, -1
    roots, payload = list(rows["root"]), list(rows["payload"])

    def top(r):
        while of.get(r, r) != r:
            r = of[r]
        return r

    for group, x, y in pairs_apart(rows, percent, band, kind):
        if group != now:
            sets, now = {}, group
        a, b = top(roots[x]), top(roots[y])
        if a == b:
            continue
        for i in (x, y):
            if i not in sets:
                sets[i] = unpack(payload[i])
        if alike(sets[x], sets[y], percent):
            of[max(a, b)] = min(a, b)
            found.append((roots[x], roots[y]))
    return found


def link(pairs: DataFrame, shared: DataFrame, verify: Callable[[DataFrame], DataFrame], signed: Callable[[DataFrame], DataFrame], unpack: Callable, *, percent: int, band: int, kind: type) -> DataFrame:
    """(node, root) for each node linked with another.

    Buckets come from bands of ``band`` signature places of type ``kind`` and are numbered as by ``bucket_of``. ``pairs``
    has the two nodes (a, b) of each bucket of two, ``shared`` every node of the larger ones with another of the same
    bucket that it is compared with first, (bucket, first, node), first <= node; both are stored tables. ``verify`` gets
    distinct (a, b) pairs with a < b and returns those that are links; ``signed`` gets nodes and returns
    (node, n, sig, payload) of each, n the size of its set; ``unpack`` makes the sorted set of a payload, in the task.
    """
    stars = pairs.union(shared.where(F.col("node") != F.col("first")).select("first", "node")).distinct()
    roots = components(stored(verify(stars)))

    # A node without a link is a component of its own.
    at = stored(_rooted(shared.select("bucket", "node").distinct(), roots))
    counts = at.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    several = several.select("bucket", "largest", blocks(F.col("all") - F.col("most")).alias("np"), blocks(F.col("all")).alias("nq"))
    left = stored(at.join(several, "bucket"))
    rows = left.join(signed(left.select("node").distinct()), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A bucket of one block is sent once; of a larger one each block of one side meets each of the other.
    apart, one = F.col("root") != F.col("largest"), F.col("nq") == 1
    side = lambda p, q, x, y: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), x.alias("x"), y.alias("y"))
    as_x = F.when(apart, F.transform(every("nq"), lambda q: side(own("np"), q, F.lit(True), F.lit(False)))).otherwise(F.array())
    as_y = F.transform(every("np"), lambda p: side(p, own("nq"), F.lit(False), F.lit(True)))
    places = F.when(one, F.array(side(F.lit(0), F.lit(0), apart, F.lit(True)))).otherwise(F.concat(as_x, as_y))
    dealt = rows.select("bucket", "node", "root", "largest", "n", "sig", "payload", F.inline(places))
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    root = dict(roots.dtypes)["root"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of what came in; the last one waits for its rest."""
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = int(np.flatnonzero(starts(pdf))[-1])
            rest = pdf.iloc[whole:].reset_index(drop=True)
            if whole:
                yield pd.DataFrame(links_in(pdf.iloc[:whole], percent, band, kind, unpack), columns=["a", "b"])
        if rest is not None:
            yield pd.DataFrame(links_in(rest, percent, band, kind, unpack), columns=["a", "b"])

    joined = stored(components(dealt.mapInPandas(compare, f"a {root}, b {root}")))
    # A node that is its own component and has a link now is in ``joined`` alone.
    final = roots.unionByName(joined.select("node", F.col("node").alias("root"))).distinct()
    final = final.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return stored(final.select("node", F.coalesce("top", "root").alias("root")))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
