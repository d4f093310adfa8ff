"""MinHash near-duplicate groups with SuperMinHash signatures.

A document's set is its distinct word shingles. SuperMinHash (Ertl, 2017) draws for each
element one random permutation of the signature's places; at step j the element offers
``j + r`` (r random in [0, 1)) to the j-th place of its permutation. The offers of an
element are spread over all places without repeats, which lowers the variance of the
estimate below that of MinHash, and once every place of a document holds less than j + 1
no later step can change it, so long documents stop after a step or two.

Documents with equal sets are one node. Nodes are banded, paired and joined by
``linking.link``; a pair is a link if ``100 * |A & B| >= percent * |A | B|`` on the full
sets, computed again from the texts of the nodes in question. Bands of 5 of 160 places
miss a pair at 0.8 with a chance of about 3e-6.

Set elements and nodes are hashes, of 64 and 128 bits.

Defined cases: documents without words or text have an empty set, are linked with
nothing and are kept; rows with a null id take part, never name a component, and are
kept only where their whole component has no id (component_id is then null); repeated
rows are members like others, and all rows with the id of their component are kept.
Empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.llm.common import cut, small, stored
from sparkloom.llm.linking import alike, bucket_of, buckets, least_share, link, signature_rows

PLACES = 160
BAND = 5
#: Shingles that are worked on at once, and bytes of a text that are split at once.
CHUNK = 60_000
BLOCK_BYTES = 1 << 20
#: Texts whose sets are held at once, and their characters (a longer text is alone).
TEXTS = 256
TOGETHER = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order; a long text is split block by block."""
    out, at = [], 0
    while at < len(text):
        end = at + BLOCK_BYTES
        end = m.start() if end < len(text) and (m := _SPACE.search(text, end)) else len(text)
        if words := text[at:end].split():
            out.append(pd.util.hash_array(np.array(words, dtype=object), categorize=False))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words, of all its words as one."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: ASCII letters and white space only
    if not len(h):
        return h
    width = min(k, len(h))
    acc = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        acc = mixed(acc + _GOLDEN) + h[i : len(h) - width + 1 + i]
    return np.unique(mixed(acc + np.uint64(width)))


def sets_by_size(texts: pd.Series, k: int) -> Iterator[list[np.ndarray]]:
    """The shingles of each text, in lists whose texts have at most ``TOGETHER`` characters."""
    sets, total = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if sets and (len(sets) == TEXTS or total + len(t) > TOGETHER):
            yield sets
            sets, total = [], 0
        sets.append(shingles(t, k))
        total += len(t)
    if sets:
        yield sets


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """One row of ``places`` 32-bit values for each set; those of an empty set are all ones."""
    out = np.full((len(sets), places), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= CHUNK):
            total += len(sets[upto])
            upto += 1
        doc = np.repeat(np.arange(at, upto), [len(s) for s in sets[at:upto]])
        h = np.concatenate(sets[at:upto])
        for lo in range(0, len(h), CHUNK):  # more than one for a long document alone
            _offer(h[lo : lo + CHUNK], doc[lo : lo + CHUNK], out, at, upto)
        at = upto
    return out


def _offer(h: np.ndarray, doc: np.ndarray, out: np.ndarray, at: int, upto: int) -> None:
    """Take the offers of elements ``h`` of documents ``doc``, which are of ``at`` to ``upto``, into the rows of ``out``."""
    places, flat = out.shape[1], out.reshape(-1)
    order = np.tile(np.arange(places, dtype=np.uint8), (len(h), 1))
    live = np.arange(len(h))
    for j in range(places):
        if not len(live):
            break
        x = mixed(h[live] + np.uint64((j + 1) * int(_GOLDEN) % 2**64))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = order[live, k].astype(np.int64)
        order[live, k] = order[live, j]
        offer = (np.uint32(j) << np.uint32(24)) | (x >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(flat, doc[live] * places + place, offer)
        open_ = out[at:upto].max(axis=1) >= (np.uint32(j + 1) << np.uint32(24) if j < 255 else 0)
        if not open_.all():
            live = live[open_[doc[live] - at]]


def node_key(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums over its elements and its size."""
    n = np.uint64(len(s))
    a, b = mixed(s + _GOLDEN).sum(dtype=np.uint64), mixed(s ^ _GOLDEN).sum(dtype=np.uint64)
    return np.array([mixed(np.array([a + n]))[0], mixed(np.array([b - n]))[0]], np.uint64).astype(">u8").tobytes()


def signed(docs: DataFrame, k: int, text: str = "text", key: str = "doc_id", least: int = 0) -> DataFrame:
    """(doc_id, h, n, node, sig) of every document; h is a hash of the text. sig is null for sets of under ``least`` elements."""

    @F.pandas_udf("struct<n: long, node: binary, sig: binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for sets in sets_by_size(texts, k):
            sig = ((signatures([s if len(s) >= least else s[:0] for s in sets]) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            out += [(len(s), node_key(s) if len(s) else None, r.tobytes() if len(s) >= max(1, least) else None) for s, r in zip(sets, sig, strict=True)]
        return pd.DataFrame(out, columns=["n", "node", "sig"])

    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), of(F.col(text)).alias("f"))
    return found.select("doc_id", "h", "f.n", "f.node", "f.sig")


def sets_of(docs: DataFrame, nodes: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(node, elements) of each node in ``nodes`` (node, doc_id), packed, from the text of one of its documents."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = small(nodes.select(F.col("doc_id").alias("_id")).distinct())
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")

    def of(batches):
        for pdf in batches:
            for sets in sets_by_size(pdf["text"], k):
                if sets := [s for s in sets if len(s)]:
                    yield pd.DataFrame({"node": [node_key(s) for s in sets], "elements": [s.tobytes() for s in sets]})

    found = rows.mapInPandas(of, "node binary, elements binary")
    return found.groupBy("node").agg(F.first("elements").alias("elements"))


def unpack(elements: bytes) -> np.ndarray:
    return np.frombuffer(elements, np.uint64)


def _links(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, e_a, e_b) whose sets are alike enough."""

    def of(batches):
        for pdf in batches:
            ok = [alike(unpack(x), unpack(y), percent) for x, y in zip(pdf["e_a"], pdf["e_b"], strict=True)]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.mapInPandas(of, "a binary, b binary")


def _close(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures are near enough to look at their sets."""

    def of(batches):
        for pdf in batches:
            if len(pdf):
                pdf = pdf[(signature_rows(pdf["sig_a"]) == signature_rows(pdf["sig_b"])).mean(axis=1) >= least_share(percent, PLACES)]
            yield pdf[["a", "b"]]

    return pairs.mapInPandas(of, "a binary, b binary")


def groups(docs: DataFrame, *, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, h (a hash of its text), n_shingles, component_id (the smallest doc_id of its group) and kept."""
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 62  # a smaller set has no partner but its equals
    rows = stored(signed(docs, k, text, key, least))
    with_node = rows.where("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "sig"))
    nodes = stored(with_node.groupBy("node").agg(first.alias("f"), F.count(F.lit(1)).alias("members")).select("node", "members", "f.doc_id", "f.n", "f.sig"))

    bands = PLACES // BAND
    wide = nodes.where("sig IS NOT NULL").select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: bucket_of(i, F.substring("sig", i * 2 * BAND + 1, F.lit(2 * BAND))))).alias("bucket"))

    def verify(pairs: DataFrame) -> DataFrame:
        info = nodes.where("sig IS NOT NULL")
        for side in "ab":
            pairs = pairs.join(info.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        pairs = cut(_close(pairs, percent))
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = stored(sets_of(docs, nodes.join(ends, "node", "left_semi"), k, text, key))
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("elements").alias(f"e_{side}")), side)
        return _links(pairs, percent)

    def with_sets(wanted: DataFrame) -> DataFrame:
        few = nodes.join(wanted, "node", "left_semi")
        return sets_of(docs, few, k, text, key).withColumnRenamed("elements", "payload").join(few.select("node", F.col("n").cast("int"), "sig"), "node")

    roots = link(*buckets(wide), verify, with_sets, unpack, percent=percent, band=BAND, kind=np.uint16)
    grouped = nodes.select("node", "doc_id", "members").join(roots, "node", "left")
    grouped = grouped.where("members > 1 OR root IS NOT NULL").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    ids = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = cut(grouped.select("node", "root").join(ids, "root").select("node", "component_id", F.lit(True).alias("_in")))
    out = rows.select("doc_id", "h", "n", "node").join(ids, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept(docs: DataFrame, *, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without those of each group that aren't its first."""
    gone = groups(docs, k=k, percent=percent, text=text, key=key).where("NOT kept")
    id_, h = fresh(docs.columns, "_id", "_h")
    gone = small(gone.select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct())
    return docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text)) == F.col(h)), "left_anti")
