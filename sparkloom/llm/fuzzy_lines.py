"""Fuzzy line deduplication: near-equal lines by MinHash over character shingles.

Lines are split at line feeds and normalised (lower case, white space runs to one space,
none at the ends). A line's set is its distinct ``K``-character shingles; a shorter line is
one shingle. Signatures are one-permutation MinHash: every shingle is hashed once to one of
``PLACES`` places and leaves its least value there; empty places are filled from places
chosen by a fixed walk of each (Shrivastava, 2017), so that places of two lines agree with
the chance of their Jaccard similarity. Bands of ``BAND`` places are looked up, candidates
are verified on the full sets, ``100 * |A & B| >= percent * |A | B|``, and the links joined
into components by distributed union-find (``linking``, ``components``). 20 bands of 6 find
a pair at 0.8 with a chance of 99.8 %, and one at 0.9 always but for one in 10^6; lines that
have a tenth of their shingles in common, as any two of one language may, meet with a chance
of 2 in 10^5, which is what lets the work grow with the table and not with its square.

Of each component one line stays, the first by (doc_id, hash of the text, line number);
equal normalised lines are in one component. Lines without a character but white space are
no repeats of each other and stay. A node of the link graph is a 64-bit hash of the line;
classes are told apart by 128 bits.

Defined cases: null texts have no lines and stay null; empty texts have one empty line and
stay; null ids come after all others; rows that agree in id and text are rewritten alike;
an empty table gives an empty result; extra columns are carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.llm.common import held, stored, tasks
from sparkloom.llm.linking import BAND_BITS, alike, least_share, link

K = 5
PLACES = 120
BAND = 6
#: Characters of lines, and shingles of a longer line, that are worked on at once.
CHUNK = 1 << 16
#: Lines whose bands are put together before they are sent, and bands in a part.
TOGETHER = 1 << 16
PART = 1 << 19
#: Nodes up to which their keys are broadcast; beyond that both sides are shuffled.
BROADCAST_NODES = 1_000_000

_BASE = np.uint64(0x100000001B3)
#: White space but space and line feed, as ``str.split`` knows it.
_ODD = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """The normalised lines of a text; those that need nothing but lower case are left as they are."""
    low = text.lower()
    odd = any(c in low for c in _ODD)
    return [" ".join(x.split()) if odd or "  " in x or x[:1] == " " or x[-1:] == " " else x for x in low.split("\n")]


def line_key(line: str) -> tuple[int, int]:
    """128 bits of a normalised line as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")), np.int64)
    return int(a), int(b)


def shingle_hashes(lines: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of normalised lines, joined, and the number of each line's; an empty line has none."""
    size = np.array([len(x) for x in lines], np.int64)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    c = "".join(x if len(x) >= k or not x else x.ljust(k, "\0") for x in lines)
    if not c:
        return np.empty(0, np.uint64), count
    h = _rolled(c, k)
    if len(lines) == 1:
        return _mixed_in_place(h), count
    # What begins in one line and ends in the next is no shingle.
    n, inside = len(h), np.ones(len(c), bool)
    ends = np.cumsum(np.where(size > 0, np.maximum(size, k), 0))[size > 0]
    for i in range(1, k):
        inside[ends - i] = False
    return _mixed_in_place(h[inside[:n]]), count


def _rolled(text: str, k: int) -> np.ndarray:
    """A polynomial of each ``k`` characters that follow each other."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - k + 1
    h = c[:n] * _BASE
    for i in range(1, k):
        h += c[i : n + i]
        if i < k - 1:
            h *= _BASE
    return h


def _mixed_in_place(x: np.ndarray) -> np.ndarray:
    """``superminhash.mixed``, over the array itself with one buffer beside it."""
    beside = x >> np.uint64(30)
    for times, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        x ^= beside
        x *= np.uint64(times)
        np.right_shift(x, np.uint64(shift), out=beside)
    x ^= beside
    return x


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; a plain sort, which is several times as fast as ``np.unique`` on the few hundred of a line."""
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def pieces(lines: list[str], k: int = K) -> Iterator[tuple[np.ndarray, list[str]]]:
    """All lines that have at most ``CHUNK`` characters, then each longer one in parts of ``CHUNK`` shingles: the numbers of the lines and what is to be hashed. A shingle is in one part."""
    short = np.array([i for i, x in enumerate(lines) if len(x) <= CHUNK], np.int64)
    yield short, [lines[i] for i in short]
    for i, x in enumerate(lines):
        if len(x) > CHUNK:
            for at in range(0, len(x) - k + 1, CHUNK):
                yield np.array([i]), [x[at : at + CHUNK + k - 1]]


@cache
def _walks(places: int) -> np.ndarray:
    """For each place the order in which it looks at the others for a value; the same everywhere."""
    return np.argsort(np.random.default_rng(places).random((places, places)), axis=1)


def signatures(lines: list[str], k: int = K, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (8-bit places) of normalised lines that aren't empty, and the number of shingles of each."""
    out = np.full(len(lines) * places, 0xFFFFFFFF, np.uint32)
    count = np.zeros(len(lines), np.int64)
    for own, parts in pieces(lines, k):
        h, n = shingle_hashes(parts, k)
        halves = h.astype("<u8", copy=False).view("<u4").reshape(-1, 2)
        place = np.multiply(halves[:, 0], places, dtype=np.int64)
        place >>= 32
        place += np.repeat(own * places, n)
        np.minimum.at(out, place, np.ascontiguousarray(halves[:, 1]))
        np.add.at(count, own, n)
    out = out.reshape(-1, places)
    filled = out.copy()
    row, col = np.nonzero(out == 0xFFFFFFFF)
    walks = _walks(places)
    for step in range(places):
        if not len(row):
            break
        value = out[row, walks[col, step]]
        filled[row, col] = value
        still = value == 0xFFFFFFFF
        row, col = row[still], col[still]
    return ((filled * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8), count


def line_set(line: str, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of a normalised line."""
    if len(line) <= CHUNK:
        return distinct(_mixed_in_place(_rolled(line if len(line) >= k else line.ljust(k, "\0"), k))) if line else np.empty(0, np.uint64)
    return distinct(np.concatenate([distinct(shingle_hashes(own, k)[0]) for _, own in pieces([line], k) if own]))


def _chunks(lines: list[str]) -> Iterator[slice]:
    at, total = 0, 0
    for i, x in enumerate(lines):
        total += len(x)
        if total >= CHUNK:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(lines):
        yield slice(at, len(lines))


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))


_SIGNED = "id long, h long, line int, of int, a long, b long, n int, sig binary, text string"


def signed_lines(docs: DataFrame, k: int = K, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, h, line, of, a, b, n, sig, text) of every line that isn't blank: its number, how many its text has (at the first of them, else null), its key, its signature and itself, normalised; the last two are null where the same batch has had the line before. A document without such lines has one row, with ``of`` 0 and nulls."""

    names = ["id", "h", "line", "of", "a", "b", "n", "sig", "text"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, which, each = [], [], []
            lines: dict[str, int] = {}
            for t in batch.column("t").to_pylist():
                before = len(which)
                for no, line in enumerate(normal_lines(t) if t is not None else ()):
                    if line:
                        numbers.append(no)
                        which.append(lines.setdefault(line, len(lines)))
                each.append(len(which) - before)
            each = np.array(each, np.int64)
            if len(without := np.flatnonzero(each == 0)):
                none = {"id": batch.column("id").take(pa.array(without)), "h": batch.column("h").take(pa.array(without)), "of": pa.array(np.zeros(len(without), np.int32))}
                kinds = {"line": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "sig": pa.binary(), "text": pa.string()}
                yield pa.RecordBatch.from_arrays([none[c] if c in none else pa.nulls(len(without), kinds[c]) for c in names], names)
            if not which:
                continue
            unique = list(lines)
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in unique]), np.int64).reshape(-1, 2)
            found, counts = zip(*[signatures(unique[s], k) for s in _chunks(unique)], strict=True)
            sig, counts = np.concatenate(found), np.concatenate(counts).astype(np.int32)
            which = np.array(which)
            own = pa.array(np.repeat(np.arange(len(each)), each))
            first = np.zeros(len(which), bool)
            first[np.unique(which, return_index=True)[1]] = True
            place = pa.array(np.where(first, which, 0), mask=~first)
            begins = np.zeros(len(which), bool)
            begins[(np.cumsum(each) - each)[each > 0]] = True
            columns = [batch.column("id").take(own), batch.column("h").take(own), pa.array(numbers, pa.int32()), pa.array(np.repeat(each, each).astype(np.int32), mask=~begins)]
            columns += [pa.array(keys[which, 0]), pa.array(keys[which, 1]), pa.array(counts[which]), pa.array([r.tobytes() for r in sig], pa.binary()).take(place), pa.array(unique, pa.string()).take(place)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _rows(docs, text, key).mapInArrow(of, _SIGNED)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The signatures of a batch, one row each."""
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def band_numbers(sig: np.ndarray) -> np.ndarray:
    """The numbers of the buckets of each signature, band by band: the band's places, with the band in the low bits."""
    places = sig.reshape(len(sig), -1, BAND).astype(np.int64)
    out = places[:, :, 0]
    for i in range(1, BAND):
        out = out << 8 | places[:, :, i]
    return out << BAND_BITS | np.arange(out.shape[1])


def _met(key: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, smallest and largest node, and how many nodes there are at least (3: more than two), of rows of the same; then, for the keys of more than two, the numbers of their rows, and of the key that each of these has."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    each = np.diff(np.append(at, len(key)))

    def rows_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of these keys, where each key's begin among them, and their number."""
        n = each[which]
        begin = np.cumsum(n) - n
        return order[np.repeat(at[which] - begin, n) + np.arange(n.sum())], begin, n

    first = order[at]
    least, most = low[first], high[first]
    found = np.where(count[first] > 2, 3, 1 + (least != most)).astype(np.int32)
    if len(several := np.flatnonzero(each > 1)):  # most keys have one row
        rows, begin, n = rows_of(several)
        lo, hi = low[rows], high[rows]
        least[several], most[several] = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin)
        a, z = np.repeat(least[several], n), np.repeat(most[several], n)
        more = np.logical_or.reduceat((count[rows] > 2) | ((lo != a) & (lo != z)) | ((hi != a) & (hi != z)), begin)
        found[several] = np.where(more, 3, 1 + (least[several] != most[several]))
    large = np.flatnonzero(found > 2)
    rows, _, n = rows_of(large)
    return key[at], least, most, found, rows, np.repeat(large, n)


def band_buckets(lines: DataFrame, least: int) -> DataFrame:
    """What meets in bands, in one pass: (bucket, a, b, pair) with the two nodes of each bucket of two (``pair``), and for
    larger buckets each node ``b`` with a smaller one, ``a``, of the bucket, or itself.

    Bands are put together by task and sent packed, those of a part in one row: there are 20 of them for each line, and
    almost all are alone in their bucket. A task sends the smallest and the largest node of a bucket to the bucket's part;
    those between are known to be of a bucket of three and more and go to parts by node, so that a bucket which holds a
    third of all lines is in no one's memory.
    """
    wanted = lines.where(F.col("sig").isNotNull() & (F.col("n") >= least)).select("a", "sig")
    parts = max(tasks(lines.sparkSession), -(-wanted.count() * (PLACES // BAND) // PART))
    alone, several, between = 0, 1, 2

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, total = [], [], 0

        def part_of(x: np.ndarray) -> np.ndarray:
            return ((_mixed_in_place(x.view(np.uint64).copy()) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)

        def send() -> pa.RecordBatch:
            every = np.concatenate(keys).ravel()
            node = np.repeat(np.concatenate(nodes), PLACES // BAND)
            key, low, high, count, inside, own = _met(every, node, node, np.ones(len(node), np.int32))
            inside, own = (x[(node[inside] != low[own]) & (node[inside] != high[own])] for x in (inside, own))
            kind = np.concatenate([np.where(count > 1, several, alone), np.full(len(own), between)])
            part = np.concatenate([part_of(key), part_of(node[inside])])
            key, low, high, count = np.concatenate([key, key[own]]), np.concatenate([low, low[own]]), np.concatenate([high, node[inside]]), np.concatenate([count, np.zeros(len(own), np.int32)])
            place = part.astype(np.int64) * 3 + kind
            order = np.argsort(place.astype(np.uint16) if 3 * parts <= 1 << 16 else place, kind="stable")  # 16 bits are sorted by radix
            edges = np.flatnonzero(np.diff(place[order], prepend=-1))
            rows = []
            for at in np.split(order, edges[1:]):
                which = int(kind[at[0]])
                k = np.ascontiguousarray(key[at].astype("<i8").view(np.uint8).reshape(-1, 8)[:, : BAND + 1])  # all that isn't zero
                rows.append((int(part[at[0]]), which, k.tobytes(), low[at].tobytes(), None if which == alone else high[at].tobytes(), count[at].astype(np.uint8).tobytes() if which == several else None))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kind", "keys", "low", "high", "count"])

        for batch in batches:
            if batch.num_rows:
                nodes.append(batch.column("a").to_numpy())
                keys.append(band_numbers(_matrix(batch)))
                total += batch.num_rows
            if total >= TOGETHER:
                yield send()
                nodes, keys, total = [], [], 0
        if total:
            yield send()

    def numbers(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.int64)

    def keys_of(column: pd.Series) -> np.ndarray:
        raw = np.frombuffer(b"".join(column), np.uint8).reshape(-1, BAND + 1)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, : BAND + 1] = raw
        return key.view(np.int64).ravel()

    def unpacked(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, sent = pdf[pdf["kind"] == between], pdf[pdf["kind"] != between]
        out = [pd.DataFrame({"bucket": keys_of(inner["keys"]), "a": numbers(inner["low"]), "b": numbers(inner["high"]), "pair": False})]
        low, high = numbers(sent["low"]), numbers(sent["high"].where(sent["kind"] == several, sent["low"]))
        count = np.frombuffer(b"".join(b"\1" * (len(x) // 8) if c is None else c for x, c in zip(sent["low"], sent["count"], strict=True)), np.uint8)
        every = keys_of(sent["keys"])
        key, first, last, count, inside, own = _met(every, low, high, count)
        out.append(pd.DataFrame({"bucket": key[count == 2], "a": first[count == 2], "b": last[count == 2], "pair": True}))
        at = np.concatenate([own, own])
        out.append(pd.DataFrame({"bucket": key[at], "a": first[at], "b": np.concatenate([low[inside], high[inside]]), "pair": False}).drop_duplicates())
        return pd.concat(out, ignore_index=True)

    rows = wanted.mapInArrow(packed, "part int, kind int, keys binary, low binary, high binary, count binary")
    return rows.groupBy("part").applyInPandas(unpacked, "bucket long, a long, b long, pair boolean")


def _close(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose signatures are near enough to look at their sets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
                yield pdf.loc[(x == y).mean(axis=1) >= least_share(percent, x.shape[1]), ["a", "b"]]

    return pairs.mapInPandas(of, "a long, b long")


def _links(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose texts are alike enough, from their full sets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.zeros(len(pdf), bool)
            size = np.cumsum([len(x) + len(y) for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True)])
            at = 0
            while at < len(pdf):
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
                texts = {t: i for i, t in enumerate(dict.fromkeys([*pdf["text_a"].iloc[at:upto], *pdf["text_b"].iloc[at:upto]]))}
                h, count = shingle_hashes(list(texts), k)
                sets = [distinct(h[end - n : end]) for n, end in zip(count.tolist(), np.cumsum(count).tolist(), strict=True)]
                ok[at:upto] = [alike(sets[texts[x]], sets[texts[y]], percent) for x, y in zip(pdf["text_a"].iloc[at:upto], pdf["text_b"].iloc[at:upto], strict=True)]
                at = upto
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(of, "a long, b long")


def classes(docs: DataFrame, *, k: int = K, percent: int = 80, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All lines that aren't blank and the documents without any, (id, h, line, of, a, b) as from ``signed_lines``, and the classes of more than one, (a, b, first): the struct (last, id, h, line) of the line that stays. h is a hash of the text, (a, b) the key of the line, ``of`` the number of such lines of the text, once for each document."""
    lines = stored(signed_lines(docs, k, text, key), compression="zstd")
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30  # a smaller set has no partner but its equals

    def of_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
        """(node, columns). Where two lines share the first half of their keys, the one of smaller second half stands for the node."""
        wanted = held(stored(nodes.select(F.col("node").alias("wanted"))), BROADCAST_NODES)
        found = lines.where(F.col("sig").isNotNull()).select("a", "b", *columns).join(wanted, F.col("a") == F.col("wanted"))
        return found.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("b", *columns)).alias("f")).select("node", *[f"f.{c}" for c in columns])

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        found = of_nodes(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), column)
        for side in "ab":
            pairs = pairs.join(found.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        near = stored(_close(with_both(stored(pairs), "sig"), percent))
        return _links(with_both(near, "text"), k, percent)

    def signed(nodes: DataFrame) -> DataFrame:
        return of_nodes(nodes, "n", "sig", "text").withColumnRenamed("text", "payload")

    met = stored(band_buckets(lines, least))
    roots = link(met.where("pair").select("a", "b"), met.where("NOT pair").select("bucket", F.col("a").alias("first"), F.col("b").alias("node")), verify, signed, lambda line: line_set(line, k), percent=percent, band=BAND, kind=np.uint8)
    # Of lines that share the first half of their keys only the node's own is linked.
    place = F.struct(F.col("id").isNull().alias("last"), "id", "h", "line")
    copies = lines.where("a IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
    of_class = copies.join(roots, F.col("a") == F.col("node"), "left").where("root IS NOT NULL OR copies > 1")
    own = F.col("b") == F.min("b").over(W.partitionBy("a"))
    of_class = stored(of_class.select("a", "b", F.coalesce("root", "a").alias("root"), F.when(F.col("root").isNull() | ~own, F.col("b")).alias("other"), "first"))
    first = of_class.groupBy(F.col("root").alias("r"), F.col("other").alias("o")).agg(F.min("first").alias("first"))
    found = of_class.drop("first").join(first, (F.col("root") == F.col("r")) & F.col("other").eqNullSafe(F.col("o")))
    return lines.select("id", "h", "line", "of", "a", "b"), stored(found.select("a", "b", "first"))


def dropped(docs: DataFrame, *, k: int = K, percent: int = 80, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All lines, as from ``classes``, and (id, h, drop): the sorted numbers of the lines that go, of each text that loses some."""
    lines, found = classes(docs, k=k, percent=percent, text=text, key=key)
    # The classes grow with the lines: both are shuffled, at every size.
    found = found.withColumnsRenamed({"a": "ca", "b": "cb"}).hint("shuffle_merge")
    met = lines.join(found, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("line") == F.col("first.line"))
    return lines, met.where(~stays).groupBy("id", "h").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def deduplicated(docs: DataFrame, *, k: int = K, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and ``lines_dropped``, how many; a column of that name is replaced."""
    _, go = dropped(docs, k=k, percent=percent, text=text, key=key)
    id_, h, drop = fresh(docs.columns, "_id", "_h", "_drop")
    go = go.withColumnsRenamed({"id": id_, "h": h, "drop": drop})
    rows = docs.join(go, F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(drop, i))
    rest = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    own = [rest.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "lines_dropped"]
    return rows.select(*own, F.coalesce(F.size(drop), F.lit(0)).alias("lines_dropped"))


def report(docs: DataFrame, *, k: int = K, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, n_lines (not blank), n_kept, and the numbers of the lines that go, comma-joined."""
    lines, go = dropped(docs, k=k, percent=percent, text=text, key=key)
    rows = lines.where("of IS NOT NULL").select("id", "h", F.col("of").alias("n"))  # one for each document
    out = rows.join(go.withColumnsRenamed({"id": "gid", "h": "gh"}), F.col("id").eqNullSafe(F.col("gid")) & (F.col("h") == F.col("gh")), "left")
    n = F.col("n").cast("long")
    gone = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return out.select(F.col("id").alias(key), n.alias("n_lines"), (n - gone).cast("long").alias("n_kept"), F.coalesce(F.array_join(F.transform("drop", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))
