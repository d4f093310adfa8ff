"""Aligning the tokens of two tokenizers over a corpus, each distinct segment once.

A text is cut before white space runs. That is safe where no entry of either vocabulary holds
something before such a run's first character, so that no merge crosses the cut: ``safe_breaks`` reads
both vocabularies and says which white space characters those are (a space and a line
feed, as it turns out, and not a carriage return). Segments then have the same tokens alone as in their text, for both
tokenizers, and every cut is an offset at which tokens of both end.

An alignment goes as the ids of its links in order, each id once, with two bits for each link that say which side moved on.

Documents are put into blocks of about ``BLOCK`` characters as numbers into the block's distinct segments. A segment
comes at most once from each block, so none is hot: all rows of a segment are sorted behind each other, it is tokenised and
aligned once, and each of its rows takes the alignment back to its block. Both tables are bucketed by
block: the two passes over them need no further shuffle. The first counts for each pair of ids the documents that hold it linked,
by block and then over all; the second composes the documents.

    groups   cut where tokens of both end
    links    pairs of token occurrences whose bytes overlap
    count    of a pair of ids: documents in which it is linked
    best     links whose pair has the highest count of its first id

Defined cases: null and empty texts have no tokens, nor have texts that a tokenizer doesn't give back byte for byte; null ids
and repeated rows are documents like others; a long text is one document in one block; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_path, stored, tasks
from sparkloom.llm.pieces import vocabulary

#: Characters of the texts of a block.
BLOCK = 1 << 23
#: Characters from which the segments of a text aren't listed but counted off.
LONG_TEXT = 1 << 20
#: (document, segment) pairs whose links are listed at once.
TOGETHER = 1 << 17
#: The white space that the first tokenizer splits at (the Unicode property White_Space).
WHITE = "\t\n\v\f\r \x85\xa0                　"
_SPACE = "▁"


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """The two tokenizers: A, byte-level, of a space and the text; B, of pieces, of the text, to which it adds a space."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(b))
        own = _byte_level()
        self.a_bytes: dict[int, bytes] = {i: bytes(own[c] for c in t) if all(c in own for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in pieces]
        self.space = self.b.piece_to_id(_SPACE)
        self.ids = "<u2" if max(max(self.a_bytes), len(self.b_bytes)) < 1 << 16 else "<u4"
        self.breaks = safe_breaks([x.decode("utf-8", "ignore") for x in self.a_bytes.values()], [p.replace(_SPACE, " ") for i, p in pieces if not self.b.is_byte(i)])
        white = re.escape(WHITE)
        begin = re.escape("".join(sorted(self.breaks)))
        other = re.escape("".join(sorted(set(WHITE) - self.breaks)))
        # A run begins a segment if its first character is safe; other runs go on in the segment they stand in.
        self.pattern = f"[{begin}][{white}]*[^{white}]*(?:[{other}][{white}]*[^{white}]*)*"

    def _b_ids(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments, without the space that it adds where a segment has none at its beginning."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [(ids or [self.space]) if s[0] == " " else ids[1:] for s, ids in zip(segments, found, strict=True)]

    def align(self, segments: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each segment its links, how they go on (two bits each: A's next token, B's, or both, which begins a group) and the ids that come in; no links where a tokenizer doesn't give the segment back."""
        a_bytes, b_bytes, out = self.a_bytes, self.b_bytes, []
        for s, e, b in zip(segments, self.a.encode_batch_fast(segments, add_special_tokens=False), self._b_ids(segments), strict=True):
            a, body = e.ids, s.encode()
            x, y = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
            if b"".join(x) != body or b"".join(y) != body:
                out.append((0, b"", b""))
                continue
            i, j, at_i, at_j, links, bits, ids = 0, 0, len(x[0]), len(y[0]), 1, 3, [a[0], b[0]]
            while True:
                if at_i < at_j:
                    i, moved = i + 1, 1
                    at_i += len(x[i])
                    ids.append(a[i])
                elif at_j < at_i:
                    j, moved = j + 1, 2
                    at_j += len(y[j])
                    ids.append(b[j])
                else:
                    i, j, moved = i + 1, j + 1, 3
                    if i == len(a):
                        break
                    at_i += len(x[i])
                    at_j += len(y[j])
                    ids += (a[i], b[j])
                bits |= moved << 2 * links
                links += 1
            out.append((links, bits.to_bytes(-(-links // 4), "little"), np.array(ids, self.ids).tobytes()))
        return out


def split(pattern: re.Pattern, text: str) -> Iterator[str]:
    """The segments of a space and a text."""
    whole = " " + text
    return map(re.Match.group, pattern.finditer(whole)) if len(whole) > LONG_TEXT else iter(pattern.findall(whole))


def safe_breaks(a: list[str], b: list[str]) -> frozenset[str]:
    """The white space characters before which a text may be cut, where something stands that isn't white space: in no entry of either vocabulary does such a character follow one that isn't white space, nor, but for the space, anything at all."""
    unsafe = set()
    for entry in itertools.chain(a, b):
        for before, c in zip(entry, entry[1:], strict=False):
            if c in WHITE and (before not in WHITE or (c != " " and before == " ")):
                unsafe.add(c)
    # Of other characters than ASCII a vocabulary may hold some of the bytes.
    return frozenset(c for c in WHITE if c < "\x80") - unsafe


@functools.lru_cache
def aligner(a: str, b: str) -> Aligner:
    """One pair of tokenizers for each process."""
    return Aligner(a, b)


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Store by ``block`` in as many buckets as the session has shuffle partitions."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(tasks(spark), "block").option("path", shared_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def blocks(docs: DataFrame, pattern: str, *, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(block, doc_id, codes, segments): a row for each document with the numbers of its segments, and one for each block with these."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = re.compile(pattern)
        # As monotonically_increasing_id has it: a task done again gives the same numbers.
        number, size = TaskContext.get().partitionId() << 33, 0
        segments: dict[str, int] = defaultdict(itertools.count().__next__)
        columns = ["block", "doc_id", "codes", "segments"]

        def close() -> tuple:
            nonlocal number, size, segments
            out = number, None, None, list(segments)
            number, size, segments = number + 1, 0, defaultdict(itertools.count().__next__)
            return out

        for pdf in batches:
            done = []
            for doc_id, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                codes = np.fromiter(map(segments.__getitem__, split(cut, t)), "<u4") if t else np.empty(0, "<u4")
                done.append((number, None if pd.isna(doc_id) else int(doc_id), codes.tobytes(), None))
                size += len(t)
                if size >= block:
                    done.append(close())
            yield pd.DataFrame(done, columns=columns).astype({"doc_id": "Int64"})
        if size:
            yield pd.DataFrame([close()], columns=columns).astype({"doc_id": "Int64"})

    return _bucketed(rows.mapInPandas(coded, "block long, doc_id long, codes binary, segments array<string>"), "blocks")


_ALIGNED = "block long, idx int, n int, moves binary, ids binary"


def aligned(coded: DataFrame, a: str, b: str) -> DataFrame:
    """(block, idx, n, moves, ids), as ``Aligner.align`` has it, of every segment of every block, each distinct one aligned once."""
    rows = coded.where("segments IS NOT NULL").select("block", F.posexplode("segments").alias("idx", "segment"))
    n = tasks(coded.sparkSession)
    rows = rows.repartition(n, "segment").sortWithinPartitions("segment")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b).align
        last: tuple[str, tuple] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            segments = batch.column("segment").to_pylist()
            distinct = list(dict.fromkeys(segments))
            new = distinct[1:] if last and last[0] == distinct[0] else distinct
            found = dict(zip(new, align(new), strict=True))
            if len(new) < len(distinct):
                found[last[0]] = last[1]
            last = segments[-1], found[segments[-1]]
            links, moves, ids = zip(*[found[s] for s in segments], strict=True)
            columns = [batch.column("block"), batch.column("idx"), pa.array(links, pa.int32()), pa.array(moves, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "idx", "n", "moves", "ids"])

    return _bucketed(rows.mapInArrow(of, _ALIGNED).repartition(n, "block"), "aligned")


class _Block:
    """The documents of a block, as numbers of its segments, and the links of these as numbers of its distinct pairs."""

    def __init__(self, docs: pd.DataFrame, segments: pd.DataFrame, ids: str):
        self.docs = [np.frombuffer(c, "<u4") for c in docs["codes"]]
        lengths = np.array([len(d) for d in self.docs])
        self.codes = np.concatenate(self.docs).astype(np.int64) if len(self.docs) else np.empty(0, np.int64)
        self.ends = np.cumsum(lengths)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        segments = segments.sort_values("idx")
        self.each = segments["n"].to_numpy(np.int64)
        self.start = np.cumsum(self.each) - self.each
        raw = np.frombuffer(b"".join(segments["moves"]), np.uint8)
        held = -(-self.each // 4)
        place = np.arange(self.each.sum()) - np.repeat(self.start, self.each)
        move = raw[np.repeat(np.cumsum(held) - held, self.each) + place // 4] >> (2 * (place % 4)).astype(np.uint8) & 3
        came = np.frombuffer(b"".join(segments["ids"]), ids).astype(np.int64)
        both = (move == 3).astype(np.int64)
        at = np.cumsum(1 + both) - 1 - both
        self.new_a, self.new_b, self.both = move & 1, move >> 1, both
        self.a, self.b = came[at[self.new_a > 0]], came[(at + both)[self.new_b > 0]]
        linked = self.b[np.cumsum(self.new_b, dtype=np.int64) - 1] << 32 | self.a[np.cumsum(self.new_a, dtype=np.int64) - 1] if len(move) else np.empty(0, np.int64)
        self.pairs, self.pair = np.unique(linked, return_inverse=True)
        self.good = self.sums((self.each == 0).astype(np.int64)) == 0

    def sums(self, of_segment: np.ndarray) -> np.ndarray:
        """For each document the sum over its segments."""
        upto = np.concatenate([[0], np.cumsum(of_segment[self.codes])])
        return upto[self.ends] - np.concatenate([[0], upto[self.ends]])[: len(self.ends)]

    def documents(self) -> np.ndarray:
        """For each pair in how many documents it is linked."""
        out = np.zeros(len(self.pairs), np.int64)
        n = max(1, len(self.each))
        held = self.good[self.owner] if len(self.owner) else np.empty(0, bool)
        met = np.unique(self.owner[held] * n + self.codes[held])
        doc, segment = np.divmod(met, n)
        at = 0
        while at < len(met):
            upto = min(at + TOGETHER, len(met))
            if upto < len(met):  # whole documents: back to where one begins, or on to its end
                back = int(np.searchsorted(doc, doc[upto]))
                upto = back if back > at else int(np.searchsorted(doc, doc[at], side="right"))
            s = segment[at:upto]
            each = self.each[s]
            place = np.repeat(self.start[s] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            pairs = np.unique(np.repeat(doc[at:upto], each) * len(out) + self.pair[place])
            out += np.bincount(pairs % len(out), minlength=len(out))
            at = upto
        return out

    def per_segment(self, of_link: np.ndarray) -> np.ndarray:
        """For each segment the sum over its links."""
        upto = np.concatenate([[0], np.cumsum(of_link, dtype=np.int64)])
        return upto[self.start + self.each] - upto[self.start]

    def groups(self) -> list[str]:
        """The groups of each segment as text."""
        edges = np.append(np.flatnonzero(self.both), len(self.both))
        sides = []
        for ids, new in ((self.a, self.new_a), (self.b, self.new_b)):
            upto = np.concatenate([[0], np.cumsum(new, dtype=np.int64)])[edges].tolist()
            ids = list(map(str, ids.tolist()))
            sides.append([",".join(ids[i:j]) for i, j in zip(upto, upto[1:], strict=False)])
        each = list(map("|".join, zip(*sides, strict=True)))
        ends = np.cumsum(self.per_segment(self.both)).tolist()
        return [";".join(each[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def report(docs: DataFrame, *, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    tools = aligner(a, b)
    ids = tools.ids
    coded = blocks(docs, tools.pattern, text=text, key=key, block=block)
    found = aligned(coded, a, b)
    rows = coded.where("segments IS NULL").select("block", "doc_id", "codes")

    def counted(own: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        if own.empty or segments.empty:
            return pd.DataFrame({"block": [], "pair": [], "docs": []})
        x = _Block(own, segments, ids)
        n = x.documents()
        return pd.DataFrame({"block": own["block"].iloc[0], "pair": x.pairs[n > 0], "docs": n[n > 0]})

    met = stored(rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(counted, "block long, pair long, docs long"))
    counts = met.groupBy("pair").agg(F.sum("docs").alias("n"))
    # The pairs of an id are as many as the other vocabulary has entries, at most.
    best = F.col("n") == F.max("n").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    counts = stored(counts.select("pair", "n", best.alias("best")))
    of_block = met.select("block", "pair").join(counts, "pair").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("pair", "n", "best")).alias("counts"))
    # One row of a block carries them all.
    right = found.join(of_block, (F.col("block") == F.col("of")) & (F.col("idx") < 1), "left").drop("of")

    def composed(own: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        x = _Block(own, segments, ids) if len(own) and len(segments) else None
        out = {"doc_id": own["doc_id"].astype("Int64")}
        names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
        if x is None:
            return pd.DataFrame(out | dict.fromkeys(names, 0) | {"groups_sha256": ""})
        n, best = np.zeros(len(x.pairs), np.int64), np.zeros(len(x.pairs), np.int64)
        for c in segments["counts"]:
            if c is not None and len(c):
                at = np.searchsorted(x.pairs, np.array([r["pair"] for r in c]))
                n[at], best[at] = [r["n"] for r in c], [r["best"] for r in c]
        of = [x.per_segment(v) for v in (x.new_a, x.new_b, x.both)] + [x.each, x.per_segment(best[x.pair]), x.per_segment(n[x.pair])]
        out |= {name: np.where(x.good, x.sums(v), 0) for name, v in zip(names, of, strict=True)}
        groups = x.groups()
        out["groups_sha256"] = [hashlib.sha256(";".join(map(groups.__getitem__, d.tolist())).encode()).hexdigest() if good and len(d) else "" for d, good in zip(x.docs, x.good, strict=True)]
        return pd.DataFrame(out)

    return rows.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(composed, _RESULT)
