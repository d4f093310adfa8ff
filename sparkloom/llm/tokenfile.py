"""Token-id files with directly addressable codes.

An id is cut into chunks of 8 bits, lowest first (Brisaboa, Ladra and Navarro, 2013).
Level 0 holds the first chunk of every id; a bit of its continuation bitmap is set where
the id goes on, and those ids have their next chunk in level 1, in the same order, and so
on. Where an id stands in the next level is the number of set bits before it, which a
directory of counts (one for each 512 bits) gives at once, so any id is read without
decoding others.

A segment is one such image with the documents that it holds, whole documents up to
about ``SEGMENT_IDS`` ids. Documents are dealt by ranges of doc_id, sorted, encoded and
cut into segments in one pass; segments go to a Parquet table through Spark's own
committer, so any file system that Spark knows will do and a lost executor costs a retry.
Positions in the whole corpus are sums over ranges (one row for each) plus the sum within
the range that each segment carries.

Segment image, little-endian:

    magic "DAC8", uint32 levels, uint64 documents, uint64 ids
    int64 x documents     doc_id
    uint8 x documents     1 where doc_id is null
    int64 x documents     ids in the document
    for each level: uint64 chunks; uint8 x chunks; uint8 x ceil(chunks / 8) bitmap;
                    uint32 x (chunks // 512 + 1) set bits before each 512

Defined cases: a null or empty text is a document of the end id alone; null ids come
first in the order; rows of one doc_id are ordered by a hash of their text, then the
text; an empty table gives an empty file table; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, small, tasks
from sparkloom.llm.pieces import encoder

MAGIC = b"DAC8"
BITS = 8
BLOCK = 512
SEGMENT_IDS = 1 << 18
END_ID = 0


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation flags) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        on = rest >> np.uint32(BITS) > 0
        out.append(((rest & np.uint32((1 << BITS) - 1)).astype(np.uint8), on))
        rest = rest[on] >> np.uint32(BITS)
        if not len(rest):
            return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The image of a segment."""
    levels = levels_of(ids)
    parts = [struct.pack("<4sIQQ", MAGIC, len(levels), len(doc_ids), len(ids))]
    parts.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    parts.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    parts.append(np.asarray(lengths, "<i8").tobytes())
    for chunks, on in levels:
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.empty(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)])[: len(on) // BLOCK + 1]
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), np.packbits(on, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
    return b"".join(parts)


class Segment:
    """A segment read from its image."""

    def __init__(self, image: bytes):
        magic, levels, docs, self.n_ids = struct.unpack_from("<4sIQQ", image)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize("<4sIQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        ids, null, self.lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.doc_ids: list[int | None] = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", n // BLOCK + 1)))

    def id_at(self, i: int) -> int:
        """The i-th id, from one chunk of each level that it reaches."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, before in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            shift += BITS
            block = i // BLOCK
            own = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(before[block]) + int(own.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level from the last."""
        value = np.empty(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            mine = chunks.astype(np.uint32)
            mine[on] |= value << np.uint32(BITS)
            value = mine
        return value

    def document(self, j: int) -> np.ndarray:
        """The ids of the j-th document by direct access."""
        return np.array([self.id_at(i) for i in range(self.starts[j], self.starts[j + 1])], np.uint32)


_SCHEMA = "part int, seq int, base long, docs long, ids long, first_doc long, image binary"


def write(docs: DataFrame, path: str, *, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, partitions: int | None = None) -> None:
    """Encode every document and write the segment table to ``path``, a folder that Spark can write."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))
    rows = rows.repartitionByRange(partitions or tasks(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        part, seq, base, doc_ids, held, total = 0, 0, 0, [], [], 0

        def close() -> pd.DataFrame:
            nonlocal seq, base, doc_ids, held, total
            out = {"part": part, "seq": seq, "base": base, "docs": len(doc_ids), "ids": total, "first_doc": doc_ids[0], "image": pack(doc_ids, np.array([len(h) for h in held]), np.concatenate(held))}
            seq, base, doc_ids, held, total = seq + 1, base + total, [], [], 0
            return pd.DataFrame([out]).astype({"first_doc": "Int64"})

        for pdf in batches:
            for part, doc_id, none, found in zip(pdf["part"], pdf["doc_id"], pdf["none"], encode(list(pdf["text"])), strict=True):
                ids = np.append(found, np.uint32(end_id))
                doc_ids.append(None if none else doc_id)
                held.append(ids)
                total += len(ids)
                if total >= segment_ids:
                    yield close()
        if doc_ids:
            yield close()

    rows.mapInPandas(segments, _SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a segment table, from its images."""
    table = spark.read.parquet(path)
    parts = cut(table.groupBy("part").agg(F.sum("ids").alias("ids")))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = small(parts.select("part", before.alias("offset")))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, image in pdf.itertuples(index=False):
                s = Segment(image)
                ids = s.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(s.doc_ids, dtype="Int64"), "start": s.starts[:-1] + at, "n_tokens": s.lengths, "ids_crc32": np.array(crc, np.int64)})

    found = table.join(offsets, "part").select((F.col("base") + F.col("offset")).alias("at"), "image")
    return found.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
