"""WARC archives: written as whole gzip streams, normalised to a member for each record with an index beside them, read back.

``write`` makes the records of pages with SQL functions alone and hands them to Spark's text writer: a record
is a line that ends in CR LF CR LF, and gzip makes one stream of a file. Of equal payloads of
``LEAST`` bytes and more the page of the smallest id is a response and the others are revisits of it: their
block has the HTTP header, with the payload's length, and no payload.

``normalise`` takes any such archives (``*.gz``, of one stream or several) to archives in which every record is
a gzip member of its own. Spark's reader inflates each file once, as a stream; a task sees its pieces between
CR LF CR LF in order, puts records together by their Content-Length, compresses them piece by
piece, and closes an archive at ``ARCHIVE`` bytes. Beside each archive goes its index, a gzip file of one JSON line for each record
with offset and length. What a task holds is one compressed record and the index of one archive.

Members are written by Spark's text writer too, through its committer, so any file system that it knows will do
and a lost executor costs a retry: the writer ends every row with a zero byte, which is the last byte of a
member's length field for records under 16 MiB and is left out of the row; longer records are followed by an empty
member, which ends so. Archives and indexes stand in folders of their names, each as one file.

``read`` walks the archives member by member and checks every payload against its digest; ``index`` reads the
indexes; ``fetch`` inflates only the records asked for, at their offsets.

Defined cases: a null html is an empty payload, a null url makes no target line; null ids come after all others
and are written as such; rows of the smallest id are all responses, so equal ids (repeated rows too) never refer to each other; an empty
table gives empty archives; a record cut off at the end of a file, or of another length than it
says, is an error; texts of any length are records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import small, stored
from sparkloom.operators.skew import hot_key_join

#: Bytes from which equal payloads are written once.
LEAST = 100
#: Bytes at which an archive is closed.
ARCHIVE = 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that are inflated at once.
_STEP = 1 << 16
_END = "\r\n\r\n"
_EMPTY = gzip.compress(b"", mtime=0)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits, once each: digests as binary."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).alias("n"))
    rows = stored(rows.where(F.col("n") >= least).select("page_id", "digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    # A digest may have a third of all pages.
    return hot_key_join(rows, first, ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """(value): the record of each page, without the CR LF CR LF after it."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"))
    copies = stored(decided(pages, least)).withColumnsRenamed({"page_id": "copy", "digest": "same"})
    # By (id, digest): pages go to many tasks even where most share a payload.
    rows = rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("same")), "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    target = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _id(F.col("refers_to"))))).otherwise(""),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, path: str, *, least: int = LEAST, date: str = DATE) -> None:
    """Write the records of (page_id, url, html) to ``path``, one gzip stream for each file."""
    records(pages, least, date).write.option("lineSep", _END).option("compression", "gzip").text(path)


def fields(header: bytes) -> dict[str, str]:
    """The named lines of a WARC or HTTP header, names in lower case."""
    out = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _zero_ended(member: bytes) -> bytes:
    """A member, or a member and an empty one, without the zero byte at its end."""
    return member[:-1] if member[-1] == 0 else member + _EMPTY[:-1]


class _Archives:
    """The records of one file after another, as rows (name, seq, value) of archives and their indexes."""

    def __init__(self, most: int, level: int):
        self.most, self.level = most, level
        self.path, self.rows, self.left = None, [], None

    def _open(self, path: str) -> None:
        self.path, self.number = path, 0
        base = re.sub(r"(\.warc|\.txt)?\.gz$", "", path.rsplit("/", 1)[-1])
        self.stem = f"{re.sub('[^A-Za-z0-9_-]', '_', base)}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
        self._fresh()

    def _fresh(self) -> None:
        self.name, self.seq, self.at, self.lines = f"{self.stem}-{self.number:05d}", 0, 0, []
        self.number += 1

    def close(self) -> None:
        """End the archive at hand."""
        if self.left is not None:
            raise ValueError(f"{self.path} ends within a record")
        if self.path is not None and self.lines:
            body = "".join(json.dumps(x, separators=(",", ":")) + "\n" for x in self.lines).encode()
            self.rows.append((f"{self.name}.cdxj.gz", 0, _zero_ended(gzip.compress(body, mtime=0))))

    def add(self, path: str, piece: bytes) -> None:
        if path != self.path:
            self.close()
            self._open(path)
        if self.left is None:
            if not piece.startswith(b"WARC/"):
                raise ValueError(f"{path} has no record where one should begin")
            self.header = fields(piece)
            if "content-length" not in self.header:
                raise ValueError(f"{path} has a record without a length")
            self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            self.out = [self.zip.compress(piece + b"\r\n\r\n")]
            self.left, self.begun = int(self.header["content-length"]), False
            return
        if self.begun:
            piece = b"\r\n\r\n" + piece
        self.begun = True
        self.left -= len(piece)
        self.out.append(self.zip.compress(piece))
        if self.left < 0:
            raise ValueError(f"{path} has a record that is longer than it says")
        if self.left == 0:
            self._record()

    def _record(self) -> None:
        self.out += [self.zip.compress(b"\r\n\r\n"), self.zip.flush()]
        value = _zero_ended(b"".join(self.out))
        self.rows.append((f"{self.name}.warc.gz", self.seq, value))
        self.lines.append({"offset": self.at, "length": len(value) + 1, "id": self.header.get("warc-record-id"), "type": self.header.get("warc-type"), "target": self.header.get("warc-target-uri")})
        self.seq, self.at, self.left, self.out = self.seq + 1, self.at + len(value) + 1, None, []
        if self.at >= self.most:
            self.close()
            self._fresh()


def normalise(spark: SparkSession, source: str, path: str, *, archive: int = ARCHIVE, level: int = 6) -> None:
    """Rewrite the gzip archives of ``source`` with a member for each record, and their indexes, to ``path``."""
    pieces = spark.read.option("lineSep", _END).text(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = _Archives(archive, level)

        def ready() -> pd.DataFrame:
            rows, made.rows = made.rows, []
            return pd.DataFrame(rows, columns=["name", "seq", "value"])

        for pdf in batches:
            for at, piece in pdf.itertuples(index=False):
                made.add(at, piece)
            yield ready()
        made.close()
        yield ready()

    rows = pieces.mapInPandas(rewritten, "name string, seq long, value binary").sortWithinPartitions("name", "seq")
    rows.select("name", F.col("value").cast("string").alias("value")).write.partitionBy("name").option("lineSep", "\0").option("compression", "none").text(path)


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(name, content) of the archives or of the indexes; ``name`` is without its ending."""
    rows = spark.read.format("binaryFile").load(path)
    if "name" not in rows.columns:  # not one archive
        rows = rows.limit(0).withColumn("name", F.lit(""))
    return rows.where(F.col("name").endswith(ending)).select(F.regexp_replace("name", re.escape(ending) + "$", "").alias("name"), "content")


def members(content: bytes, at: int = 0, upto: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the members of an archive; an empty member counts to the one before it."""
    view, upto = memoryview(content), len(content) if upto is None else upto
    held: tuple[int, int, bytes] | None = None
    while at < upto:
        begun, d, out = at, zlib.decompressobj(31), []
        while not d.eof:
            part = view[at : min(at + _STEP, upto)]
            if not part:
                raise ValueError("an archive ends within a member")
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        body = b"".join(out)
        if not body and held:
            held = (held[0], at - held[0], held[2])
            continue
        if held:
            yield held
        held = (begun, at - begun, body)
    if held:
        yield held


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    header, _, rest = record.partition(b"\r\n\r\n")
    head = fields(header)
    http, _, payload = rest[: int(head["content-length"])].partition(b"\r\n\r\n")
    return head, fields(http), payload


_READ = "name string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, length, page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of normalised archives."""

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in pdf.itertuples(index=False):
                rows = []
                for offset, length, record in members(content):
                    head, http, payload = parsed(record)
                    digest, kind = head.get("warc-payload-digest", "").removeprefix("sha256:"), head["warc-type"]
                    size = int(http["content-length"])
                    if kind == "response":
                        size, digest, said = len(payload), hashlib.sha256(payload).hexdigest(), digest
                        if said != digest:
                            raise ValueError(f"the payload at {offset} of {name} hasn't its digest")
                    rows.append((name, offset, length, _page(head["warc-record-id"]), size, digest, kind, _page(head.get("warc-refers-to"))))
                yield pd.DataFrame(rows, columns=["name", "offset", "length", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _files(spark, path, ".warc.gz").mapInPandas(walked, _READ)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, length, id, type, target) from the indexes beside the archives."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in pdf.itertuples(index=False):
                rows = [json.loads(x) for x in gzip.decompress(content).splitlines()]
                yield pd.DataFrame([(name, *(r[c] for c in ("offset", "length", "id", "type", "target"))) for r in rows], columns=["name", "offset", "length", "id", "type", "target"])

    return _files(spark, path, ".cdxj.gz").mapInPandas(lines, "name string, offset long, length long, id string, type string, target string")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(name, offset, id, type, payload) of the records that ``wanted``, rows of ``index``, names: only these are inflated."""
    each = wanted.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("at"))  # an archive's records at most

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content, at in pdf.itertuples(index=False):
                rows = []
                for place in at:
                    ((offset, _, record),) = members(content, place["offset"], place["offset"] + place["length"])
                    head, _, payload = parsed(record)
                    rows.append((name, offset, head.get("warc-record-id"), head.get("warc-type"), payload))
                yield pd.DataFrame(rows, columns=["name", "offset", "id", "type", "payload"])

    return _files(spark, path, ".warc.gz").join(small(each), "name").mapInPandas(picked, "name string, offset long, id string, type string, payload binary")


def report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that stand where the index says, read from the archives."""
    known = index(spark, path).select(F.col("name").alias("archive"), F.col("offset").alias("at"), F.col("length").alias("long"))
    rows = read(spark, path)
    there = (F.col("name") == F.col("archive")) & (F.col("offset") == F.col("at")) & (F.col("length") == F.col("long"))
    return rows.join(known, there).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
