"""Archives against the standard library's gzip, records of every kind, the index's offsets."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import warc
from sparkloom.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, digest string, name string, refers_to string"


def brute(rows):
    least = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and p is not None:
            least[h] = min(p, least.get(h, p))
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        first = least.get(h, p)
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "response" if first == p else "revisit", None if first == p else first))
    return sorted(out, key=str)


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    source, out = shared_path(spark, "test-warc"), shared_path(spark, "test-warc")
    warc.write(df, source)
    warc.normalise(spark, source, out, **options)
    return source, out


def rows_():
    r = random.Random(5)
    page = "<p>é \U0001f600 twice</p>\r\n\r\n<b>after two line breaks</b>\r\n\r\n" * 5
    rows = [(n, f"http://a.example/{n}", r.choice([page, "x" * 99, "y" * 100, "short", "", None])) for n in r.sample(range(-50, 500), 150)]
    odd = ["\r\n\r\n", "\r\n\r\n" * 40, "\r\n" * 33 + "\r", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\x00\x00", "\n" * 101, "a\r\n\r", "\r\n\r\r\n\r\n\r\n\r\n"]
    rows += [(1000 + i, None if i % 2 else "http://b.example/a b\r\nX: y", h) for i, h in enumerate(odd)]
    return rows + [(None, "u", page), (None, "u", "z" * 200), (None, "v", "z" * 200), (3000, "u", page), (3000, "u", page), (3001, "u", "q" * 300), (3001, "v", "q" * 300)]


@pytest.mark.parametrize("archive", [warc.ARCHIVE, 700])
def test_round_trip(spark, archive):
    rows = rows_()
    source, out = made(spark, rows, archive=archive)
    assert sorted((tuple(r) for r in warc.report(spark, out).collect()), key=str) == brute(rows)
    # Whole streams before, a member for each record after, the same bytes in both; other programs read them.
    before = b"".join(sorted(gzip.decompress(f.read_bytes()) for f in Path(source).glob("*.gz")))
    found = warc.index(spark, out).collect()
    files = {f.parent.name.removeprefix("name="): f.read_bytes() for f in Path(out).glob("name=*.warc.gz/part*")}
    after = {n: gzip.decompress(b) for n, b in files.items()}
    assert sum(map(len, after.values())) == len(before) and len(found) == len(rows)
    assert (len(files) > 10) == (archive == 700)
    for r in found:
        body = files[r.name + ".warc.gz"]
        record = gzip.decompress(body[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {r.id}\r\n".encode() in record
        assert record in before
    assert all(sum(x.length for x in found if x.name + ".warc.gz" == n) == len(b) for n, b in files.items())


def test_fetch(spark):
    rows = rows_()
    _, out = made(spark, rows, archive=2000)
    wanted = warc.index(spark, out).where("type = 'response' AND id IN ('<urn:page:1001>', '<urn:page:1003>', '<urn:page:1007>')")
    got = {r.id: bytes(r.payload).decode() for r in warc.fetch(spark, out, wanted).collect()}
    assert got == {f"<urn:page:{p}>": h for p, _, h in rows if p in (1001, 1003, 1007)}


def test_long_records_end_in_an_empty_member(spark):
    """A length of 16 MiB and more has a last byte that isn't zero."""
    rows = [(1, "u", "ab" * (9 << 20)), (2, "u", "short"), (3, "u", "ab" * (9 << 20))]
    _, out = made(spark, rows)
    assert sorted((tuple(r) for r in warc.report(spark, out).collect()), key=str) == brute(rows)
    body = next(f.read_bytes() for f in Path(out).glob("name=*.warc.gz/part*") if b"" != f.read_bytes())
    assert body[-1] == 0 and gzip.decompress(body)


def test_empty_and_damaged(spark, tmp_path):
    _, out = made(spark, [])
    assert warc.report(spark, out).collect() == [] and warc.index(spark, out).collect() == []
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for i, (body, said) in enumerate([(whole[:-7], "within a record"), (whole.replace(b": 5", b": 4"), "longer"), (whole + b"more\r\n\r\n", "no record"), (b"WARC/1.1\r\nA: b\r\n\r\n\r\n\r\n", "without a length")]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.warc.gz").write_bytes(gzip.compress(body))
        with pytest.raises(Exception, match=said):
            warc.normalise(spark, str(tmp_path / str(i)), shared_path(spark, "test-warc"))
    # Files of several members, from elsewhere.
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole))
    warc.normalise(spark, str(tmp_path / "m"), out := shared_path(spark, "test-warc"))
    assert [r.offset for r in warc.index(spark, out).orderBy("offset").collect()][0] == 0 and warc.index(spark, out).where(F.col("offset") > 0).count() == 1
