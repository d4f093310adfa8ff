"""The Arrow IPC source: round trips, overwrites, commits, filters that skip files."""

import io
import json
from contextlib import redirect_stdout
from pathlib import Path

import pytest

from sparkloom.sources import ipc
from sparkloom.sources.paths import shared_path

SCHEMA = "n long, s string, x double, t timestamp_ntz, a array<int>"


def rows_(lo, hi):
    return [(i if i % 7 else None, f"k{i:04}" if i % 5 else None, i / 3, None, [i, None] if i % 2 else None) for i in range(lo, hi)]


@pytest.fixture
def source(spark):
    ipc.register(spark)
    return spark


def test_round_trip_and_overwrite(source):
    path = shared_path(source, "ipc")
    with pytest.raises(Exception, match="no table"):
        source.read.format("arrow_ipc").load(path).count()
    one, two = (source.createDataFrame(rows_(*r), SCHEMA).repartition(3) for r in ((0, 50), (50, 90)))
    one.write.format("arrow_ipc").mode("append").save(path)
    two.write.format("arrow_ipc").mode("append").save(path)
    back = source.read.format("arrow_ipc").load(path)
    assert back.schema == one.schema and sorted(map(str, back.collect())) == sorted(map(str, one.union(two).collect()))
    one.limit(0).write.format("arrow_ipc").mode("append").save(path)
    assert source.read.format("arrow_ipc").load(path).count() == 90
    two.write.format("arrow_ipc").mode("overwrite").save(path)
    assert source.read.format("arrow_ipc").load(path).count() == 40
    # Files that no commit names don't count.
    stray = next(Path(path).glob("part-*"))
    (Path(path) / "part-stray.arrows").write_bytes(stray.read_bytes())
    assert source.read.format("arrow_ipc").load(path).count() == 40
    two.limit(0).write.format("arrow_ipc").mode("overwrite").save(path)
    assert source.read.format("arrow_ipc").load(path).collect() == []


def test_filters_skip_files(source):
    path = shared_path(source, "ipc")
    df = source.createDataFrame(rows_(0, 800), SCHEMA)
    df.repartitionByRange(8, "x").write.format("arrow_ipc").mode("append").save(path)
    for where in ("n > 700", "n >= 100 AND n < 120", "s = 'k0333'", "s IN ('k0001', 'k0799', 'zz')", "n IS NULL AND s > 'k07'", "s IS NOT NULL AND x < 10", "NOT n = 5", "n = 1 OR n = 700", "n > 5000", "size(a) > 0 AND n <= 3"):
        got = source.read.format("arrow_ipc").load(path).where(where)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.where(where).collect())), where
    narrow = source.read.format("arrow_ipc").load(path).where("n > 750")
    assert narrow.rdd.getNumPartitions() <= 2 and source.read.format("arrow_ipc").load(path).rdd.getNumPartitions() >= 8
    with redirect_stdout(io.StringIO()) as out:
        narrow.explain("formatted")
    assert "arrow_ipc" in out.getvalue()
    _, files = ipc.committed(path)
    assert sum(f.rows for f in files) == 800 and json.loads(json.dumps(files[0].boxes))
