"""A data source of Arrow IPC files, in both directions, with filters that skip files and writes that count when they are whole.

    register(spark)
    df.write.format("arrow_ipc").mode("append").save(path)
    spark.read.format("arrow_ipc").load(path).where("x > 3")

A table is a folder of files that Arrow's readers know, and a log of commits. Each task writes its rows to one new file, batch by
batch, and hands the file's rows and the least and greatest values of its columns to the driver; the commit of a write is one small
file in the log that names them all. Files that no commit names (of a task that was lost, of a write that was broken off) aren't read, so a write is
there whole or not at all; ``overwrite`` is a commit that says that nothing before it counts.

A read is partitioned by files. Comparisons, ``IN``, null checks and their like on columns are taken from Spark: files whose values can't
meet them aren't opened, the others are filtered batch by batch before rows go to Spark. ``register`` has the session
hand filters over (``PUSHDOWN``), and it keeps that setting. Each file is read as a stream: a task holds one batch.

Paths are those of any file system that Arrow knows (local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARED = {D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path.rstrip("/"))
    return fs.FileSystem.from_uri(path)


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json"))


def _plain(v: Any) -> Any:
    """A value that JSON keeps and that compares as it did; None where there is no such thing."""
    return v if isinstance(v, (int, float, str)) and not isinstance(v, bool) and v == v else None


@dataclass
class _File:
    name: str
    rows: int
    #: Least and greatest value and nulls by column; columns of other kinds are absent.
    boxes: dict[str, list]


def committed(path: str) -> tuple[StructType | None, list[_File]]:
    """The schema of a table and the files that its commits name."""
    store, root = _store(path)
    schema, files = None, []
    for name in _names(store, f"{root}/_log"):
        with store.open_input_stream(f"{root}/_log/{name}") as f:
            entry = json.loads(f.read())
        if entry["overwrite"]:
            files = []
        schema = StructType.fromJson(entry["schema"])
        files += [_File(**x) for x in entry["files"]]
    return schema, files


def _may_hold(f: D.Filter, file: _File) -> bool:
    """Whether a file can have a row that passes. Text is compared by code point, as Spark does, and kept whole in the boxes."""
    box = file.boxes.get(f.attribute[0])
    if box is None:
        return True
    low, high, nulls = box
    if isinstance(f, D.IsNull):
        return nulls > 0
    if isinstance(f, D.IsNotNull):
        return nulls < file.rows
    if low is None:
        return nulls < file.rows
    values = f.value if isinstance(f, D.In) else [f.value]
    if any(type(v) is not type(low) and not all(isinstance(x, (int, float)) for x in (v, low)) for v in values):
        return True
    if isinstance(f, (D.EqualTo, D.In)):
        return any(low <= v <= high for v in values)
    v = f.value
    return {D.GreaterThan: high > v, D.GreaterThanOrEqual: high >= v, D.LessThan: low < v, D.LessThanOrEqual: low <= v}[type(f)]


def _mask(f: D.Filter, batch: pa.RecordBatch) -> pa.Array:
    column = batch.column(f.attribute[0])
    if isinstance(f, D.IsNull):
        return pc.is_null(column)
    if isinstance(f, D.IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, D.In):
        return pc.is_in(column, pa.array(list(f.value), column.type))
    return _COMPARED[type(f)](column, pa.scalar(f.value, column.type))


@dataclass
class _Part(D.InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        simple = {x.name: x.dataType.typeName() for x in self.schema}
        for f in filters:
            taken = type(f) in (*_COMPARED, D.In, D.IsNull, D.IsNotNull) and len(f.attribute) == 1 and simple.get(f.attribute[0]) in ("long", "integer", "short", "byte", "string")
            if taken:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        _, files = committed(self.path)
        return [_Part(x.name) for x in files if x.rows and all(_may_hold(f, x) for f in self.filters)] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        names = [x.name for x in self.schema]
        with store.open_input_stream(f"{root}/{partition.name}") as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                for x in self.filters:
                    batch = batch.filter(_mask(x, batch))
                if batch.num_rows:
                    yield batch.select(names)


@dataclass
class _Written(D.WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, rows, boxes, out = f"part-{uuid.uuid4().hex}.arrows", 0, {}, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}")
                    sink = pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                sink.write_batch(batch)
                rows += batch.num_rows
                for c, column in zip(batch.schema.names, batch.columns, strict=True):
                    if pa.types.is_integer(column.type) or pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                        ends = pc.min_max(column)
                        low, high = _plain(ends["min"].as_py()), _plain(ends["max"].as_py())
                        old = boxes.get(c, [None, None, 0])
                        pick = lambda f, a, b: b if a is None else a if b is None else f(a, b)
                        boxes[c] = [pick(min, old[0], low), pick(max, old[1], high), old[2] + column.null_count]
        finally:
            if out is not None:
                sink.close()
                out.close()
        return _Written([{"name": name, "rows": rows, "boxes": boxes}] if rows else [])

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/_log", recursive=True)
        last = _names(store, f"{root}/_log")
        number = int(last[-1].split("-")[0]) + 1 if last else 0
        entry = {"schema": self.schema.jsonValue(), "overwrite": self.overwrite, "files": [f for m in messages if m for f in m.files]}
        # Written aside and moved: a commit is there whole or not at all.
        with store.open_output_stream(f"{root}/_log/{self.id}.tmp") as f:
            f.write(json.dumps(entry).encode())
        store.move(f"{root}/_log/{self.id}.tmp", f"{root}/_log/{number:012d}-{self.id}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{root}/{f['name']}")


class IpcSource(D.DataSource):
    """``path`` names the table."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        schema, _ = committed(self.options["path"])
        if schema is None:
            raise ValueError(f"there is no table at {self.options['path']}")
        return schema

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, filters included."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(IpcSource)
