"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def plain(v):
    """A value that both engines spell alike."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, sql: str, sf_dir: str) -> None:
    names, want = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
