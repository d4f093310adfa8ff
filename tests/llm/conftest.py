"""Rows that no operator may trip over."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, t string, node string, score string, kind string, rank string, part string, root string, _found string, _tox string, _pii string, _dc_key string, _id string, _h string, _lang string, _mix_size string, _mix_row string, _rest string"
_EXTRA = ("x",) * 19

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog, and then it rests. Nobody knows why it does so every morning."


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *_EXTRA)


ROWS = [
    row(1, PROSE),
    row(2, PROSE),
    row(2, PROSE),
    row(3, PROSE + " Indeed."),
    row(4, None),
    row(5, ""),
    row(6, " \t\n "),
    row(7, LONG, None, None),
    row(None, PROSE, "en", "b"),
    row(None, None, None, None),
    row(8, "Ganz anders ist dieser Text; er hat nichts mit dem Fuchs zu tun und auch nichts mit dem Hund.", "de", "b"),
    row(9, "é 日本 \U0001f600 a b\x1cc\r\nd", "fr", None),
    row(10, "one"),
    row(11, "one"),
    row(12, "12345 !!"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
