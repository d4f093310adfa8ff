"""Alignments against both tokenizers over whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import alignment
from sparkloom.llm.queries import op11_token_alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "", " ", "  ", "\n", "\n\n x", "x\n", "a ", "a  b", "a\r\nb", "a\r\n\r\n b\r", "\ta\tb", "a　 b", "a\xa0b \xa0c", "a   b c", "▁x", "x▁y", "a ▁ b", "<|endoftext|>", "a <|endoftext|> b",
    "<s> </s> <unk> <0x41>", "é日本\U0001f600 x\U0001f600", "it's we'll 123,456.78", "\x00 a\x00b", "a\x1cb \x1c c", "ﬁ ½ Å", "é ä\ń", "(a);\r b();\r", "   indented\n    more\n\t\tx", "x" * 300, "\v\fa\vb", "\x85a\x85", "a​b ​",
]


@pytest.fixture(scope="module")
def tools():
    return alignment.Aligner(A, B)


def whole(tools, text):
    """Ids of both over the whole text, their ends, or None."""
    if not text:
        return None
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    x, y = [tools.a_bytes[i] for i in a], [tools.b_bytes[i] for i in b]
    if not b"".join(x) == b"".join(y) == (" " + text).encode():
        return None
    return a, b, x, y


def brute(tools, docs):
    """Rows of the report, every link by comparing all byte ranges."""
    made, holds = [], Counter()
    for d, text in docs:
        if (got := whole(tools, text)) is None:
            made.append((d, None))
            continue
        a, b, x, y = got
        spans = []
        for parts in (x, y):
            ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(a[i], b[j]) for i, s in enumerate(spans[0]) for j, t in enumerate(spans[1]) if s[0] < t[1] and t[0] < s[1]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = defaultdict(lambda: ([], []))
        for side, (ids, own) in enumerate(((a, spans[0]), (b, spans[1]))):
            for i, (_, e) in zip(ids, own, strict=True):
                groups[next(c for c in cuts if c >= e)][side].append(i)
        body = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for _, (p, q) in sorted(groups.items()))
        made.append((d, (len(a), len(b), len(cuts), links, hashlib.sha256(body.encode()).hexdigest())))
        holds.update(set(links))
    top = defaultdict(int)
    for (i, _), n in holds.items():
        top[i] = max(top[i], n)
    return Counter((d, 0, 0, 0, 0, 0, 0, "") if m is None else (d, *m[:3], len(m[3]), sum(holds[p] == top[p[0]] for p in m[3]), sum(holds[p] for p in m[3]), m[4]) for d, m in made)


def test_segments_have_the_tokens_of_their_text(tools):
    """The cut is safe: ids of segments, put together, are those of the whole, also where a tokenizer doesn't give the text back."""
    r = random.Random(7)
    pattern = re.compile(tools.pattern)
    parts = [*ODD, *alignment.WHITE, "a", "B", "é", "日", "'s", "1", ".", "th", "ing", "{", ");", "<0x0A>"]
    assert tools.breaks >= {" ", "\n"} and "\r" not in tools.breaks
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        segments = list(alignment.split(pattern, text))
        assert "".join(segments) == " " + text
        assert [i for e in tools.a.encode_batch(segments, add_special_tokens=False) for i in e.ids] == tools.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        if text and "▁" not in text:
            assert [i for ids in tools._b_ids(segments) for i in ids] == tools.b.encode(text), repr(text)


@pytest.mark.parametrize("block", [40, 1 << 24])
def test_odd_rows(spark, tools, monkeypatch, block):
    monkeypatch.setattr(alignment, "LONG_TEXT", 50)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "a b"), (None, None), (7, "same text here"), (7, "same text here"), (8, "same text here a b a b")]
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], "doc_id long, text string, block string, codes string, links string").repartition(3)
    got = alignment.report(df, block=block)
    assert Counter(map(tuple, got.collect())) == brute(tools, docs)
    assert alignment.report(df.limit(0)).collect() == []


def test_query(spark, sf_dir, tools, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER", 300)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [(d, t) for d, t in docs if t is None or len(t) < 6000]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, alignment.report(df, block=1 << 15).collect())) == brute(tools, short)
    got = {r.doc_id: r for r in op11_token_alignment(spark, sf_dir).collect()}
    assert got.keys() == {d for d, _ in docs}
    for d, t in docs:
        if (w := whole(tools, t)) is not None:
            assert (got[d].n_a, got[d].n_b) == (len(w[0]), len(w[1]))
