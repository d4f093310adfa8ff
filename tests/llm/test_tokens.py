import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import pieces, tokenfile
from sparkloom.llm.common import shared_path
from sparkloom.llm.queries import op3_token_codes

NAME = "byte_bpe_50k.json"
ODD = ["", "\n", " x", "x ", "a  b", "a\n\nb", "it's don't we'LL, x'.", "<|endoftext|> hi", "a\tb c", "é.!! x?", "1.5, 2,000. a1. x’s.", "A\x1cb c", "日本. 語", " .", "x\n.", "who?'s a", "nicht?!..;", "a <|endoftext|>", "b<|endoftext|>c d\n<|endoftext|>", "\n\nx", "x \ny", "x\n y", " ", "\r\n", "a\u00a0b c\u3000d", "Ġ Ġa", "x" * 100 + " y"]


@pytest.mark.parametrize("room,together", [(1_000_000, 1 << 21), (5, 40)])
@pytest.mark.parametrize("added_as_text", [False, True])
def test_pieces_give_the_tokenizer_s_ids(spark, sf_dir, monkeypatch, room, together, added_as_text):
    """Against a tokenizer loaded by itself, special strings in the texts included."""
    monkeypatch.setattr(pieces, "REMEMBERED", room)
    monkeypatch.setattr(pieces, "CHARACTERS", together)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    t = Tokenizer.from_file(pieces.vocabulary(NAME))
    t.encode_special_tokens = added_as_text
    want = t.encode_batch(texts, add_special_tokens=False)
    encoder = pieces.Encoder(NAME, added_as_text)
    assert all(list(got) == w.ids for got, w in zip(encoder.encode(texts), want, strict=True))


def test_query(spark, sf_dir):
    """All rows of the query, from texts encoded whole by a tokenizer loaded by itself."""
    t = Tokenizer.from_file(pieces.vocabulary(NAME))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op3_token_codes(spark, sf_dir).collect()) == want


def test_segment_round_trip_and_direct_access():
    ids = np.random.default_rng(3).integers(0, 1 << 20, 3000).astype(np.uint32)
    ids[::3] %= 200
    s = tokenfile.Segment(tokenfile.pack([5, None, 7], np.array([1000, 0, 2000]), ids))
    assert s.doc_ids == [5, None, 7] and (s.ids() == ids).all()
    assert all(s.id_at(i) == ids[i] for i in range(0, 3000, 7))
    assert (s.document(2) == ids[1000:]).all() and not len(s.document(1))
    with pytest.raises(IndexError):
        s.id_at(3000)


def test_file_on_odd_rows(spark, odd, none):
    path = shared_path(spark, "test-tokens")
    tokenfile.write(odd, path, segment_ids=500)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(pieces.vocabulary(NAME))
    start = 0
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    crc = {(d, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, x in texts}
    for r in got:
        assert r.start == start and (r.doc_id, r.ids_crc32) in crc
        start += r.n_tokens
    tokenfile.write(none, empty := shared_path(spark, "test-tokens"))
    assert tokenfile.read(spark, empty).count() == 0
