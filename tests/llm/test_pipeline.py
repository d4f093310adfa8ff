from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from sparkloom.llm import decontam, langid, pieces
from sparkloom.llm.common import shared_path
from sparkloom.llm.sql import SQL


def in_a_learned_language(docs):
    """Ids that ridge regression on the kernel accepts, with one matrix for all texts."""
    rows = langid.sampled(docs, "text", "lang", "doc_id", langid.PER_LANGUAGE).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    p = langid.presence([r.text for r in rows])
    p /= np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
    marks = p[[r["rank"] <= langid.LANDMARKS for r in rows]]
    names = sorted({r.lang for r in rows})
    y = np.array([[float(r.lang == n) for n in names] for r in rows])
    k = (p @ marks.T).astype(float)
    kmm = (marks @ marks.T).astype(float)
    a = np.linalg.solve(k.T @ k + langid.RIDGE * len(rows) * kmm + 1e-6 * np.eye(len(marks)), k.T @ y)
    out = set()
    for r in docs.collect():
        if r.text and any(c.isalpha() for c in r.text):
            q = langid.presence([r.text])
            got = np.clip((q / np.sqrt(q.sum()) @ marks.T) @ a, 1e-6, 1)[0]
            if got.max() / got.sum() >= langid.LEAST_SCORE:
                out.add(r.doc_id)
    return out


def firsts_of_groups(texts):
    """The smallest id of every group of documents that 5-word shingles link at 0.8."""
    sets = {}
    for d, t in texts.items():
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d for d in ids if top(d) == d}


def with_an_item(texts, items):
    """Ids of documents with a window of one and a half lengths of an item that has four fifths of its question and of its answer in order."""
    parts = [decontam.question_and_answer(t) for t in items]
    out = set()
    for d, t in texts.items():
        words = decontam.words_of(t)
        for q, a in parts:
            need = Counter(q + a)
            width = 3 * (len(q) + len(a)) // 2
            if sum((Counter(words) & need).values()) < 0.8 * (len(q) + len(a)) - 1:
                continue
            for at in range(max(1, len(words) - width + 1)):
                window = words[at : at + width]
                if window and window[0] in need and min(decontam.in_order(q, window), decontam.in_order(a, window)) >= decontam.OVERLAP:
                    out.add(d)
                    break
    return out


def test_stages(spark, sf_dir):
    """What every stage keeps, against plain code over its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen, paths = {}, {}
    first = docs
    for name, stage in P.STAGES:
        paths[name] = shared_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(paths[name])
        docs = seen[name] = spark.read.parquet(paths[name])
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    assert all(seen[n].columns == columns for n, _ in P.STAGES[:-1])
    texts = {n: {r.doc_id: r.text for r in df.collect()} for n, df in seen.items() if n != "tokens"}
    assert texts["language"].keys() == in_a_learned_language(first)
    assert texts["near_duplicates"].keys() == firsts_of_groups(texts["language"]) < texts["language"].keys()
    leaks = with_an_item(texts["near_duplicates"], items)
    assert texts["near_duplicates"].keys() - texts["decontaminate"].keys() == leaks and leaks

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{paths['decontaminate']}/*.parquet'")
    got = con.execute(SQL["op1_mix"])
    names = [c[0] for c in got.description]
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    mixed = Counter(r.doc_id for r in seen["mix"].select("doc_id").collect())
    assert all(mixed[r["doc_id"]] * r["size"] == r["taken"] for r in want) and sum(r["taken"] > 0 for r in want) > 50

    t = Tokenizer.from_file(pieces.vocabulary("byte_bpe_50k.json"))
    length = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in texts["mix"].items()}
    start = 0
    for r in sorted(seen["tokens"].collect(), key=lambda r: r.start):
        assert r.start == start and r.n_tokens == length[r.doc_id]
        start += r.n_tokens
    last = Counter(r.doc_id for r in seen["tokens"].collect())
    assert last == mixed
    # The whole run is these stages, one after the other.
    assert Counter(map(tuple, P.run(spark, sf_dir).collect())) == Counter(map(tuple, seen["tokens"].collect()))


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table, stage by stage."""
    for name, stage in P.STAGES:
        empty, got = stage(spark, none, sf_dir), stage(spark, odd, sf_dir)
        assert empty.count() == 0, name
        rows = got.collect()
        if name == "tokens":
            assert len(rows) == odd.count() and sum(r.n_tokens == 1 for r in rows) >= 3
            continue
        assert got.columns == odd.columns, name
        left = Counter(map(str, rows)) - Counter(map(str, odd.collect()))
        assert name == "mix" or not left, name
        if name == "language":
            assert not [r for r in rows if not (r.text or "").strip()]
        if name == "near_duplicates":
            assert {r.doc_id for r in rows} >= {1, 4, 5, 7, 8, 10} and not [r for r in rows if r.doc_id in (2, 11)]
        if name == "decontaminate":
            assert len(rows) == odd.count()
