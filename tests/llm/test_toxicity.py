import math
import re

import numpy as np
import pandas as pd

from sparkloom.llm import toxicity
from sparkloom.llm.queries import op6_toxicity


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, p = got["toxic"].to_numpy(), got["score"].to_numpy()
    rank = p.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.93 and (got["predicted"] == y).mean() > 0.95


def test_sentences_are_located(spark):
    docs = [(i, ("This is fine. What a rotten thing to say! Fine again." if i % 2 else "This is fine. Fine again. All of it is fine."), i % 2) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table, least_docs=2)
    found = toxicity.locate(table.where("doc_id < 2"), model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, "What a rotten thing to say")]
    whole = model.score(docs[1][1])
    parts = [model.score(s) for s in docs[1][1].replace("!", ".").split(".") if s.strip()]
    assert abs(whole - (1 - np.prod([1 - p for p in parts]))) < 1e-9


def test_query_against_its_formula(spark, sf_dir):
    """Scores of all documents, sentence by sentence from the weights of words and their beginnings; the fit is bounded in words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, least_docs=2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        clear = 1.0
        for s in re.split(r"[.!?\n]", texts[r.doc_id].lower()):
            if words := set(re.findall(r"\w+", s)):
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(f"{w[:n]}~" for n in (4, 5) if len(w) > n)])
                clear *= 1 / (1 + math.exp(z))
        assert abs(r.score - (1 - clear)) < 1e-9
    assert toxicity.train(docs, labels, least_docs=2, most_words=200).weights != model.weights


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for rows in (odd, none):
        got = toxicity.score(rows, toxicity.train(rows, labels)).collect()
        assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in toxicity.score(odd.where("trim(text) = '' OR text IS NULL"), toxicity.Model(-3.0, {})).collect())


def test_fit_against_finite_differences():
    """The same steps with the loss as it is defined and its gradient by differences."""
    r = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    docs = [[sorted(r.choice(4, int(r.integers(1, 4)), replace=False).tolist()) for _ in range(int(r.integers(1, 4)))] for _ in range(12)]
    y, share = (np.arange(12) % 3 == 0).astype(float), r.uniform(0.5, 2, 12)
    table = pd.DataFrame({"label": y.astype(int), "weight": share, "lengths": [np.array([len(s) for s in d], np.int32).tobytes() for d in docs], "index": [np.array([w for s in d for w in s], np.int32).tobytes() for d in docs]})
    share = share / share.sum()

    def loss(theta):
        total = 0.0
        for d, label, weight in zip(docs, y, share, strict=True):
            clear = np.prod([1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w in s)))) for s in d])
            total -= weight * (label * np.log(1 - clear) + (1 - label) * np.log(clear))
        return total

    theta, m, v, steps, rate, l1 = np.zeros(5), np.zeros(5), np.zeros(5), 40, 0.2, 2e-4
    theta[-1] = np.log(max(1e-3, share @ y) / max(1.0, np.mean([len(d) for d in docs])))
    for step in range(1, steps + 1):
        grad = np.array([(loss(theta + e) - loss(theta - e)) / 2e-6 for e in 1e-6 * np.eye(5)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        now = rate if step < steps // 2 else 0.3 * rate
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-6
        theta = theta - now * m / (1 - 0.9**step) / scale
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - now * np.minimum(l1 / scale[:-1], 1), 0)
    model = toxicity.fit(names, table, steps, rate, l1)
    assert abs(model.bias - theta[-1]) < 1e-3 and all(abs(model.weights.get(n, 0.0) - t) < 2e-3 for n, t in zip(names, theta, strict=False))
    assert loss(theta) < loss(np.append(np.zeros(4), theta[-1]))
