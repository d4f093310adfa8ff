import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid
from sparkloom.llm.queries import op8_language_id


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_odd_rows(odd, none):
    model = langid.train(odd)
    got = {(r.doc_id, r.text): r for r in langid.predict(odd, model).collect()}
    assert set(model.languages) == {"de", "en", "fr"}
    assert {r.lang_pred for (_, t), r in got.items() if t is None or not any(c.isalpha() for c in t)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(odd, model).count() == odd.count()
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0 and langid.accepted(none, model).count() == 0
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and not kept.where("text IS NULL OR text = ''").count()


def test_repeated_rows_teach_once(spark):
    text = [f"voici un texte en francais numero {i}" for i in range(300)] + [f"this is an english text number {i}" for i in range(30)]
    rows = [(7, t, "fr") for t in text[:300]] + [(i, t, "en") for i, t in enumerate(text[300:])] + [(1, "one and the same", "en")] * 300 + [(None, "nobody", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sampled(docs, "text", "lang", "doc_id", 50).collect()
    assert Counter(r.lang for r in got) == {"fr": 50, "en": 31} and len({(r.lang, r.rank) for r in got}) == 81
    model = langid.train(docs, per_language=50, most_landmarks=8)
    assert model.weights.shape == (langid.WIDTH, 3)


def test_outputs_against_the_kernel(spark):
    """Scores of the query's model, from kernel values of every text with every landmark by sets of n-grams."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.substring("text", 1, 400))
    sample = langid.sampled(docs, "text", "lang", "doc_id", 30).collect()
    model = langid.train(docs, per_language=30, landmarks=5)

    def grams(t):
        return frozenset(np.flatnonzero(langid.presence([t])[0]).tolist())

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])

    order = sorted(sample, key=lambda r: (r.lang, r.text))
    marks, all_ = [grams(r.text) for r in order if r["rank"] <= 5], [grams(r.text) for r in sample]
    knm, kmm = kernel(all_, marks), kernel(marks, marks)
    y = np.array([[float(r.lang == x) for x in model.languages] for r in sample])
    a = np.linalg.solve(knm.T @ knm + langid.RIDGE * len(knm) * kmm + 1e-6 * np.eye(len(kmm)), knm.T @ y)
    texts = [r.text for r in docs.limit(60).collect()]
    assert np.abs(model.outputs(texts) - kernel([grams(t) for t in texts], marks) @ a).max() < 1e-3


def test_many_languages(spark):
    """200 made languages, each with letters of its own, are all learned and predicted; too many are an error."""
    texts = [(i, 10 * i + j, "".join(chr(0x4E00 + 7 * i + (j + k) % 7) for k in range(30))) for i in range(200) for j in range(4)]
    docs = spark.createDataFrame([(n, t, f"l{i:03}") for i, n, t in texts], "doc_id long, text string, lang string")
    for most in (langid.MOST_LANDMARKS, 250):
        model = langid.train(docs, most_landmarks=most)
        assert len(model.languages) == 200 and model.weights.shape[1] <= most + 1
        assert sum(r.lang_pred == r.lang for r in langid.predict(docs, model).collect()) >= 0.99 * len(texts)
    folded = langid.Model(model.languages, np.hstack([model.weights[:, :-1] @ model.coefficients.astype(np.float32), model.weights[:, -1:]]))
    some = [t for _, _, t in texts[::50]]
    assert np.abs(folded.outputs(some) - model.outputs(some)).max() < 1e-3
    assert len(langid.train(docs, most_landmarks=20).languages) == 200
    with pytest.raises(ValueError, match="200 languages"):
        langid.train(docs, most_languages=199)


def test_kernel_values():
    a, b = langid.presence(["abcd", "abce"])
    grams = lambda s: {s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}
    assert int(a @ b) == len(grams("abcd") & grams("abce")) and int(a.sum()) == len(grams("abcd"))
