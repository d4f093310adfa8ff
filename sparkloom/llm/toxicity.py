"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's chance of being toxic is the logistic of a bias and the weights of its
distinct words, a word's weight being the sum of its own and those of its first four and
five characters (compounds and endings share these); a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. The
weights are learned from document labels alone, by proximal gradient steps on the
document likelihood, so that the sentences which explain a label are found on the way:
``locate`` returns them.

The model is fitted on a bounded sample of the labelled rows, ``PER_LABEL`` documents and
about ``MOST_WORDS`` words of each label by a hash of the id, weighted back to the true shares; words and beginnings in
fewer than ``LEAST_DOCS`` documents of the sample are left out. Scoring reads every whole text.

Defined cases: null and empty texts, and those without a word, score 0; labels without
an id, or null, teach nothing; several labels of one id count as their largest; with no
labels every text scores 0; a null id counts as held out; repeated rows are scored alike;
extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.llm.common import cut, word_count
from sparkloom.llm.langid import sample

PER_LABEL = 3000
LEAST_DOCS = 4
BEGINNINGS = (4, 5)
#: Words of the sample of a label; what comes after them, by a hash of the id, is left out of the fit.
MOST_WORDS = 2_000_000
STEPS = 80
RATE = 0.2
#: Words whose weight a worker remembers.
REMEMBERED = 500_000
#: Pull of a weight towards 0, as a share of the sample.
L1 = 2e-4
#: A sentence is offending from here.
OFFENDING = 0.5

_TOKENS = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """A word and, marked, its beginnings."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


class Weigher(dict):
    """Word -> weight, the sum over its features, remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        get = self.weights.get
        self[word] = w = sum(get(f, 0.0) for f in features(word))
        return w


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence that has a word."""
    out: list[list[str]] = []
    words: list[str] = []
    for t in _TOKENS.findall(text.lower()):
        if t in _ENDS:
            if words:
                out.append(list(dict.fromkeys(words)))
                words = []
        else:
            words.append(t)
    return out + [list(dict.fromkeys(words))] if words else out


@dataclass
class Model:
    bias: float = -20.0
    #: By feature.
    weights: dict[str, float] = field(default_factory=dict)

    @cached_property
    def of(self) -> Weigher:
        return Weigher(self.weights)

    def score(self, text: str | None) -> float:
        """The noisy-or of a text's sentences."""
        if not text:
            return 0.0
        # Sentences in which no word has a weight are only counted.
        plain, mass, any_word = 0, 0.0, False
        own: dict[str, float] = {}
        tokens = [*_TOKENS.findall(text.lower()), "."]
        for t, w in zip(tokens, map(self.of.__getitem__, tokens), strict=True):
            if t in _ENDS:
                if own:
                    mass += float(np.logaddexp(0.0, self.bias + sum(own.values())))
                    own = {}
                elif any_word:
                    plain += 1
                any_word = False
            else:
                any_word = True
                if w:
                    own[t] = w
        return float(-np.expm1(-(mass + plain * np.logaddexp(0.0, self.bias))))

    def offending(self, text: str | None, least: float = OFFENDING) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that score at least ``least``, in code points, end exclusive."""
        out = []
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            words = set(_TOKENS.findall(m.group().lower()))
            z = self.bias + sum(self.of[w] for w in words)
            if words and (p := float(1 / (1 + np.exp(-z)))) >= least:
                body = m.group()
                out.append((m.start() + len(body) - len(body.lstrip()), m.end(), p))
        return out


def fit(names: list[str], docs: pd.DataFrame, steps: int = STEPS, rate: float = RATE, l1: float = L1) -> Model:
    """Fit to documents given as: label, weight, lengths (features of each sentence), index (feature numbers of all sentences, joined)."""
    y, share = docs["label"].to_numpy(float), docs["weight"].to_numpy(float)
    lengths = [np.frombuffer(b, np.int32) for b in docs["lengths"]]
    per_doc = np.array([len(x) for x in lengths])
    lengths, index = np.concatenate(lengths), np.frombuffer(b"".join(docs["index"]), np.int32)
    sentence_of, doc_of = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(docs)), per_doc)
    share = share / share.sum()
    # Theta holds the weights and, last, the bias; Adam steps with a shrinking of the weights.
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(max(1e-3, float(share @ y)) / max(1.0, per_doc.mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence_of, theta[index], len(lengths))
        mass = np.bincount(doc_of, np.logaddexp(0, z), len(docs))
        pull = share * ((1 - y) - y / np.maximum(np.expm1(np.minimum(mass, 50.0)), 1e-9))
        g = pull[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(index, g[sentence_of], len(names)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        now = rate * (1 if step < steps // 2 else 0.3)
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-6
        theta -= now * m / (1 - 0.9**step) / scale
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - now * np.minimum(l1 / scale[:-1], 1.0), 0)
    return Model(float(theta[-1]), {w: float(x) for w, x in zip(names, theta[:-1], strict=True) if abs(x) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", *, per_label: int = PER_LABEL, least_docs: int = LEAST_DOCS, most_words: int = MOST_WORDS) -> Model:
    """Fit on a bounded sample of the documents that ``labels`` (key, label) marks. What reaches the driver is the sample as feature numbers."""
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    picked = cut(sample(marks, "y", "id", per_label).select(F.col("id").alias("_id"), "y", "_rank"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    # ``picked`` has at most per_label rows of each label. Repeated rows teach once.
    rows = cut(rows.join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "y", "_rank", "text").dropDuplicates(["id", "text"]))
    upto = F.sum("n").over(W.partitionBy("y").orderBy("_rank", "h").rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.select("id", "y", "_rank", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("n"))
    fits = cut(sizes.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < most_words).select(F.col("id").alias("_id"), "h", F.col("y").alias("_y")))
    taken = {r["_y"]: r["n"] for r in fits.groupBy("_y").agg(F.count_distinct("_id").alias("n")).collect()}
    rows = rows.join(F.broadcast(fits), (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("h"))).select("y", "text")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": [f for t in pdf["text"] for f in dict.fromkeys(f for s in sentences(t) for w in s for f in features(w))]})

    found = rows.select("text").mapInPandas(words, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    vocabulary = sorted(found.select("word").toPandas()["word"])
    number = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = number.value.get
        for pdf in batches:
            out = []
            for y, t in zip(pdf["y"], pdf["text"], strict=True):
                own = [[n for w in s for f in features(w) if (n := get(f)) is not None] for s in sentences(t)]
                out.append((int(y), np.array([len(s) for s in own], np.int32).tobytes(), np.array([n for s in own for n in s], np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["label", "lengths", "index"])

    got = rows.mapInPandas(numbered, "label int, lengths binary, index binary").toPandas()
    if got.empty or got["label"].nunique() < 2:
        return Model()
    got = got.sort_values(["label", "lengths", "index"])
    got["weight"] = [counts[y] / taken[y] for y in got["label"]]
    got["label"] = (got["label"] > 0).astype(int)
    return fit(vocabulary, got)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans``, the offending sentences as start:end, comma-joined; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, spans: string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            p = m.score(t)
            out.append((p, ",".join(f"{a}:{b}" for a, b, _ in m.offending(t)) if p >= 0.5 else ""))
        return pd.DataFrame(out, columns=["score", "spans"])

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "spans")]
    (found,) = fresh(docs.columns, "_tox")
    return docs.select(*own, of(F.col(text)).alias(found)).select(*own, f"{found}.score", f"{found}.spans")


def locate(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = OFFENDING) -> DataFrame:
    """(doc_id, start, end, score, sentence) of every offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(None if pd.isna(k) else k, a, b, p, t[a:b]) for k, t in zip(pdf["k"], pdf["t"], strict=True) if t for a, b, p in shared.value.offending(t, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score", "sentence"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(of, "doc_id long, start int, end int, score double, sentence string")

