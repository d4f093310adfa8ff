"""Language identification by a blended-spectrum string kernel.

Two texts are as alike as the character n-grams (n = 1 to 4, lower case) that both
hold: ``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)``, presence only. n-grams are
hashed to ``WIDTH`` places. Some training documents of each language are landmarks;
kernel ridge regression, one language against the rest, is solved over them (the
Nystroem approximation): ``(Knm' Knm + ridge Kmm) a = Knm' Y``.

A batch of texts is a 0/1 matrix P over the n-gram places. Its kernel values with the
landmarks, times the coefficients, are ``(P L') a``; because the product is
associative, ``L' a`` is worked out once and each batch costs one matrix product.

Training looks at a bounded sample: at most ``PER_LANGUAGE`` documents of each language for the
regression, and ``LANDMARKS`` of those (fewer where there are so many languages that there would be
more than ``MOST_LANDMARKS``) as landmarks, chosen by a hash of id and text. All languages are learned:
the Gram matrix is one for all, its parts and each language's sums are added up in tasks, and
with more than ``FOLDED`` languages landmarks and coefficients stay apart, ``(P L') a`` in two
products, so that a language costs one number for each landmark. More than ``MOST_LANGUAGES`` are an
error. What the driver and a broadcast hold is bounded by these numbers. Scoring reads every whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no
training rows every text is ``und``; null ids count as held out and teach nothing; rows
without a language, or with a null text, teach nothing; rows that agree in id, text and
language teach once, other rows of one id each by themselves; equal outputs go to the
language that is first in order; extra columns are carried by ``predict`` and ignored by
the query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.llm.common import cut, small

WIDTH = 1 << 16
ORDERS = 4
LANDMARKS = 40
MOST_LANDMARKS = 640
FOLDED = 128
MOST_LANGUAGES = 10_000
#: Parts of the regression sample, one Gram matrix each.
PARTS = 16
PER_LANGUAGE = 1000
RIDGE = 1e-3
BATCH = 32
#: A text whose best language scores less than this is in none of the learned ones.
LEAST_SCORE = 0.3
_WORDISH = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDISH.finditer(text))


def mark(text: str, row: np.ndarray) -> None:
    """Set the places of a text's n-grams to 1."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    gram = np.zeros(len(c), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(c) < n:
            break
        gram = gram[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)
        row[(gram * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        mark(text, row)
    return out


@dataclass
class Model:
    languages: list[str]
    #: WIDTH x (languages + 1): landmark coefficients, and ones for a text's own norm; with many languages WIDTH x (landmarks + 1).
    weights: np.ndarray
    #: With many languages, landmarks x languages.
    coefficients: np.ndarray | None = None

    def outputs(self, texts: list[str]) -> np.ndarray:
        """Regression output of each text for each language."""
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        rows = np.zeros((BATCH, WIDTH), np.float32)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            rows.fill(0)
            for row, text in zip(rows, part, strict=False):
                mark(text, row)
            product = (rows[: len(part)] @ self.weights).astype(np.float64)
            got = product[:, :-1] / np.sqrt(np.maximum(product[:, -1:], 1))
            out[at : at + len(part)] = got if self.coefficients is None else got @ self.coefficients
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        named, score = ["und"] * len(texts), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if t is not None and self.languages and has_letter(t)]
        if able:
            got = np.clip(self.outputs([texts[i] for i in able]), 1e-6, 1)
            best = got.argmax(axis=1)
            share = got[np.arange(len(able)), best] / got.sum(axis=1)
            for i, b, s in zip(able, best, share, strict=True):
                named[i], score[i] = self.languages[b], s
        return named, score


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5; null ids too."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, by a hash of the key. A first cut by share bounds what the window sorts."""
    rows = rows.withColumn("_u", (F.xxhash64(F.col(key), F.lit(8)) + F.lit(2.0**63)) / F.lit(2.0**64))
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    few = rows.join(small(counts), F.col(by) == F.col("_by")).where(F.col("_u") * F.col("_n") < 2 * most + 100)
    w = W.partitionBy("_by").orderBy("_u", key)
    return few.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_u", "_n", "_by")


def sampled(docs: DataFrame, text: str, lang: str, key: str, per_language: int) -> DataFrame:
    """(text, lang, rank) of the training sample: distinct rows, told apart by hashes of id and text."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    counts = rows.groupBy(F.col("lang").alias("_of")).agg(F.approx_count_distinct("h").alias("n"))
    u = (F.xxhash64("h", F.lit(8)) + F.lit(2.0**63)) / F.lit(2.0**64)
    # A first cut by share bounds what is sorted. Repeated rows fall on one side of it together, and count once.
    few = rows.select("lang", "h").join(small(counts), F.col("lang") == F.col("_of")).where(u * F.col("n") < 2 * per_language + 100).select("lang", "h").distinct()
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("h", F.lit(8)), "h"))).where(F.col("rank") <= per_language)
    picked = small(ranked.select(F.col("h").alias("_h"), F.col("lang").alias("_lang"), "rank"))
    found = rows.join(picked, (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_lang"))).select("text", "lang", "rank", "h")
    return cut(found.dropDuplicates(["h", "lang"]).select("text", "lang", "rank"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, landmarks: int = LANDMARKS, per_language: int = PER_LANGUAGE, ridge: float = RIDGE, most_languages: int = MOST_LANGUAGES, most_landmarks: int = MOST_LANDMARKS) -> Model:
    """Fit on the labelled rows of ``docs``. The driver sees the whole texts of the landmarks, ``PARTS`` Gram matrices and one sum of kernel values for each language."""
    rows = sampled(docs, text, lang, key, per_language)
    n_languages = rows.select("lang").distinct().count()
    if not n_languages:
        return Model([], np.zeros((WIDTH, 1), np.float32))
    if n_languages > most_languages:
        raise ValueError(f"{n_languages} languages, more than {most_languages}")
    marks = rows.where(F.col("rank") <= max(1, min(landmarks, most_landmarks // n_languages))).select("lang", "text")
    # With more languages than landmarks some have none of their own.
    marks = marks.orderBy(F.xxhash64("lang"), "lang", "text").limit(most_landmarks).toPandas().sort_values(["lang", "text"])
    at = presence(list(marks["text"]))
    at /= np.sqrt(np.maximum(at.sum(axis=1, keepdims=True), 1))
    shared = rows.sparkSession.sparkContext.broadcast(at)

    def sums(batches):
        """A part's Gram matrix of kernel values, and for each language the number of its rows and the sum of these."""
        gram, each = np.zeros((len(at_ := shared.value), len(at_))), {}
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH]
                p = presence(list(part["text"]))
                k = ((p @ at_.T) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))).astype(np.float64)
                gram += k.T @ k
                for name, row in zip(part["lang"], k, strict=True):
                    n, total = each.get(name, (0, 0.0))
                    each[name] = n + 1, total + row
        names = sorted(each)
        yield pd.DataFrame({"lang": [None, *names], "n": [0, *[each[x][0] for x in names]], "sums": [gram.tobytes(), *[each[x][1].tobytes() for x in names]]})

    # By language and in a fixed order: what is added up doesn't depend on how rows arrive.
    parts = rows.select("lang", "text").repartition(PARTS, "lang").sortWithinPartitions("lang", "text").mapInPandas(sums, "lang string, n long, sums binary")
    got = cut(parts.select(F.spark_partition_id().alias("part"), "*"))
    per = got.where("lang IS NOT NULL").orderBy("lang").toPandas()
    grams = got.where("lang IS NULL").orderBy("part").toLocalIterator()
    gram = sum((np.frombuffer(r.sums, np.float64).reshape(len(at), -1) for r in grams), np.zeros((len(at), len(at))))
    languages, n = list(per["lang"]), int(per["n"].sum())
    kmm = (at @ at.T).astype(np.float64)
    left = gram + ridge * n * kmm + 1e-6 * np.eye(len(kmm))
    coefficients = np.linalg.solve(left, np.frombuffer(b"".join(per["sums"]), np.float64).reshape(len(per), -1).T)
    ones = np.ones((WIDTH, 1), np.float32)
    if len(languages) <= FOLDED:
        return Model(languages, np.hstack([at.T @ coefficients.astype(np.float32), ones]).astype(np.float32))
    return Model(languages, np.hstack([at.T, ones]).astype(np.float32), coefficients)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the two columns added; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<{pred}: string, {score}: double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        named, got = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({pred: named, score: got})

    own = [F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)]
    (found,) = fresh(docs.columns, "_found")
    return docs.select(*own, of(F.col(text)).alias(found)).select(*own, f"{found}.{pred}", f"{found}.{score}")


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: not ``und``, and scored ``least`` or more."""
    lang, score = fresh(docs.columns, "_lang", "_score")
    found = predict(docs, model, text, lang, score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
