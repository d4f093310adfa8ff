"""Benchmark decontamination: every training passage is a BM25 query against an index of test items.

The index is built by Spark: words of the items, document frequencies, BM25 impacts and
each item's own score (that of the item asked for with its own words). Impacts are
divided by ``share`` times the own score, so that one threshold, 1, serves all items: a
passage finds an item if it earns that share of what the item itself would.

Items are dealt by a hash to shards of about ``SHARD_ITEMS`` items and ``SHARD_CHARACTERS`` and numbered
within them; a shard is built in a task and stored. Shards are broadcast, as many at once as ``ROUND_BYTES``
allows, so a benchmark of any size will do, and the corpus is read once for each such round.
Within a shard items stand in blocks, and every term has its largest impact in each block.

A document is cut into passages of ``2.5 * stride`` words, one for each ``stride`` words,
where the stride is the length of the longest item of the shard (made even): every window of words that
verification may accept, one and a half item lengths, lies whole in some passage. The block maxima of a passage's distinct
terms are summed for a batch of passages at once; blocks whose sum stays below 1 are
skipped, and in the others WAND moves its cursors from pivot to pivot (Ding and Suel,
2011). All items above the threshold come out, however many.

What is found is verified. Every window of the passage of one and a half item lengths that
has words enough is aligned with the item's question and answer (an item is one text here:
the answer is its last sentence, with those before it until there are ``LEAST_ANSWER`` words,
or the last third of the words where that leaves no question), and both must have ``overlap`` of their words there, in order; the overlaps of the
best window are reported, that in which the smaller one is largest, the first of equal ones.

Defined cases: null or empty texts on either side match nothing; items without an id are
left out; items with equal ids are found under that id; repeated document rows are reported once;
an empty table gives an empty report; extra columns don't matter.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.columns import fresh
from sparkloom.llm.common import cut, small, stored

SHARD_ITEMS = 1024
SHARD_CHARACTERS = 4 << 20
#: Bytes (about) of the shards that are broadcast at once.
ROUND_BYTES = 64 << 20
BLOCKS = 32
K1 = 1.2
B = 0.75
#: Share of an item's own score that a passage must earn.
SHARE = 0.6
#: Share of the words of question and of answer that must stand in the passage in order.
OVERLAP = 0.8
#: Words that an answer has at least.
LEAST_ANSWER = 5
#: Words of documents that are worked on at once; a longer document is worked on in parts that overlap by a window.
CHUNK_WORDS = 100_000
#: Characters from which the words of a text aren't listed but counted off.
LONG_TEXT = 1 << 20

_WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    all_words = [w for p in parts for w in p]
    at = len(all_words)
    for part in reversed(parts[1:]):
        at -= len(part)
        if len(all_words) - at >= LEAST_ANSWER:
            return all_words[:at], all_words[at:]
    at = len(all_words) - len(all_words) // 3
    return all_words[:at], all_words[at:]


@dataclass
class Shard:
    """The index of some items. Terms and items go by number."""

    terms: dict[str, int]
    ids: list[int]
    questions: list[list[int]]
    answers: list[list[int]]
    #: Postings of term t: items[start[t]:start[t + 1]], ascending, with their impacts.
    start: np.ndarray
    items: list[int]
    impacts: list[float]
    #: Items in a block, and the largest impact of each term in each block.
    width: int
    maxima: np.ndarray
    stride: int

    @property
    def bytes(self) -> int:
        """About what the index takes."""
        return self.maxima.nbytes + 72 * len(self.items) + 120 * len(self.terms) + 40 * sum(len(q) + len(a) for q, a in zip(self.questions, self.answers, strict=True))

    def parts(self, text: str) -> list[np.ndarray]:
        """A text's words as term numbers (-1: not in the index), in parts of bounded length that no passage is cut by."""
        low, number = text.lower(), self.terms.get
        if len(low) < LONG_TEXT:
            w = _WORDS.findall(low)
            all_ = np.fromiter(map(number, w, repeat(-1)), np.int32, len(w))
        else:
            all_ = np.fromiter((number(m.group(), -1) for m in _WORDS.finditer(low)), np.int32)
        step, window = max(1, CHUNK_WORDS // self.stride) * self.stride, 3 * self.stride // 2
        return [all_[at : at + step + window] for at in range(0, max(1, len(all_) - window), step)]

    def wand(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """(item, score) of every item with a score of 1 or more for a set of terms, looking only into the given blocks."""
        found = []
        for block in blocks:
            low, high = block * self.width, (block + 1) * self.width
            cursors = []  # [item at the cursor, position, end, block maximum]
            for t in terms:
                if (most := float(self.maxima[t, block])) > 0:
                    end = int(self.start[t + 1])
                    at = bisect_left(self.items, low, int(self.start[t]), end)
                    cursors.append([self.items[at], at, end, most])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for i, c in enumerate(cursors):
                    bound += c[3]
                    if bound >= 1:
                        pivot = i
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0]
                if cursors[0][0] == item:
                    score = 0.0
                    for c in cursors:
                        if c[0] != item:
                            break
                        score += self.impacts[c[1]]
                        c[1] += 1
                    if score >= 1:
                        found.append((item, score))
                else:
                    for c in cursors[:pivot]:
                        c[1] = bisect_left(self.items, item, c[1], c[2])
                for c in cursors:
                    c[0] = self.items[c[1]] if c[1] < c[2] else high
                cursors = [c for c in cursors if c[0] < high]
        return found

    def passages(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """For documents as term numbers (-1: not in the index): the distinct (passage, term) pairs, and each passage's document and first word."""
        lengths = np.array([len(d) for d in docs])
        # In halves of a stride a passage has five, from each second one on.
        half = self.stride // 2
        count = np.maximum(1, -(-(lengths - 3 * half) // self.stride))
        first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        term = np.concatenate(docs)
        known = term >= 0
        doc, at, term = doc[known], place[known] // half, term[known]
        pairs = []
        for back in range(3):
            step = at // 2 - back
            inside = (step >= 0) & (step < count[doc]) & (at - 2 * step < 5)
            pairs.append((first[doc] + step)[inside] * len(self.terms) + term[inside])
        pairs = np.concatenate(pairs)
        owner = np.repeat(np.arange(len(docs)), count)
        return np.unique(pairs), owner, (np.arange(first[-1]) - first[owner]) * self.stride

    def found_in(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(document, item, score, words of the passage) of all that reach the threshold."""
        if not sum(map(len, docs)):
            return
        pairs, owner, begin = self.passages(docs)
        passage, term = np.divmod(pairs, len(self.terms))
        if not len(pairs):
            return
        edges = np.flatnonzero(np.diff(passage, prepend=-1))
        bound = np.add.reduceat(self.maxima[term], edges, axis=0)
        ends = np.append(edges[1:], len(pairs))
        open_ = bound >= 1
        for i in np.flatnonzero(open_.any(axis=1)):
            p = passage[edges[i]]
            for item, score in self.wand(term[edges[i] : ends[i]].tolist(), np.flatnonzero(open_[i]).tolist()):
                yield owner[p], item, score, docs[owner[p]][begin[p] : begin[p] + 5 * self.stride // 2]

    def verified(self, item: int, passage: np.ndarray, overlap: float = OVERLAP) -> tuple[float, float]:
        """The shares of question and answer that stand in order in the best window of one and a half item lengths; 0, 0 where no window has the words for it."""
        question, answer = self.questions[item], self.answers[item]
        own = np.isin(passage, question + answer)
        width = min(len(passage), 3 * (len(question) + len(answer)) // 2)
        last = len(passage) - width
        # A window that begins with another word holds no more of the item than the next one.
        starts = np.append(np.flatnonzero(own[:last]), last)
        for words in (question, answer):
            inside = np.concatenate([[0], np.cumsum(np.isin(passage, words))])
            starts = starts[inside[starts + width] - inside[starts] >= overlap * len(words) - 1e-9]
        best = (0.0, 0.0)
        for at in starts.tolist():
            part = passage[at : at + width].tolist()
            q = in_order(question, part)
            if q < overlap:
                continue
            a = in_order(answer, part)
            if (min(q, a), q, a) > (min(best), *best):
                best = q, a
                if min(best) == 1:
                    break
        return best


def in_order(needed: list[int], there: list[int]) -> float:
    """The share of ``needed`` in its longest common subsequence with ``there``, a row of bits at a time."""
    if not needed:
        return 1.0
    masks: dict[int, int] = {}
    for i, w in enumerate(needed):
        masks[w] = masks.get(w, 0) | 1 << i
    all_ = (1 << len(needed)) - 1
    row = all_
    for w in there:
        if m := masks.get(w):
            hit = row & m
            row = (row + hit | row - hit) & all_
    return (len(needed) - row.bit_count()) / len(needed)


def build(items: DataFrame, *, share: float = SHARE, text: str = "text", key: str = "item_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The index as rows: shard, term, item numbers and impacts of its postings, and the items' own rows."""
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    rows = cut(rows.withColumn("h", F.xxhash64("id", "text")))
    count, characters = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-count // shard_items), -(-characters // SHARD_CHARACTERS))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    # The window sees numbers alone, not the texts.
    number = rows.select("shard", "id", "h").withColumn("no", F.row_number().over(W.partitionBy("shard").orderBy("id", "h")) - 1)
    rows = rows.join(number.drop("shard"), ["id", "h"]).select("shard", "no", "id", "text")

    def spelled(batches):
        for pdf in batches:
            out = [(shard, no, t, len(w), n) for shard, no, _, body in pdf.itertuples(index=False) if (w := words_of(body)) for t, n in Counter(w).items()]
            yield pd.DataFrame(out, columns=["shard", "no", "term", "words", "tf"])

    terms = cut(rows.mapInPandas(spelled, "shard int, no int, term string, words int, tf int"))
    n, mean = terms.select("shard", "no", "words").distinct().agg(F.count(F.lit(1)), F.avg("words")).first()
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.lit(mean or 1.0)))
    weighed = terms.join(df, "term").withColumn("impact", weight)
    own = weighed.groupBy("shard", "no").agg(F.sum("impact").alias("own"))
    weighed = weighed.join(own, ["shard", "no"]).select("shard", "no", "term", (F.col("impact") / (share * F.col("own"))).alias("impact"))
    postings = weighed.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("no", "impact"))).alias("p"))
    return postings.select("shard", "term", F.col("p.no").alias("items"), F.col("p.impact").alias("impacts"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).unionByName(
        rows.select("shard", F.lit(None).cast("string").alias("term"), F.array("no").alias("items"), F.lit(None).cast("array<double>").alias("impacts"), "id", "text")
    )


def shard_of(rows: pd.DataFrame) -> Shard | None:
    """One shard from its rows; None if its items have no words."""
    lists = rows[rows["term"].notna()].sort_values("term")
    if lists.empty:
        return None
    texts = rows[rows["term"].isna()].copy()
    texts["no"] = [x[0] for x in texts["items"]]
    texts = texts.sort_values("no")
    n = len(texts)
    terms = {t: i for i, t in enumerate(lists["term"])}
    parts = [question_and_answer(t) for t in texts["text"]]
    items = np.concatenate(lists["items"].to_numpy()).astype(np.int64)
    impacts = np.concatenate(lists["impacts"].to_numpy()) * (1 + 1e-9)  # sums in another order still reach the threshold
    lengths = np.array([len(x) for x in lists["items"]])
    width = -(-n // BLOCKS)
    maxima = np.zeros((len(terms), -(-n // width)))
    np.maximum.at(maxima, (np.repeat(np.arange(len(terms)), lengths), items // width), impacts)
    return Shard(
        terms, [int(x) for x in texts["id"]], [[terms[w] for w in q] for q, _ in parts], [[terms[w] for w in a] for _, a in parts],
        np.concatenate([[0], np.cumsum(lengths)]), items.tolist(), impacts.tolist(), width, (maxima * (1 + 1e-6)).astype(np.float32), 2 * max(8, -(-max(len(q) + len(a) for q, a in parts) // 2)),
    )


_REPORT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def rounds(index: DataFrame) -> Iterator[list[Shard]]:
    """The shards, built in tasks and stored, as many at once as may be broadcast together: the driver holds one round."""

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        shard = shard_of(rows)
        out = [] if shard is None else [(int(rows["shard"].iloc[0]), shard.bytes, pickle.dumps(shard))]
        return pd.DataFrame(out, columns=["no", "size", "shard"])

    made = stored(index.groupBy("shard").applyInPandas(built, "no int, size long, shard binary"))
    now, room = [], 0

    def load() -> list[Shard]:
        return [pickle.loads(r.shard) for r in made.where(F.col("no").isin(now)).orderBy("no").select("shard").collect()]

    for no, size in made.select("no", "size").orderBy("no").toLocalIterator():
        if now and room + size > ROUND_BYTES:
            yield load()
            now, room = [], 0
        now.append(no)
        room += size
    if now:
        yield load()


def report(docs: DataFrame, items: DataFrame, *, share: float = SHARE, overlap: float = OVERLAP, text: str = "text", key: str = "doc_id", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every test item found in a document; score is the share of the item's own."""
    spark = docs.sparkSession
    index = cut(build(items, share=share, shard_items=shard_items))
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    out = spark.createDataFrame([], _REPORT)
    for shards in rounds(index):
        shared = spark.sparkContext.broadcast(shards)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for s in shared.value:
                    ids, held, total = [], [], 0

                    def flush(s=s) -> None:
                        for d, item, score, passage in s.found_in(held):  # noqa: B023
                            q, a = s.verified(item, passage, overlap)
                            if q >= overlap and a >= overlap:
                                rows.append((ids[d], s.ids[item], score * share, q, a))  # noqa: B023

                    for id_, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                        for part in s.parts(t):
                            ids.append(None if pd.isna(id_) else int(id_))
                            held.append(part)
                            total += len(part)
                            if total >= CHUNK_WORDS:
                                flush()
                                ids, held, total = [], [], 0
                    flush()
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64"})

        out = out.unionByName(body.mapInPandas(search, _REPORT))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap")


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents in which no test item was found. They are matched by a hash of the text, so rows without an id and repeated ids will do."""
    (found,) = fresh(docs.columns, "_found")
    rows = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("body"))
    bad = report(rows, items, text="body", key="h", **options)
    bad = small(bad.select(F.col("doc_id").alias(found)).distinct())
    return docs.join(bad, F.xxhash64(F.col(text)) == F.col(found), "left_anti")
