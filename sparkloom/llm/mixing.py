"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source has a target in words. A source whose target is k times its size and
more gives k certain whole copies of every document; what is left of the target is
a fixed-size sample of its documents. For that sample a document's inclusion probability
is ``min(1, c * floor(sqrt(size)))``, with the c of its source for which the expected words
of the sample are the rest of the target; documents that reach 1 are certain. Every document
has a fixed uniform number u (from a hash of its id) and the rank ``odds(u) / odds(p)``
(Rosen, 1997); the sample is the documents of lowest rank whose words fill the rest. One
more document, the one whose size comes nearest to the words then missing, closes the gap.

The factor c is found from the words at each value of ``floor(sqrt(size))``, of which there
are few thousand for documents of millions of words: with the largest ones certain, the rest
gives c, and the first c that makes no other one certain is the source's.

No source is ordered in one task: the place where its sample ends is found by
summing sizes over cells of the rank axis, twice over ``CELLS`` cells, and only the
documents of the last cell (about one in a million) are put in order.

Defined cases: a null text has size 0 and is taken for 0 words; a null source is a
source of its own, last in order; a null id hashes the text instead; rows that agree
in id and size share a rank and enter together; empty tables give empty results;
extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, small, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
CELLS = 1024
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key; the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (_mix_source, _mix_size) rows, one row for each source: its size and its target.

    Sources in code point order (null last) get the weights in turn and share all
    words; a target stops at ``cap`` times its source and the excess is shared again.
    With the sources sorted by the level at which each is full, the level c of the
    others is found by running sums: the first source whose level is not below
    (all - full ones) / (weights of the rest) sets c. The windows run over one row
    for each source, not over documents.
    """
    per = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_words"))
    order = W.orderBy(F.col("_mix_source").isNull(), "_mix_source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
    full = W.orderBy("_full", F.col("_mix_source").isNull(), "_mix_source")
    per = per.withColumn("_full", cap * F.col("_mix_words") / F.col("_w"))
    everything = W.partitionBy()
    per = (
        per.withColumn("_all", F.sum("_mix_words").over(everything).cast("double"))
        .withColumn("_before", F.coalesce(F.sum(cap * F.col("_mix_words")).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(full.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
        .withColumn("_place", F.row_number().over(full))
    )
    level = F.coalesce(F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_place", "_level"))).over(everything)["_level"], F.max("_full").over(everything))
    return per.select("_mix_source", "_mix_words", F.least(cap * F.col("_mix_words").cast("double"), level * F.col("_w")).alias("_mix_target"))


def keyed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents with _mix_source, _mix_size, _mix_m (what the inclusion probability goes by) and _mix_odds, those of u."""
    size = word_count(F.col(text))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit("none"))
    out = docs.withColumns({"_mix_source": F.col(source), "_mix_size": size, "_mix_u": uniform(name)})
    out = out.withColumn("_mix_m", F.floor(F.sqrt(F.greatest(F.col("_mix_size"), F.lit(1)).cast("double"))))
    return out.withColumn("_mix_odds", F.col("_mix_u") / (1 - F.col("_mix_u"))).drop("_mix_u")


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(_mix_source, _mix_c): the factor of each source's inclusion probabilities. A window runs over the values of _mix_m of a source."""
    per = _same(sizes.groupBy("_mix_source", "_mix_m").agg(F.sum("_mix_size").alias("_words")), targets.select("_mix_source", "_rest"))
    larger = W.partitionBy("_mix_source").orderBy(F.desc("_mix_m"))
    per = per.withColumn("_certain", F.sum("_words").over(larger) - F.col("_words"))
    per = per.withColumn("_per_c", F.sum(F.col("_mix_m") * F.col("_words")).over(larger.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("_c", F.when(F.col("_per_c") > 0, (F.col("_rest") - F.col("_certain")) / F.col("_per_c")))
    # The least of the values that make nothing smaller certain belongs to the largest such _mix_m.
    return per.where(F.col("_c") * F.col("_mix_m") <= 1).groupBy("_mix_source").agg(F.max_by("_c", "_mix_m").alias("_mix_c"))


def ranked(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Keyed rows with _mix_rank and their cells on the rank axis."""
    out = _same(rows, factors, "left")
    p = F.least(F.coalesce("_mix_c", F.lit(0.0)) * F.col("_mix_m"), F.lit(1.0))
    out = out.withColumn("_mix_rank", F.when(p >= 1, 0.0).when(p > 0, F.col("_mix_odds") / (p / (1 - p))).otherwise(1e300)).drop("_mix_c")
    at = F.col("_mix_rank") / (1 + F.col("_mix_rank")) * CELLS
    out = out.withColumn("_mix_c1", F.least(F.floor(at), F.lit(CELLS - 1)))
    return out.withColumn("_mix_c2", F.floor((at - F.col("_mix_c1")) * CELLS))


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, where null equals null. Sources are few, so the right side is broadcast after a check of its size."""
    b = b.withColumnRenamed("_mix_source", "_mix_s2")
    return a.join(small(b), F.col("_mix_source").eqNullSafe(F.col("_mix_s2")), how).drop("_mix_s2")


def _first_over(cells: DataFrame, cell: str) -> DataFrame:
    """Of (_mix_source, cell, _words, _rest) rows, the cell of each source in which the running words pass _rest, and what remains there."""
    w = W.partitionBy("_mix_source").orderBy(cell)
    before = F.sum("_words").over(w) - F.col("_words")
    return (
        cells.withColumn("_before", before)
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")))
        .select("_mix_source", F.col(cell).alias(f"_mix_cut{cell[-1]}"), (F.col("_rest") - F.col("_before")).alias("_rest"))
    )


def decisions(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The keyed rows with their ranks, and for each source its words, target, ``_mix_k`` copies of all, the factor of its inclusion probabilities and the ranks that the sample holds."""
    targets = cut(source_targets(rows, weights, cap))
    ratio = F.when(F.col("_mix_words") > 0, F.col("_mix_target") / F.col("_mix_words")).otherwise(0.0)
    targets = targets.withColumn("_mix_k", F.least(F.floor(ratio + 1e-12), F.lit(cap)))
    targets = targets.withColumn("_rest", F.when(F.col("_mix_k") < cap, F.greatest(F.col("_mix_target") - F.col("_mix_k") * F.col("_mix_words"), F.lit(0.0))).otherwise(0.0))
    # A source whose copies make up its target needs no sample: its documents stay off the rank axis.
    wanting = targets.where("_rest > 0")
    factors = cut(inclusion(rows, wanting))
    rows = cut(ranked(rows, factors))

    level1 = _same(rows.groupBy("_mix_source", "_mix_c1").agg(F.sum("_mix_size").alias("_words")), wanting.select("_mix_source", "_rest"))
    cut1 = cut(_first_over(level1, "_mix_c1"))
    inside1 = _same(rows, cut1).where(F.col("_mix_c1") == F.col("_mix_cut1"))
    cut2 = cut(_first_over(inside1.groupBy("_mix_source", "_mix_c2", "_mix_cut1", "_rest").agg(F.sum("_mix_size").alias("_words")), "_mix_c2"))
    cell = cut1.drop("_rest").join(cut2.withColumnRenamed("_mix_source", "_s"), F.col("_mix_source").eqNullSafe(F.col("_s"))).drop("_s")
    inside2 = _same(rows, cell).where((F.col("_mix_c1") == F.col("_mix_cut1")) & (F.col("_mix_c2") == F.col("_mix_cut2")))
    # Certain documents share a rank, and are one row here.
    inside2 = inside2.groupBy("_mix_source", "_mix_rank", "_mix_cut1", "_mix_cut2", "_rest").agg(F.sum("_mix_size").alias("_words"))
    upto = F.sum("_words").over(W.partitionBy("_mix_source").orderBy("_mix_rank"))
    last = (
        inside2.withColumn("_upto", upto)
        .groupBy("_mix_source")
        .agg(F.max("_mix_cut1").alias("_mix_cut1"), F.max("_mix_cut2").alias("_mix_cut2"), F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_mix_rank"))).alias("_mix_last"), (F.max("_rest") - F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_upto"))), F.lit(0))).alias("_gap"))
    )
    ends = cut(last)
    out = _same(rows, ends).where(~_sampled() & (F.col("_mix_size") > 0))
    off = F.abs(F.col("_mix_size") - F.col("_gap"))
    closing = out.where(off < F.col("_gap")).groupBy("_mix_source").agg(F.min(F.struct(off.alias("off"), F.col("_mix_rank").alias("rank")))["rank"].alias("_mix_closing"))
    ends = _same(ends, closing, "left")
    return rows, _same(_same(targets.drop("_rest"), ends.drop("_gap"), "left"), factors, "left")


def _sampled() -> Column:
    """Whether a row's rank comes before the end of its source's sample."""
    c1, c2 = F.col("_mix_c1"), F.col("_mix_c2")
    inside = (c1 == F.col("_mix_cut1")) & ((c2 < F.col("_mix_cut2")) | ((c2 == F.col("_mix_cut2")) & F.coalesce(F.col("_mix_rank") <= F.col("_mix_last"), F.lit(False))))
    return F.coalesce((c1 < F.col("_mix_cut1")) | inside, F.lit(False))


def with_copies(rows: DataFrame, found: DataFrame, cap: int = CAP) -> DataFrame:
    """Ranked rows with ``_mix_words``, ``_mix_target`` and ``_mix_copies``, how often the mix takes each."""
    closing = F.coalesce(F.col("_mix_rank") == F.col("_mix_closing"), F.lit(False))
    out = _same(rows, found)
    copies = F.least(F.col("_mix_k") + (_sampled() | closing).cast("int"), F.lit(cap))
    return out.withColumn("_mix_copies", copies).drop("_mix_k", "_mix_cut1", "_mix_cut2", "_mix_last", "_mix_closing", "_mix_c")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row")
    rows = keyed(docs.select(own, F.col(text).alias("_mix_text"), F.col(source).alias("_mix_from"), F.col(key).alias("_mix_key")), "_mix_text", "_mix_from", "_mix_key")
    _, found = decisions(cut(rows.select("_mix_source", "_mix_size", "_mix_m", "_mix_odds")), weights, cap)
    found = cut(found)
    out = with_copies(ranked(rows, found.select("_mix_source", "_mix_c")), found, cap).where(F.col("_mix_copies") > 0)
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_copy")).select("_mix_row.*")


def mix_report(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each document: key, size, source_size, target and taken, the words that the mix takes of it."""
    rows = keyed(docs.select(F.col(text).alias("_mix_text"), F.col(source).alias("_mix_from"), F.col(key).alias("_mix_key")), "_mix_text", "_mix_from", "_mix_key")
    rows = rows.select("_mix_key", "_mix_source", "_mix_size", "_mix_m", "_mix_odds")
    out = with_copies(*decisions(cut(rows), weights, cap), cap)
    return out.select(F.col("_mix_key").alias(key), F.col("_mix_size").alias("size"), F.col("_mix_words").cast("long").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).cast("long").alias("taken"))
