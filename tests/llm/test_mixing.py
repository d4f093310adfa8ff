import math
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import mixing


def targets_by_hand(sizes, weights=(1, 2, 3), cap=3):
    """Water filling, one full source after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_report_on_odd_rows(odd):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count()
    sizes = defaultdict(int)
    for r in odd.select("source", "text").collect():
        sizes[r.source] += len([w for w in (r.text or "").replace("\x1c", "_").replace(" ", "_").split()])
    want = targets_by_hand(sizes)
    got = {(r.source_size, round(r.target, 6)) for r in rows}
    assert got == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(odd).collect()))


def test_taken_comes_near_the_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    taken, target = defaultdict(int), {}
    for r in mixing.mix_report(docs).collect():
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    assert all(math.isclose(taken[s], target[s], rel_tol=0.02, abs_tol=40) for s in target)


def test_documents_are_taken_as_often_as_their_probability_says(spark):
    """400 sources of the same sizes, every other one of weight 2, are 200 samples each of one design."""
    sizes = [(j % 40 + 1) ** 2 for j in range(60)] + [4000]
    docs = spark.range(400 * len(sizes)).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / len(sizes)).cast("string").alias("source"), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % len(sizes) + 1).cast("int")).alias("n"))
    docs = docs.withColumn("source", F.lpad("source", 5, "0")).withColumn("text", F.repeat(F.lit("w "), F.col("n")))
    rows = mixing.mix_report(docs, weights=(1, 2)).collect()
    for target in sorted({r.target for r in rows}):
        own = [r for r in rows if r.target == target]
        rest = target % own[0].source_size
        c = rest / sum(math.isqrt(n) * n for n in sizes)
        certain: list[int] = []
        while (top := max(n for n in sizes if n not in certain)) and c * math.isqrt(top) > 1:
            certain.append(top)
            c = (rest - sum(n for n in sizes if n in certain)) / sum(math.isqrt(n) * n for n in sizes if n not in certain)
        share, want = defaultdict(list), {n: min(1.0, c * math.isqrt(n)) if n not in certain else 1.0 for n in sizes}
        for r in own:
            share[r["size"]].append(r.taken // r["size"] - target // r.source_size)
        worst = max((abs(sum(x) / len(x) - want[n]), n, want[n], len(x)) for n, x in share.items())
        assert worst[0] < 0.15, (worst, target, own[0].source_size, rest, c, certain)
        off = [(sum(x) / len(x) - want[n]) * math.sqrt(len(x)) for n, x in share.items()]
        # The document that closes the gap comes on top: about half a document of 61.
        assert abs(sum(off)) / len(off) < 0.4 and all(want[n] < 1 or set(x) == {1} for n, x in share.items())


def test_no_row_exceeds_the_cap(spark):
    """Rows without words neither."""
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, "w " * 500, "y"), (5, None, "z")], "doc_id long, text string, source string")
    assert all(r["count"] <= 3 for r in mixing.mix(docs).groupBy("doc_id").count().collect())


def test_mix_repeats_rows(odd):
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix_report(odd).collect()}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.where("doc_id = 8").count() == taken[8, 19] // 19


def test_a_source_at_its_target_is_not_ordered(spark):
    """A capped source, and documents that are certain, stand in no window: no cell's order has more than a few rows."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 23 + 1).cast("int")).alias("text"), F.when(F.col("id") % 20 == 0, "c").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.keyed(docs)
    ranked, found = mixing.decisions(rows.select("_mix_source", "_mix_size", "_mix_m", "_mix_odds"))
    ends = {r._mix_source: r for r in found.collect()}
    assert ends["c"]._mix_target == 3 * ends["c"]._mix_words and ends["c"]._mix_cut1 is None and ends["c"]._mix_closing is None
    for s in "ab":
        r = ends[s]
        assert ranked.where((F.col("_mix_source") == s) & (F.col("_mix_c1") == r._mix_cut1) & (F.col("_mix_c2") == r._mix_cut2)).select("_mix_rank").distinct().count() < 10
    assert all(r.taken == 3 * r["size"] for r in mixing.mix_report(docs).where("doc_id % 20 = 0").collect())


def test_empty(none):
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix(none).count() == 0
