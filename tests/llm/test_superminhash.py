from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.llm import linking
from sparkloom.llm import superminhash as s
from sparkloom.llm.components import components


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(5)
    off = []
    for _ in range(60):
        a = r.integers(0, 2**63, 400).astype(np.uint64)
        n = int(r.integers(100, 390))
        b = np.concatenate([a[:n], r.integers(0, 2**63, 400 - n).astype(np.uint64)])
        x, y = s.signatures([np.unique(a), np.unique(b)])
        off.append((x == y).mean() - n / (800 - n))
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.045


def test_long_documents(monkeypatch):
    """Worked on in blocks and slices, a text has the set and the signature that it has at once."""
    texts = [" ".join(f"w{(i * i) % 997}\n" * (i % 3) + f"é{i % 71}" for i in range(3000)), "a b c", "", " \t\n ", "x" * 5000]
    sets = [s.shingles(t, 2) for t in texts]
    sig = s.signatures(sets)
    monkeypatch.setattr(s, "BLOCK_BYTES", 97)
    monkeypatch.setattr(s, "CHUNK", 50)
    again = [s.shingles(t, 2) for t in texts]
    assert all((a == b).all() for a, b in zip(sets, again, strict=True)) and (s.signatures(again) == sig).all()


def by_hand(rows, k, percent=80):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = s.shingles(t, k)
        sets[i] = set(w.tolist())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    member = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        member[find(i)].append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in member[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def test_chains_and_odd_rows(spark, odd, none):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 40]) for i in range(0, 20, 2)]  # neighbours are linked, the ends aren't
    loose = [" ".join(words[:30] + [f"x{i}{j}" for j in range(12)]) for i in range(12)]  # alike, yet below the threshold
    more = [(100 + i, t) for i, t in enumerate(chain + loose)]
    docs = odd.select("doc_id", "text", "node", "root", "h").union(spark.createDataFrame([(*m, "x", "x", "x") for m in more], "doc_id long, text string, node string, root string, h string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        got = s.groups(docs, k=k).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == by_hand(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = s.kept(docs, k=5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 7, 8, 10}
    assert kept.where("doc_id IN (2, 11)").count() == 0
    assert s.groups(none).count() == 0


def test_links_of_the_bucket_own_band():
    """A block whose members agree in an earlier band than the bucket's; the second of the nodes apart shares the bucket's alone."""
    family, inside, outside = [1] * 15, [1] * 10 + [2] * 5, [3] * 5 + [1] * 10
    elements = np.arange(40, dtype=np.uint64).tobytes()

    def rows(found, bucket, x, y):
        return pd.DataFrame([(bucket, 0, 0, x, y, n, root, "f", 40, np.array(sig, np.uint16).tobytes(), elements) for n, root, sig in found], columns=["bucket", "p", "q", "x", "y", "node", "root", "largest", "n", "sig", "payload"])

    apart, members = [("x0", "x0", inside), ("x1", "x1", outside)], [(f"f{i}", "f", family) for i in range(3)]
    for block in (members[:2], members[2:], members):
        both = [pd.concat([rows(apart, 1 << 20 | band, True, False), rows(block, 1 << 20 | band, False, True)], ignore_index=True) for band in (0, 1)]
        assert [[x for x, _ in linking.links_in(b, 80, 5, np.uint16, s.unpack)] for b in both] == [["x0"], ["x1"]]
        together = pd.concat(both, ignore_index=True)
        together["bucket"] += np.repeat([0, 1 << 20], len(both[0]))
        assert {x for x, _ in linking.links_in(together, 80, 5, np.uint16, s.unpack)} == {"x0", "x1"}


def test_small_blocks(spark, monkeypatch):
    """Buckets of many blocks, of families that are linked, nearly linked and not linked."""
    monkeypatch.setattr(linking, "BLOCK", 3)
    r = np.random.default_rng(11)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(14):
            words = list(base)
            for i in r.choice(60, int(r.integers(0, 14)), replace=False):
                words[i] = f"x{r.integers(1_000_000)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.groups(docs, k=1).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == by_hand(rows, 1)


def test_components(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {n: n % 3 for n in range(203)}


def test_sets_are_held_by_size(monkeypatch):
    monkeypatch.setattr(s, "TOGETHER", 45)
    texts = pd.Series(["a b c", None, "x " * 100, "", "a b", "c d e f " * 5, "g h i"])
    lists = list(s.sets_by_size(texts, 2))
    assert [len(x) for x in lists] == [2, 1, 3, 1]
    for got, t in zip([y for x in lists for y in x], texts, strict=True):
        assert (got == s.shingles(t, 2)).all()
