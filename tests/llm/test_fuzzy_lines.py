from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import fuzzy_lines as f

BASE = "a line of some length that says the same thing over and over again in other words"
TEXTS = [
    f"{BASE}\nshort\n\nunlike all else here, really",
    f"{BASE.upper()}  \nshort\n\n{BASE.replace('thing', 'think')}",
    f"ab\nabc\n{BASE.replace('over again', 'once more, twice more and thrice')}",
    f"{BASE.replace('some', 'sume')}",
    None,
    "",
]


def by_hand(texts):
    """The numbers of the lines that go, by comparing all pairs."""
    lines = [(i, no, f.normal(x)) for i, t in enumerate(texts) if t is not None for no, x in enumerate(t.split("\n")) if f.normal(x)]
    sets = [frozenset(x[i : i + f.K] for i in range(max(1, len(x) - f.K + 1))) for _, _, x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    gone = [[] for _ in texts]
    for i, (d, no, _) in enumerate(lines):
        if find(i) != i:
            gone[d].append(no)
    return [",".join(map(str, g)) for g in gone]


def test_against_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in f.report(docs).collect()}
    assert [got[i].dropped for i in range(len(TEXTS))] == by_hand(TEXTS)
    texts = {r.doc_id: (r.text, r.lines_dropped) for r in f.deduplicated(docs).collect()}
    assert texts[0] == (TEXTS[0], 0) and texts[4] == (None, 0) and texts[5] == ("", 0)
    assert texts[1] == ("", 3) and texts[3] == ("", 1)


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120)
    texts = [r.text for r in rows.collect()]
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    got = {r.doc_id: r.dropped for r in f.report(rows).collect()}
    assert [got[i] for i in ids] == by_hand(texts)


def test_odd_rows(odd, none):
    got = f.report(odd).collect()
    assert len(got) == odd.count()
    kept = Counter((r.doc_id, r.n_lines, r.n_kept) for r in got)
    assert kept[1, 1, 1] == 1 and kept[2, 1, 0] == 2 and kept[None, 1, 0] == 1 and kept[4, 0, 0] == 1
    assert f.deduplicated(odd).columns == [*odd.columns, "lines_dropped"]
    assert f.report(none).count() == 0 and f.deduplicated(none).count() == 0


def test_band_buckets(spark):
    """Buckets over several tasks against grouping: one of a third of all lines, repeated lines, buckets of two and of one."""
    rng = np.random.default_rng(5)
    rows = []
    for node in rng.integers(-(1 << 62), 1 << 62, 600).tolist():
        sig = rng.integers(0, 256, f.PLACES, dtype=np.uint8)
        if rng.random() < 0.35:
            sig[: f.BAND] = 7
        sig[f.BAND : 2 * f.BAND] = rng.integers(0, 250)
        rows += [(node, sig.tobytes(), 40)] * int(rng.integers(1, 4))
    rows += [(1, rows[0][1], 2), (2, None, 40)]
    lines = spark.createDataFrame(rows, "a long, sig binary, n int").repartition(7)
    met = defaultdict(set)
    for node, sig, n in rows:
        if sig and n >= 4:
            for b in f.band_numbers(np.frombuffer(sig, np.uint8).reshape(1, -1))[0].tolist():
                met[b].add(node)
    got = f.band_buckets(lines, 4).collect()
    assert sorted((r.bucket, r.a, r.b) for r in got if r.pair) == sorted((b, *sorted(m)) for b, m in met.items() if len(m) == 2)
    found = defaultdict(set)
    for r in got:
        if not r.pair:
            assert r.a <= r.b and r.a in met[r.bucket]
            found[r.bucket].add(r.b)
    assert found == {b: m for b, m in met.items() if len(m) > 2}
    assert max(map(len, found.values())) > 150
    # Each node but the smallest hangs on a smaller one, and so all of a bucket on its smallest.
    hung = {(r.bucket, r.b) for r in got if not r.pair and r.a < r.b}
    assert all((b, n) in hung for b, m in found.items() for n in m if n != min(m))


def test_long_lines_are_hashed_in_parts(monkeypatch):
    """A line hashed in parts has the signature, the number of shingles and the set that it has as a whole."""
    r = np.random.default_rng(3)
    lines = ["".join(r.choice(list("abcde "), n)) for n in (3, 5, 64, 63, 65, 68, 69, 70, 500, 129, 1, 128)]
    whole, counts = f.signatures(lines)
    sets = [f.line_set(x) for x in lines]
    monkeypatch.setattr(f, "CHUNK", 64)
    parts, again = f.signatures(lines)
    assert (parts == whole).all() and (again == counts).all()
    assert all((f.line_set(x) == y).all() for x, y in zip(lines, sets, strict=True))


def test_report_reads_the_documents_once(spark, tmp_path):
    """What the stored lines have is enough; documents without lines, rows of the same id and text, and null ids each keep their row."""
    line = "a line of some length that stands in two of the documents"
    rows = [(1, line), (2, f"{line}\n\nanother one"), (2, f"{line}\n\nanother one"), (3, None), (3, None), (4, ""), (5, " \n\t"), (None, line), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs_once")
    found = f.report(spark.read.parquet(f"{tmp_path}/docs_once"))
    assert not any("docs_once" in x for x in found.inputFiles())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_kept, r.dropped) for r in found.collect())
    assert got == [(-1, 0, 0, ""), (-1, 1, 0, "0"), (1, 1, 1, ""), (2, 2, 1, "0"), (2, 2, 1, "0"), (3, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, "")]


def test_keys_that_meet():
    """Against plain code: sizes of buckets up to three, and the rows of the larger ones."""
    rng = np.random.default_rng(5)
    key = np.concatenate([rng.integers(0, 300, 400), rng.integers(1000, 1400, 300)])
    low = rng.integers(0, 4, 700)
    high = low + rng.integers(0, 2, 700)
    count = np.where(low == high, 1, rng.integers(2, 4, 700)).astype(np.int32)
    keys, least, most, found, rows, own = f._met(key, low, high, count)
    assert keys.tolist() == sorted(set(key.tolist()))
    for k, a, z, n in zip(keys, least, most, found, strict=True):
        here = key == k
        nodes = {*low[here].tolist(), *high[here].tolist()}
        assert (a, z) == (min(nodes), max(nodes))
        assert n == (3 if len(nodes) > 2 or (count[here] > 2).any() else len(nodes))
    assert sorted(rows.tolist()) == np.flatnonzero(np.isin(key, keys[found > 2])).tolist() and (keys[own] == key[rows]).all()


def test_sets_of_lines():
    for line in ("", "ab", "abcde", "a line, a line, a line of some words", "\U0001f600" * 9, "x" * 70_000 + "y"):
        assert f.line_set(line).tolist() == np.unique(f.shingle_hashes([line, "other"])[0][: len(f.shingle_hashes([line])[0])]).tolist()
