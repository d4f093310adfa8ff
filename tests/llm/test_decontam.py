from collections import Counter

import numpy as np

from sparkloom.llm import decontam

ITEMS = [
    (1, "What colour has the sky on a clear day over the northern hills? It is a deep and shining blue."),
    (2, "Name the river that flows through the old harbour town of the east. The river Amber flows there."),
    (2, "Name the river that flows through the old harbour town of the east. The river Amber flows there."),
    (3, None),
    (4, ""),
    (None, "An item without an id is left out of the index altogether here."),
]
FILLER = " ".join(f"filler{i % 53} the and of" for i in range(150))
DOCS = [
    (1, f"{FILLER} what colour has the sky on a clear day over the northern hills it is a deep and shining blue {FILLER}"),
    (2, f"{FILLER} What colour has the sky on a clear day over the northern hills? It is raining. {FILLER}"),
    (3, f"{ITEMS[1][1].upper()}"),
    (3, f"{ITEMS[1][1].upper()}"),
    (4, None),
    (5, ""),
    (6, f"An item without an id is left out of the index altogether here. {FILLER}"),
    (7, " ".join(sorted(decontam.words_of(ITEMS[0][1])))),
    (None, ITEMS[0][1]),
    (8, f"Name a river that flows through the old harbour town of the east! The river Amber flows there. {FILLER}"),
]


def test_report(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    for shard in (1024, 1):
        got = {(r.doc_id, r.item_id) for r in decontam.report(docs, items, shard_items=shard).collect()}
        assert got == {(1, 1), (3, 2), (None, 1), (8, 2)}
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 5, 6, 7])
    assert decontam.report(docs, items.where("false")).count() == 0
    assert decontam.report(docs.where("false"), items).count() == 0


def test_all_above_the_threshold_are_retrieved(spark, sf_dir):
    """WAND with block maxima against scoring every item for every passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    share = 0.15
    index = decontam.build(items, share=share).toPandas()
    s = decontam.shard_of(index[index["shard"] == 0])
    docs = [np.array([s.terms.get(w, -1) for w in decontam.words_of(r.text)]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect()]
    got = sorted((int(d), item, len(p)) for d, item, _, p in s.found_in(docs))
    want = []
    for d, words in enumerate(docs):
        for at in range(0, max(1, -(-(len(words) - 3 * s.stride // 2) // s.stride))):
            passage = words[at * s.stride : at * s.stride + 5 * s.stride // 2]
            score = Counter()
            for t in set(passage.tolist()) - {-1}:
                for p in range(s.start[t], s.start[t + 1]):
                    score[s.items[p]] += s.impacts[p]
            want += [(d, item, len(passage)) for item, x in score.items() if x >= 1]
    assert got == sorted(want) and len(want) > 20


def test_items_in_a_long_document(spark, monkeypatch):
    """An item at every place of a document that is worked on in parts; passages of parts are those of the whole."""
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 100)
    monkeypatch.setattr(decontam, "LONG_TEXT", 1000)
    index = decontam.build(spark.createDataFrame(ITEMS[:2], "item_id long, text string")).toPandas()
    s = decontam.shard_of(index)
    for words in (0, 1, s.stride, s.stride + 1, 2 * s.stride, 99, 100, 101, 117, 118, 119, 333):
        text = " ".join(["the"] * words)
        parts = s.parts(text)
        step = 100 // s.stride * s.stride
        assert all(len(p) <= step + 3 * s.stride // 2 for p in parts) and max(i * step + len(p) for i, p in enumerate(parts)) == words
    for at in range(0, 260, 7):
        words = ["filler"] * at + decontam.words_of(ITEMS[0][1]) + ["filler"] * (300 - at)
        found = [(item, s.verified(item, p)) for _, item, _, p in s.found_in(s.parts(" ".join(words)))]
        assert any(s.ids[item] == 1 and min(v) == 1 for item, v in found), at


def test_a_stretched_item_is_found_wherever_it_lies(spark):
    """60 words in order with one more after every second: as long as a window may be, at every offset."""
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, f"{' '.join(words[:45])}. {' '.join(words[45:])}."), (2, " ".join(f"v{i}" for i in range(21)) + ". v0 v1 v2 v3 v4.")], "item_id long, text string")
    stretched = [x for i, w in enumerate(words) for x in ([w, "more"] if i % 2 else [w])]
    docs = spark.createDataFrame([(at, " ".join(["filler"] * at + stretched + ["filler"] * 200)) for at in range(131)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.report(docs, items).collect()} == {(at, 1) for at in range(131)}


def test_rounds(spark, sf_dir, monkeypatch):
    """Shards in many rounds find what one finds."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontam.report(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontam, "ROUND_BYTES", 1)
    assert sorted(map(tuple, decontam.report(docs, items, shard_items=15).select("doc_id", "item_id").collect())) == one and len(one) >= 3


def test_short_answers():
    q, a = decontam.question_and_answer("Which of these rivers is the longest one? It is a river in the east. Amber.")
    assert a == ["it", "is", "a", "river", "in", "the", "east", "amber"] and q[-1] == "one"
    q, a = decontam.question_and_answer("One two three. Four.")
    assert (q, a) == (["one", "two", "three"], ["four"])
    assert decontam.question_and_answer("") == ([], [])


def test_in_order():
    assert decontam.in_order([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 0.75
    assert decontam.in_order([], [1]) == 1.0
    assert decontam.in_order([1, 1, 2], [1, 2, 1]) == 2 / 3


def test_items_behind_denser_text(spark):
    """Repeats of the question, or of one of its words, before an item hide nothing; all windows against brute force."""
    words = [f"w{i}" for i in range(33)]
    question, answer = " ".join(words[:25]), " ".join(words[25:])
    longest = " ".join(f"v{i}" for i in range(59))
    items = spark.createDataFrame([(1, f"{question}. {answer}."), (2, f"{longest}. v0 end.")], "item_id long, text string")
    texts = [f"{question} {question} {question} {answer}", f"{'w3 ' * 60}{question} {answer}", f"{question} {question} {question}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.report(docs, items).collect()} == {(0, 1), (1, 1)}

    index = decontam.build(items).toPandas()
    s = decontam.shard_of(index)
    r = np.random.default_rng(3)
    q, a = s.questions[0], s.answers[0]
    passed = 0
    for _ in range(200):
        copy = np.array(q + a)[np.sort(r.choice(33, int(r.integers(27, 34)), replace=False))]
        passage = np.concatenate([r.choice(q, int(r.integers(0, 60))), copy, r.integers(-1, len(s.terms), int(r.integers(0, 40)))])
        width = min(len(passage), 3 * 33 // 2)
        parts = [passage[at : at + width].tolist() for at in range(len(passage) - width + 1)]
        want = any(min(decontam.in_order(q, p), decontam.in_order(a, p)) >= 0.8 for p in parts)
        assert (min(s.verified(0, passage)) >= 0.8) == want
        passed += want
    assert passed > 50
