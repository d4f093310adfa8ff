"""The trie against one built in memory, on odd rows and with hot keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sparkloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 string, tokens string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in turns.items()}
    paths = {c: own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + ts[h:] for c, ts in own.items()}
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.add((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n for m in members if m) for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node)).encode()).hexdigest(),
        ))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.nodes(df).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len({(r.conv_id, r.depth) for r in got})


@pytest.mark.parametrize("chunk", [4096, 3])
def test_random(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    r = random.Random(chunk)
    ids = [*range(-3, 40), *range(100, 120), *r.sample(range(250, 10**6), 30), 2**62, -(2**40)]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", "", None, "\U0001f600 x"])) for c in ids for t in range(r.randrange(1, 8))]
    check(spark, rows)


def test_odd_rows(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(500, 560) for t in range(4)]
    long_ = [(7, t, "user", "x" * (t % 3)) for t in range(300)]
    check(spark, same + long_ + [(8, None, None, None), (8, 3, "user", "a"), (8, 3, "user", "a"), (None, 1, "user", "a"), (61, 1, "user", "only"), (900, 0, "u", "")])
    # A role and a text aren't one string.
    check(spark, [(1000, 0, "ab", "c"), (1001, 0, "a", "bc"), (1002, 0, "ab", "c")])


def test_empty(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
