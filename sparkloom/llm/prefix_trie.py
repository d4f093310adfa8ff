"""The prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

Every distinct sequence of first turns is a node; the conversations that begin with it are its
members, and its smallest member owns it. Members only become fewer on the way down, so
what a conversation owns is an end of its own path, from some depth on. That makes sums
over subtrees sums over members: each node below is owned by one member, so

    saved tokens  = what the members' turns from this depth on hold, each time it occurs,
                    less what they hold where their conversation owns the node
    leaves        = members that own a childless node
    children      = members that own a node one step below

and one group-by of prefixes, combined before its shuffle, gives them all. The root's
members are all conversations; no task holds the members of a node. Ownership is marked by a
smallest member for each prefix, and then for each owner the first depth that it
owns. Windows run over the turns of a conversation alone, by ``operators.scan``, so a conversation
with most turns is dealt over blocks too.

A prefix goes by its depth and 128 bits: the exclusive or of two hashes of each turn with its
depth, over a 128-bit digest of role and text (Zobrist, 1970), so a running window makes it and
no text leaves the first scan. Sequences that differ agree with a chance of 2**-128 for each pair.

Hot parents (the root, a common first turn) are joined as ``hot_key_join`` does it. The members that
end at a node are hashed in order: sorted by ranges and put into strings of ``CHUNK`` ids in tasks; the
strings of a node then go through one hash in one task, a stream of bytes as SHA-256 needs it.

Defined cases: rows with a null conversation id are left out; a null role or text is empty; a null turn comes
first, turns of equal number are ordered by their digests and repeated rows are turns of their own; an
empty table has no nodes, not even a root; extra columns are ignored, a text's length doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, stored, tasks
from sparkloom.operators import scan
from sparkloom.operators.skew import hot_key_join

#: Conversations are rebuilt on the one whose id is a multiple of this; the digest decides how many of its turns, fewer than ``MOST_SHARED``, they take.
GROUP = 100
MOST_SHARED = 6
#: Ids in a string of members.
CHUNK = 4096

_KEY = ("depth", "p1", "p2")


def _digest(role: Column, text: Column) -> list[Column]:
    """128 bits of SHA-256 over role and text; the role's length keeps the two apart."""
    hashed = F.sha2(F.concat_ws(":", F.length(role), F.concat(role, text)), 256)
    return [F.xxhash64(F.substring(hashed, at, 32), F.lit(at)).alias(n) for at, n in ((1, "d1"), (33, "d2"))]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, d1, d2, tokens) of every row: digests and code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *_digest(role, text), F.char_length(text).cast("long").alias("tokens"))


def _hashes(depth: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth, F.col("d1"), F.col("d2")) for i in (1, 2)]


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, tokens, upto, n_turns) of every rebuilt conversation and each of its prefixes: key of the prefix, tokens of its last turn and of all its turns, the conversation's turns in all.

    Conversation c takes the first h turns of conversation c - c % 100 and goes on with its own after its first h; h is crc32(c) % 6.
    """
    turns = turns_of(conversations)
    first = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "d1", "d2")
    opening = turns.where(F.col("conv_id") % GROUP == 0).withColumn("no", F.row_number().over(first)).where(F.col("no") < MOST_SHARED).withColumn("depth", F.col("no").cast("long"))
    # At most five rows of each: the window's limit is applied before its shuffle.
    upto = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    x1, x2 = _hashes(F.col("depth"))
    opening = opening.select(F.col("conv_id").alias("base"), "depth", F.bit_xor(x1).over(upto).alias("p1"), F.bit_xor(x2).over(upto).alias("p2"), "tokens", F.sum("tokens").over(upto).alias("upto"))
    opening = cut(opening)

    convs = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    shared = opening.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("depth", "p1", "p2", "tokens", "upto"))).alias("shared"))  # five at most
    none = F.array().cast(shared.schema["shared"].dataType)
    convs = convs.join(shared, "base", "left").withColumn("shared", F.filter(F.coalesce("shared", none), lambda t: t["depth"] <= F.col("h")))
    n_shared = F.size("shared").cast("long")
    convs = stored(convs.select("conv_id", "h", "shared", (n_shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"), n_shared.alias("n_shared")))

    at = F.when(F.size("shared") > 0, F.element_at("shared", -1))
    ends = convs.select("conv_id", "h", "n_turns", "n_shared", F.coalesce(at["p1"], F.lit(0)).alias("s1"), F.coalesce(at["p2"], F.lit(0)).alias("s2"), F.coalesce(at["upto"], F.lit(0)).alias("before"))
    own = scan.in_order(turns.join(ends, "conv_id"), ["conv_id"], [F.asc_nulls_first("turn"), "d1", "d2"]).scan(no=scan.count())
    own = own.with_rows(own.rows.withColumn("depth", F.col("no") + F.col("n_shared") - F.col("h")).where("no > h"))
    x1, x2 = _hashes(F.col("depth"))
    own = own.scan(x1=scan.xor(x1), x2=scan.xor(x2), sum=scan.total("tokens")).result()
    own = own.select("conv_id", "depth", F.col("s1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("p2"), "tokens", (F.col("before") + F.col("sum")).alias("upto"), "n_turns")
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("upto")))
    heads = convs.select("conv_id", F.explode(F.concat(root, "shared")).alias("t"), "n_turns").select("conv_id", "t.*", "n_turns")
    return heads.unionByName(own)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, conv_id) rows to strings of ids, with the first of each."""
    key, ids, done = None, [], []

    def close() -> None:
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))

    for pdf in batches:
        for *now, c in pdf.itertuples(index=False):
            if now != key or len(ids) == CHUNK:
                close()
                key, ids = now, []
            ids.append(c)
        yield pd.DataFrame(done, columns=[*_KEY, "first", "ids"])
        done = []
    close()
    yield pd.DataFrame(done, columns=[*_KEY, "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of ids, sorted by key and first id, to one hash for each key."""
    key, h = None, None
    for pdf in batches:
        done = []
        for *now, ids in pdf.itertuples(index=False):
            if now == key:
                h.update(b",")
            else:
                if h:
                    done.append((*key, h.hexdigest()))
                key, h = now, hashlib.sha256()
            h.update(ids.encode())
        yield pd.DataFrame(done, columns=[*_KEY, "ends"])
    if h:
        yield pd.DataFrame([(*key, h.hexdigest())], columns=[*_KEY, "ends"])


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 over the ids of the conversations that end at a node, ascending and joined by commas."""
    n = tasks(rows.sparkSession)
    last = rows.where("depth = n_turns").select(*_KEY, "conv_id")
    chunks = last.repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInPandas(_members, "depth long, p1 long, p2 long, first long, ids string")
    chunks = cut(chunks)
    return chunks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").drop("first").mapInPandas(_hashed, "depth long, p1 long, p2 long, ends string")


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rebuilt conversations; conv_id is the smallest member, and with depth tells nodes apart."""
    return trie(rebuilt_paths(conversations))


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of any paths with the columns of ``rebuilt_paths``."""
    rows = stored(paths)
    # Owners first: the smallest member of each prefix, whether any member goes on, and what lies above it.
    owned = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), (F.max("n_turns") == F.col("depth")).alias("leaf"), F.min(F.col("upto") - F.col("tokens")).alias("above"))
    owned = stored(owned)
    mine = owned.groupBy("owner").agg(F.min(F.struct("depth", "above")).alias("m"), F.max(F.col("leaf").cast("long")).alias("leaf")).select(F.col("owner").alias("conv_id"), F.col("m.depth").alias("since"), F.col("m.above").alias("above"), "leaf")
    all_ = rows.groupBy("conv_id").agg(F.max("upto").alias("all"))
    # A conversation that owns nothing owns from one past its end.
    marks = all_.join(mine, "conv_id", "left").select("conv_id", "since", F.coalesce("above", "all").alias("bound"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = rows.join(marks, "conv_id")
    below = F.col("since").isNull() | (F.col("depth") < F.col("since"))
    child = F.col("since").isNotNull() & (F.col("since") <= F.col("depth") + 1) & (F.col("depth") < F.col("n_turns"))
    out = marked.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(below, F.col("bound") - (F.col("upto") - F.col("tokens"))).otherwise(0)).alias("saved_tokens"),
    )
    # A node's parent is its owner's too, but for the first node that a conversation owns.
    above = stored(marked.where(F.col("depth") == F.col("since") - 1).select("conv_id", "since", *_KEY))
    parents = hot_key_join(above, owned.select(*_KEY, F.col("owner").alias("parent")), _KEY).select("conv_id", F.col("since").alias("depth"), "parent")
    out = out.join(_ends(rows), list(_KEY), "left").join(parents, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
