"""Secrets in texts, found through a trigram inverted index. DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived (after Cox, 2012): the
pattern is unfolded into alternatives of literal runs and gaps, and a text that matches
must hold all trigrams of the runs of one alternative. The index has, for every trigram
that some rule asks for, the documents in whose lower-cased text it stands. Postings are
intersected by joining them with the queries and comparing, for each document and
alternative, the set of trigrams met with the set needed. Documents that pass are verified
with the rule's own pattern; rules with an alternative without a trigram scan all
documents.

Matches are leftmost and non-overlapping for each rule. Their places come from the lengths
of the matches and of what lies between them, summed by a window over the matches of one
document and rule. ``least`` is the length that a match (or its ``group``) must have; what
fails is dropped after matching.

Defined cases: a null text counts as empty; rows that agree in id and text are verified
once and reported alike; empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import small, stored

#: Alternatives into which a pattern is unfolded at most; beyond that a part counts as a gap.
MOST_ALTERNATIVES = 64
#: Members up to which a character class is unfolded.
MOST_MEMBERS = 5
_GAP = "\0"
#: Trigrams of an alternative that share a number.
BITS = 60


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` (0: the whole match) must have at least ``least`` characters.

    ``look`` is for rules that scan all texts: what a text with a match that is long enough holds.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    look: str | None = None


_CHARS = r"[A-Za-z0-9+/_.=-]"
BASE_RULES = (
    Rule("assign", rf"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_CHARS}+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, r"[0-9a-f]{32}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("login", r"[A-Za-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def _members(items: list) -> list[str] | None:
    """The characters of a class, or None if they are many."""
    out: list[str] = []
    for op, v in items:
        if op is C.LITERAL:
            out.append(chr(v))
        elif op is C.RANGE and v[1] - v[0] < MOST_MEMBERS:
            out += map(chr, range(v[0], v[1] + 1))
        else:
            return None
        if len(out) > MOST_MEMBERS:
            return None
    return out


def _unfold(parts) -> list[str]:
    """The strings, with gaps, one of which any match has the shape of."""
    shapes = [""]
    for op, v in parts:
        if op is C.LITERAL:
            own = [chr(v)]
        elif op is C.IN:
            own = _members(v) or [_GAP]
        elif op is C.SUBPATTERN:
            own = _unfold(v[3])
        elif op is C.BRANCH:
            own = [s for branch in v[1] for s in _unfold(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = v
            once = _unfold(body)
            if (low, high) == (0, 1):
                own = ["", *once]
            elif low == high and len(once) ** low <= MOST_MEMBERS:
                own = [""]
                for _ in range(low):
                    own = [a + b for a in own for b in once]
            else:
                own = [f"{s}{_GAP}" for s in once] if low else [_GAP]
        elif op is C.AT:
            own = [""]
        else:
            own = [_GAP]
        if len(shapes) * len(own) > MOST_ALTERNATIVES:
            own = [_GAP]
        shapes = [a + b for a in shapes for b in own]
    return shapes


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-cased trigrams, one of which a matching text has whole; None if a match needs no trigram."""
    sets = set()
    for shape in _unfold(_parser.parse(pattern)):
        runs = [r.lower() for r in shape.split(_GAP)]
        sets.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("h"), body.alias("t"))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The postings: (trigram, id, h) for each trigram that a rule asks for; h is a hash of the text."""
    wanted = sorted({t for r in rules for s in trigram_query(r.pattern) or () for t in s})
    rows = _rows(docs, text, key).withColumn("low", F.lower("t"))
    met = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return rows.select("id", "h", F.explode(met).alias("trigram")).select("trigram", "id", "h")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, h, kinds) of the documents that pass the query of some rule, by intersecting postings."""
    asked = []
    for r in rules:
        for n, s in enumerate(trigram_query(r.pattern) or ()):
            # Trigrams of an alternative are bits of as many words as they need.
            words = [sorted(s)[i : i + BITS] for i in range(0, len(s), BITS)]
            for w, own in enumerate(words):
                asked += [F.struct(F.lit(t).alias("asked"), F.lit(r.kind).alias("kind"), F.lit(n).alias("n"), F.lit(w).alias("word"), F.lit(len(words)).alias("words"), F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(own)) - 1).cast("long").alias("all")) for i, t in enumerate(own)]
    queries = postings.sparkSession.range(1).select(F.inline(F.array(*asked)))
    met = postings.join(F.broadcast(queries), F.col("trigram") == F.col("asked"))  # a row for each trigram of a rule
    passed = met.groupBy("id", "h", "kind", "n", "word", "words", "all").agg(F.bit_or("bit").alias("met")).where(F.col("met") == F.col("all"))
    passed = passed.groupBy("id", "h", "kind", "n", "words").agg(F.count(F.lit(1)).alias("whole")).where(F.col("whole") == F.col("words"))
    return passed.groupBy("id", "h").agg(F.collect_set("kind").alias("kinds"))


def _matches(r: Rule, text: Column) -> Column:
    """For each match of a rule: its number, the characters since the last one, its own, and whether it is long enough."""
    rx = F.lit(r.pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    judged = F.regexp_extract_all(text, rx, F.lit(r.group)) if r.group else found
    between = F.slice(F.split(text, r.pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(between.alias("a"), found.alias("b"), judged.alias("c"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(r.kind).alias("kind"), i.alias("i"), F.char_length(x["a"]).alias("gap"), F.char_length(x["b"]).alias("own"), (F.char_length(x["c"]) >= r.least).alias("ok")))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", postings: DataFrame | None = None) -> DataFrame:
    """(id, h, kind, start, end) of every secret, in code points, end exclusive; ``postings`` is an index built before over the same documents and rules."""
    rows = _rows(docs, text, key)
    postings = stored(index(docs, rules, text, key)) if postings is None else postings
    few = small(candidates(postings, rules).withColumnsRenamed({"id": "cid", "h": "ch"}))
    rows = rows.join(few, F.col("id").eqNullSafe(F.col("cid")) & (F.col("h") == F.col("ch")), "left").select("id", "h", "t", "kinds")

    def due(r: Rule) -> Column:
        if trigram_query(r.pattern) is not None:
            return F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        return F.col("t").rlike(r.look or r.pattern)

    rows = rows.withColumn("due", F.array_compact(F.array(*[F.when(due(r), F.lit(r.kind)) for r in rules]))).where(F.size("due") > 0)
    rows = rows.dropDuplicates(["id", "h"])
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,own:int,ok:boolean>>")
    each = [F.when(F.array_contains("due", r.kind), _matches(r, F.col("t"))).otherwise(none) for r in rules]
    found = rows.select("id", "h", F.inline(F.concat(*each)))
    upto = W.partitionBy("id", "h", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = (F.sum("gap").over(upto) + F.sum("own").over(upto)).cast("long")
    return found.withColumn("end", end).where("ok").select("id", "h", "kind", (F.col("end") - F.col("own")).alias("start"), "end")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, n_<kind> of the base rules, base_sha256 over their spans, and all spans as kind:start:end."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = [r.kind for r in rules if r.base]
    one = F.struct("start", order[F.col("kind")].alias("at"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.array_sort(c)["s"], ",")
    digest = lambda c: F.sha2(c, 256)
    per = spans(docs, rules, text, key).groupBy("id", "h").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        digest(joined(F.collect_list(F.when(F.col("kind").isin(base), one)))).alias("base"),
        joined(F.collect_list(one)).alias("spans"),
    )
    per = small(per.withColumnsRenamed({"id": "pid", "h": "ph"}), size=F.octet_length("spans"))
    rows = _rows(docs, text, key).select("id", "h")
    out = rows.join(per, F.col("id").eqNullSafe(F.col("pid")) & (F.col("h") == F.col("ph")), "left")
    return out.select(
        F.col("id").alias(key), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.coalesce("base", digest(F.lit(""))).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
