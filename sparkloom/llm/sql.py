"""DuckDB SQL with the rows of the registered queries, where SQL can say them."""

from __future__ import annotations

from sparkloom.llm.secret_scan import RULES

SQL: dict[str, str] = {}

SQL["op1_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'text:' || text, 'none') || ':mix-1') AS h
  FROM documents),
k AS (
  SELECT *, (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
r AS (
  SELECT *, u / (1 - u) AS odds, floor(sqrt(greatest(size, 1)::DOUBLE))::BIGINT AS m FROM k),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w
  FROM r GROUP BY source),
a AS (SELECT sum(source_size)::DOUBLE AS everything FROM s),
fill(i, level) AS (
  SELECT 0, (SELECT everything FROM a) / (SELECT sum(w) FROM s)
  UNION ALL
  SELECT i + 1, coalesce(((SELECT everything FROM a) - (SELECT sum(3 * source_size) FROM s WHERE w * level > 3 * source_size))
                / (SELECT sum(w) FROM s WHERE w * level <= 3 * source_size), level)
  FROM fill WHERE i < 40),
t AS (
  SELECT source, source_size, least(3.0 * source_size, w * (SELECT max(level) FROM fill)) AS target FROM s),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 3) ELSE 0 END AS copies FROM t),
t3 AS (
  SELECT *, CASE WHEN copies < 3 THEN greatest(target - copies * source_size, 0) ELSE 0 END AS rest FROM t2),
v AS (SELECT source, m, sum(size) AS words FROM r GROUP BY source, m),
v2 AS (
  SELECT v.source, m, (rest - (sum(words) OVER (PARTITION BY v.source ORDER BY m DESC) - words))::DOUBLE
         / nullif(sum(m * words) OVER (PARTITION BY v.source ORDER BY m), 0)::DOUBLE AS c
  FROM v JOIN t3 ON v.source IS NOT DISTINCT FROM t3.source),
v3 AS (SELECT source, arg_max(c, m) AS c FROM v2 WHERE c * m <= 1 GROUP BY source),
p AS (
  SELECT r.doc_id, r.size, r.odds, t3.*, least(coalesce(v3.c, 0) * m, 1.0) AS p
  FROM r JOIN t3 ON r.source IS NOT DISTINCT FROM t3.source LEFT JOIN v3 ON r.source IS NOT DISTINCT FROM v3.source),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN odds / (p / (1 - p)) ELSE 1e300 END AS q FROM p),
o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
g AS (
  SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM o),
c AS (
  SELECT source, arg_min(q, (abs(size - gap), q)) AS closing FROM g
  WHERE upto > rest AND size > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target,
       (g.size * least(g.copies + CASE WHEN g.upto <= g.rest OR g.q = c.closing THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source
"""

SQL["op10_superminhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r(a, b) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id,
       coalesce(min(r.b), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id
GROUP BY d.doc_id, n.n
"""


def _secret_sql() -> str:
    """Places of matches from the lengths of the matches and of what lies between them, one rule at a time."""
    rules = [(i, r, r.pattern.replace("'", "''")) for i, r in enumerate(RULES)]
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS place, '{r.kind}' AS kind, {r.base} AS base, {r.least} AS least,
             regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g,
             string_split_regex(text, '{p}') AS b FROM documents"""
        for i, r, p in rules
    )
    return f"""
WITH f AS ({found}),
e AS (
  SELECT doc_id, place, kind, base, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS b FROM f WHERE len(m) > 0),
p AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
s AS (
  SELECT doc_id, place, kind, base, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span
  FROM p WHERE length(g) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL["op5_secrets"] = _secret_sql()

SQL["op12_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM f
"""

SQL["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT FOR _ IN range(8)]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
p AS (
  SELECT c.conv_id, 0 AS part, t.no, {'role': t.role, 'text': t.text} AS turn FROM c JOIN t ON t.conv_id = c.base AND t.no <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.no, {'role': t.role, 'text': t.text} FROM c JOIN t ON t.conv_id = c.conv_id AND t.no > c.h),
r AS (
  SELECT c.conv_id, coalesce(list(p.turn ORDER BY p.part, p.no) FILTER (p.conv_id IS NOT NULL), []) AS turns
  FROM c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
v AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256, max(n) = any_value(depth) AS leaf
  FROM m GROUP BY depth, turns[1:depth]),
s AS (
  SELECT a.depth, u.path[1:a.depth] AS path, sum((u.n_convs - 1) * CASE WHEN u.depth > 0 THEN length(u.path[u.depth].text) ELSE 0 END)::BIGINT AS saved_tokens,
         sum(u.leaf::BIGINT)::BIGINT AS n_leaves, count(*) FILTER (u.depth = a.depth + 1) AS n_children
  FROM v u, unnest(range(0, u.depth + 1)) AS a(depth) GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, s.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.path = v.path LEFT JOIN v up ON up.depth = v.depth - 1 AND up.path = v.path[1:v.depth - 1]
"""
