"""DuckDB SQL for corpus queries that SQL can express: plain formulations, for small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


JACCARD = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM d, range(1, 100000) t(i) WHERE i <= greatest(len(w) - 2, least(len(w), 1))),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT DISTINCT u AS node, u AS least FROM l UNION SELECT l.v, c.least FROM c JOIN l ON l.u = c.node WHERE c.least < l.v),
m AS (SELECT node, min(least) AS least FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.node = d.doc_id"""

TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{TERMS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered("coalesce(text, '')")}, '{TERMS}') AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x FROM b, range(1, 100000) t(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 10) + 1),
z AS (SELECT DISTINCT k FROM k),
p AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM d, z, range(1, 100000) t(i) WHERE i <= len(w) - k + 1),
o AS (SELECT DISTINCT r, i, k, item FROM p JOIN k USING (k, x)),
h AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM o) GROUP BY r),
m AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)"""

RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, source IS NULL AS nohost, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n, regexp_replace(array_to_string(regexp_extract_all({lowered('line')}, '{WORD}'), ' '), '[0-9]', '0', 'g') AS norm FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM d)),
y AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l WHERE n > 0 GROUP BY r),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM d, range(1, 100000) t(i) WHERE i <= len(w) - 2),
q AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM g WHERE c > 1) GROUP BY r),
k AS (SELECT host, nohost, norm FROM l JOIN d USING (r) WHERE n > 0 GROUP BY ALL HAVING count(DISTINCT x) > 10),
v AS (SELECT r, sum(n) AS n FROM l JOIN d USING (r) JOIN k USING (host, nohost, norm) WHERE l.n > 0 GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(y.dup, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, CAST(coalesce(v.n, 0) AS BIGINT) AS n_removed FROM d LEFT JOIN y USING (r) LEFT JOIN q USING (r) LEFT JOIN v USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept, n_removed FROM f"""


def matches(kind: str, rank: int, pattern: str, keep: str, table: str = "d") -> str:
    """(r, kind, rank, a, z) of a pattern's leftmost matches ``m`` that pass ``keep``.

    What lies between the matches, and the matches themselves, give the positions by their lengths.
    """
    p = pattern.replace("'", "''")
    return rf"""SELECT r, '{kind}' AS kind, {rank} AS rank, a, a + len(m) AS z FROM (SELECT r, m[i] AS m, coalesce(list_sum(list_transform(g[1:i], lambda s: len(s))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: len(s))), 0) AS a
 FROM (SELECT r, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM {table}) q, range(1, 100000) t(i) WHERE i <= len(m)) WHERE {keep}"""


def spans_sql(prefix: str, kinds: list[tuple[str, str, str]]) -> str:
    union = "\nUNION ALL ".join(matches(k, i, p, keep) for i, (k, p, keep) in enumerate(kinds))
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS {prefix}{k}" for k, _, _ in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), s AS ({union})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank), '')) AS base_sha256 FROM d LEFT JOIN s USING (r) GROUP BY r"""


ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
SECRETS = spans_sql("n_", [
    ("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", f"len(regexp_replace(m, '^{ASSIGN.replace(chr(39), chr(39) * 2)}', '')) >= 8"),
    ("access", r"AKIA[A-Z0-9]+", "len(m) >= 16"), ("hex", r"[0-9a-f]+", "len(m) >= 32"),
])
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
DOUBLED = "lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END"
PERSONAL = spans_sql("n_", [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{OCTET}(?:\.{OCTET}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(list_reverse(string_split({DIGITS}, '')), {DOUBLED})) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 10 AND 15"),
])


def crc32(text: str) -> str:
    """crc32 of a string of ASCII signs: each sign, then eight steps of one bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda s: list_prepend(CAST(ascii(s) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))"
    step = "CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda x, y: {step}), 4294967295)"


KEY = "substr(sha256(length(role) || ':' || role || text), 1, 32)"
TRIE = rf"""WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, {KEY}) AS i, {KEY} AS k, strlen(text) AS size FROM t),
h AS (SELECT c, c - c % 5 AS base, {crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
r AS (SELECT h.c, i AS d, k, size FROM h JOIN p ON p.c = base AND i <= h UNION ALL
 SELECT h.c, i - h + least(h, coalesce(n.n, 0)), k, size FROM h JOIN p ON p.c = h.c AND i > h LEFT JOIN n ON n.c = base),
x AS (SELECT c, CAST(0 AS BIGINT) AS d, '' AS path, CAST(0 AS BIGINT) AS size FROM h UNION ALL SELECT r.c, r.d, sha256(path || k), r.size FROM x JOIN r ON r.c = x.c AND r.d = x.d + 1),
z AS (SELECT x.*, lag(path) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM x),
g AS (SELECT d, path, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * max(size) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ended FROM z GROUP BY d, path),
k AS (SELECT g.d, g.path, count(y.path) AS n FROM g LEFT JOIN g y ON y.d = g.d + 1 AND y.up = g.path GROUP BY ALL),
s AS (SELECT v.d, v.path, sum(u.w) AS saved, count(*) FILTER (k.n = 0) AS leaves FROM g v JOIN z ON z.d = v.d AND z.path = v.path JOIN g u ON u.c = z.c AND u.d >= v.d JOIN k ON k.d = u.d AND k.path = u.path GROUP BY ALL)
SELECT g.c AS conv_id, g.d AS depth, o.c AS parent_conv_id, g.n AS n_convs, k.n AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ended AS ends_sha256
 FROM g JOIN k USING (d, path) JOIN s USING (d, path) LEFT JOIN g o ON o.d = g.d - 1 AND o.path = g.up"""

SIGN = r"[^\x20\x09-\x0D]"
#: State of a whole prefix: 1 nothing, 2 after s, 3 after u, 4 after a; (from, edits, to, keeps, reroles) of one row, inserted rows before it included.
ARCS = "(1,'',2,'s',0),(1,'',3,'u',0),(1,'I',4,'a',0),(2,'',3,'u',0),(2,'I',4,'a',0),(3,'',4,'a',0),(3,'I',3,'u',0),(4,'',3,'u',0),(4,'I',4,'a',0),(1,'',3,'*',1),(1,'I',4,'*',1),(2,'',3,'*',1),(2,'I',4,'*',1),(3,'',4,'*',1),(3,'I',3,'*',1),(4,'',3,'*',1),(4,'I',4,'*',1)"
REPAIR = rf"""WITH RECURSIVE a(f, ins, t, role, r) AS (VALUES {ARCS}),
o AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
f AS (SELECT *, {crc32("id")} % 20 AS z FROM o),
m AS (SELECT c, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN z = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE z <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, {KEY}) AS i FROM m),
q AS (SELECT *, substr(role, 1, 1) AS s, NOT regexp_matches(text, '{SIGN}') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '({SIGN})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS prior FROM p),
l AS (SELECT *, blank OR again AS gone, CAST(cut AND NOT blank AND NOT again AS BIGINT) AS late FROM q),
e AS (SELECT c, i, f, t, 2 * length(ins) + 2 * r + late AS cost, ins || CASE WHEN r = 1 THEN 'R' ELSE 'K' END AS audit FROM l JOIN a ON NOT gone AND (a.role = s OR r = 1)
 UNION ALL SELECT c, i, x, x, 3, 'D' FROM l, (VALUES (1), (2), (3), (4)) v(x)),
b AS (SELECT c, CAST(0 AS BIGINT) AS i, 1 AS t, CAST(0 AS BIGINT) AS cost, '' AS audit FROM o GROUP BY c UNION ALL
 SELECT c, i, t, (w).cost, (w).audit FROM (SELECT e.c, e.i, e.t, min({{'cost': b.cost + e.cost, 'audit': b.audit || e.audit}}) AS w FROM b JOIN e ON e.c = b.c AND e.i = b.i + 1 AND e.f = b.t GROUP BY e.c, e.i, e.t)),
n AS (SELECT c, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(late) AS truncated,
 count(*) FILTER (prior || s NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY c),
d AS (SELECT b.c, min({{'cost': cost + CASE t WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END, 'audit': audit || CASE t WHEN 2 THEN 'II' WHEN 3 THEN 'I' ELSE '' END}}) AS w FROM b LEFT JOIN n USING (c) WHERE b.i = coalesce(n.n, 0) GROUP BY b.c),
u AS (SELECT c, (w).audit AS audit, j, substr((w).audit, j, 1) AS x FROM d, range(1, 100000) g(j) WHERE j <= length((w).audit)),
y AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY c ORDER BY j) AS i FROM u),
k AS (SELECT y.c, y.j, y.x, l.role, CASE WHEN y.x = 'I' THEN '' ELSE l.text END AS text, row_number() OVER (PARTITION BY y.c ORDER BY y.j) - max(CASE WHEN y.x = 'K' AND l.s = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.c) AS place FROM y LEFT JOIN l ON l.c = y.c AND l.i = y.i WHERE y.x <> 'D'),
v AS (SELECT c, string_agg(CASE WHEN x = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS said FROM k GROUP BY c)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, (w).cost AS cost, (w).audit AS audit, sha256(coalesce(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id, c FROM o) o JOIN d USING (c) LEFT JOIN n USING (c) LEFT JOIN v USING (c)"""
