"""DuckDB SQL for corpus queries that is longer than a few lines."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs with a common shingle, and the components of those that link.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


def fingerprint_sql(exact: int = 8, shifts: int = 30) -> str:
    """Fingerprints of every text and its edited text, sums over lines and clauses."""
    packed = [f"p{h}_{s}" for h in range(2) for s in range(shifts)]
    e_sums = ", ".join(f"sum(('0x' || substr(d, {1 + 7 * k}, 7))::BIGINT) FILTER (whole)::BIGINT AS e{k}" for k in range(exact))
    p_sums = ", ".join(f"coalesce(sum((('0x' || substr(d, {1 + 16 * h}, 15))::BIGINT >> {s}) & 1073741825) FILTER (NOT whole), 0)::BIGINT AS p{h}_{s}" for h in range(2) for s in range(shifts))
    hexes = " || ".join([f"printf('%08x', e{k} % 4294967296)" for k in range(exact)] + [f"printf('%08x', (({c} & 65535) * 65536) + (({c} >> 30) & 65535))" for c in packed] + ["printf('%08x', clauses % 4294967296)"])
    # Lanes in the order of the operator: all low ones, then all high ones.
    lanes = "[" + ", ".join([f"({c} & 65535)" for c in packed] + [f"(({c} >> 30) & 65535)" for c in packed]) + "]"
    like = lambda a, b: f"CASE WHEN {a}.fp = {b}.fp AND {a}.v = {b}.v THEN 1.0 WHEN {a}.sq = 0 OR {b}.sq = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, list_sum([{a}.v[i] * {b}.v[i] for i in range(1, {4 * shifts + 1})])::DOUBLE / (sqrt({a}.sq::DOUBLE) * sqrt({b}.sq::DOUBLE)))) END"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id,
    coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next FROM documents WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) AS edited FROM t),
b AS (SELECT doc_id, false AS is_edit, text AS s FROM x UNION ALL SELECT doc_id, true, edited FROM x),
u AS (SELECT doc_id, is_edit, true AS whole, unnest(string_split(s, chr(10))) AS s FROM b UNION ALL SELECT doc_id, is_edit, false, unnest(regexp_split_to_array(s, '[.!?,;:\n]+[ \t\n\x0B\f\r]*')) FROM b),
h AS (SELECT doc_id, is_edit, whole, rpad(CASE WHEN whole THEN sha256(s) ELSE md5(s) END, 64, '0') AS d FROM u WHERE whole OR s <> ''),
f AS (SELECT doc_id, is_edit, {e_sums}, {p_sums}, count(*) FILTER (NOT whole) AS clauses FROM h GROUP BY doc_id, is_edit),
g AS (SELECT doc_id, is_edit, {hexes} AS fp, [((2 * k - clauses + 65536) % 131072 + 131072) % 131072 - 65536 for k in {lanes}] AS v FROM f),
q AS (SELECT *, list_sum([k * k for k in v]) AS sq FROM g)
SELECT x.doc_id, length(x.text)::BIGINT AS n_chars, sha256(x.edited) AS edited_sha256, o.fp AS fingerprint, e.fp AS edited_fingerprint,
    {like('o', 'e')} AS near_edited, {like('o', 'p')} AS near_next
FROM x JOIN q o ON o.doc_id = x.doc_id AND NOT o.is_edit JOIN q e ON e.doc_id = x.doc_id AND e.is_edit JOIN q p ON p.doc_id = x.next_id AND NOT p.is_edit
"""


#: All strings of 50 bytes as hexadecimal text, and what stands in smaller documents cut out.
DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS d FROM p GROUP BY s),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p JOIN m USING (s) WHERE d < doc_id),
g AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM r
    UNION ALL SELECT b.doc_id, coalesce(l.e, 0), n FROM b LEFT JOIN (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) l ON l.doc_id = b.doc_id),
z AS (SELECT k.doc_id, sha256(unhex(string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f))) AS h FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY k.doc_id),
y AS (SELECT doc_id, sum(e - a) AS q, count(*) AS w FROM r GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(q, 0)::BIGINT AS n_removed, coalesce(w, 0)::BIGINT AS n_spans, h AS kept_sha256 FROM b JOIN z ON z.doc_id = b.doc_id LEFT JOIN y ON y.doc_id = b.doc_id
"""
