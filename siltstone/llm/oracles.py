"""SQL for the queries that it can express, on the tables as DuckDB views."""

from __future__ import annotations

from siltstone.llm import linededup

OP1 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?turn')) AS body,
  length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '</?turn')) + len(regexp_extract_all(role, '[>\n]')) AS head FROM r)
SELECT conv_id, 'rows' AS layout, left(sha256('turns[].role' || chr(10) || 'turns[].text'), 16) AS fingerprint, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  sum(body + head + length('<turn >') + length('</turn>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("id", r"""((?i:user_?name|user_?id|client_?id|access_?key_?id|account|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", 0, 0),
    ("key", r"[A-Za-z0-9+/]+", 0, 32),
    ("endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, 0),
]


def _found(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches with their positions: the pieces between them and the matches alternate."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) - length(m) AS s, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) AS e, length(v) >= {least} AS long, m
  FROM (SELECT doc_id, unnest(string_split_regex(text, {p})[1:len(regexp_extract_all(text, {p}))]) AS g, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v, unnest(range(len(regexp_extract_all(text, {p})))) AS n FROM d)"""


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(_found(i, *k) for i, k in enumerate(_KINDS))}),
p AS (SELECT * FROM a WHERE long AND (kind <> 4 OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')))),
w AS (SELECT * FROM p WHERE kind > 2),
x AS (SELECT w.doc_id, w.kind, w.name, w.s, w.e FROM w JOIN p ON p.doc_id = w.doc_id AND p.s <= w.e + 256 AND p.e >= w.s - 256 GROUP BY ALL
  HAVING bool_or((p.s >= w.e OR p.e <= w.s) AND ((w.kind = 3 AND p.kind IN (0, 2, 4)) OR (w.kind = 4 AND p.kind IN (1, 3, 5)) OR (w.kind = 5 AND p.kind IN (0, 2, 4))))
  AND NOT bool_or(p.kind < 3 AND p.s <= w.s AND p.e >= w.e)),
u AS (SELECT doc_id, kind, name, s, e, 0 AS linked FROM p WHERE kind < 3 UNION ALL SELECT doc_id, kind, name, s, e, 1 FROM x)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (linked = 0), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e), '') AS spans, count(*) FILTER (linked = 1) AS n_linked
FROM d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
c AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT k.b, c.reach FROM c JOIN k ON k.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(reach) AS component_id FROM c GROUP BY 1) m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {
    "op1_chat_format": OP1,
    "op2_secret_scan": OP2,
    "op7_line_dedup": linededup.ORACLE_SQL,
    "op8_exact_top_k": OP8,
    "op9_minhash_dedup": OP9,
    "op12_fill_in_middle": OP12,
}
