"""DuckDB SQL of the queries that SQL can express, with the same column names."""

from __future__ import annotations

from .queries import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

OP2 = f"""
WITH rules(r_host, r_path, r_action) AS (VALUES {_RULES}),
urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?:.*?)://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?:.*?)://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
hits AS (
  SELECT u.page_id, r_host || r_path AS rule, r_action,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM urls u JOIN rules ON (u.host = r_host OR u.host LIKE '%.' || r_host) AND starts_with(u.path, r_path))
SELECT u.page_id, u.host, u.path, h.rule, coalesce(h.r_action, 'allow') AS verdict
FROM urls u LEFT JOIN hits h ON h.page_id = u.page_id AND h.k = 1
"""

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN lowest ON lowest.a = d.doc_id
"""

OP6 = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18),
    lambda i: array_to_string(w[i:i + 19], ' '))) AS s
  FROM words WHERE len(w) >= 20),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM ranked, range(20) t(j) WHERE k > 1),
listed AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(
    list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words d LEFT JOIN listed ON listed.doc_id = d.doc_id
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', 1 + (((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT) >> {s}) & 31)::INT, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP7 = f"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (
  SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h, n) AS f,
    row_number() OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST) AS k FROM digests)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN f END AS refers_to
FROM ranked
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

OP13 = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score,
  s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2, "op3_minhash": OP3, "op6_substring_dedup": OP6, "op7_warc": OP7,
    "op9_maxscore": OP9,
    "op13_hilbert_negatives": OP13,
}
