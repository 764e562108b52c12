"""DuckDB SQL for the operators whose whole result SQL can state."""

from __future__ import annotations

_URL_PARTS = r"""
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"""

_RULES = "(VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)"

#: The test tables have no redirect or canonical links, so only the rules decide there;
#: the propagation is held against a brute-force version in the tests.
OP3 = f"""
WITH parts AS (SELECT page_id, {_URL_PARTS} FROM pages),
fit AS (
    SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v) AS k
    FROM parts JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (page_id)
"""

OP10 = """
WITH v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
),
reach AS (
    WITH RECURSIVE walk(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a)
    SELECT a, min(b) AS low FROM walk GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, e.vec_id = low AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
"""

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 49)) t(i) WHERE len(ws) >= 50),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(generate_series(0, 49)) t(k)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(generate_series(1, len(ws))) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_substring_dedup": OP1, "op3_url_filters": OP3, "op10_embedding_near_dedup": OP10}
