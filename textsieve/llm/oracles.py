"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

NEAR_DEDUP = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM words),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes u ON x = u.doc_id JOIN sizes v ON y = v.doc_id WHERE 100 * c >= 85 * (u.n + v.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least ON doc_id = x"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT *, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', substr(h, i * 5 + j, 1)) - 1)::BIGINT), lambda x, y: x * 16 + y)) AS v FROM p JOIN g USING (h))
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('{_BASE32}', ((x >> 15) & 31) + 1, 1) || substr('{_BASE32}', ((x >> 10) & 31) + 1, 1) || substr('{_BASE32}', ((x >> 5) & 31) + 1, 1) || substr('{_BASE32}', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

ORACLES = {"op1_near_dedup": NEAR_DEDUP, "op6_warc": WARC}
