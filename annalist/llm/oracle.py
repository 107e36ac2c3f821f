"""DuckDB SQL for the operators of this subpackage that SQL can express."""

URLS = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
    len(string_split(host, '.')) > 2 AND regexp_matches(host, '[.](ac|co|com|edu|gov|net|org)[.]..$') AS double_suffix,
    array_to_string(list_slice(string_split(host, '.'), CASE WHEN double_suffix THEN -3 ELSE -2 END, -1), '.') AS domain,
    array_to_string(list_slice(string_split(host, '.'), CASE WHEN double_suffix THEN -2 ELSE -1 END, -1), '.') AS suffix
  FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
w AS (SELECT 1 AS level, n, k FROM s UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM h),
t AS (SELECT level, sum(k)::DOUBLE / sum(n) AS p,
    sum(k::DOUBLE * k / n) / sum(n) - (sum(k)::DOUBLE / sum(n)) ** 2 - count(*) * (sum(k)::DOUBLE / sum(n)) * (1 - sum(k)::DOUBLE / sum(n)) / sum(n) AS spread
  FROM w WHERE n > 0 GROUP BY level),
g AS (SELECT level, p, least(greatest(CASE WHEN spread > 0 THEN p * (1 - p) / spread - 1 ELSE 1000 END, 2), 1000) AS strength FROM t),
s1 AS (SELECT suffix, (k + strength * p) / (n + strength) AS m1 FROM s, g WHERE level = 1),
d1 AS (SELECT domain, (k + strength * m1) / (n + strength) AS m2 FROM d JOIN s1 USING (suffix), g WHERE level = 2),
h1 AS (SELECT host, k + strength * m2 AS a, n - k + strength * (1 - m2) AS b FROM h JOIN d1 USING (domain), g WHERE level = 3),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > least(0.5, 1.5 * (SELECT sum(k)::DOUBLE / sum(n) FROM s)) AS blocked FROM h1),
rules(kind, own, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, arg_max(own || start, length(own || start)) AS rule, arg_max(kind, length(own || start)) AS kind
  FROM (SELECT DISTINCT page_id, host, path FROM p) x, rules
  WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.kind, CASE WHEN r.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id LEFT JOIN r ON p.host = r.host
"""

LEAKS = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
run AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, run.n, item_id FROM run JOIN win USING (n, g)),
agg AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + n)))) AS spots, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items, count(DISTINCT item_id) AS k FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(k, 0) >= 2 AS contaminated
FROM d LEFT JOIN agg USING (doc_id)
"""

ORACLES = {"op3_url_filters": URLS, "op4_decontamination": LEAKS}
