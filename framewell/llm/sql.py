"""SQL of the queries that SQL can express, for DuckDB."""

from framewell.llm.mixing import MOST, SEED, SHARE

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per
), up AS (
  SELECT *, row_number() OVER w AS nth_up,
    {SHARE}::DOUBLE * (sum(source_size) OVER ())::BIGINT - {MOST}::DOUBLE * coalesce((sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS left_size,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, nth)
), first_open AS (
  SELECT min(nth_up) AS open_from, arg_min(left_size / left_weight, nth_up) AS rate
  FROM up WHERE {MOST}::DOUBLE * source_size * left_weight > weight * left_size
), targets AS (
  SELECT source, source_size, CASE WHEN nth_up < coalesce(open_from, 2147483647) THEN {MOST}::DOUBLE * source_size ELSE weight * rate END AS target
  FROM up, first_open
), drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(2**52)}::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM drawn
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN l ON payload_bytes >= 1000 AND p.payload_digest = l.payload_digest
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 75 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reached r JOIN both_ways b ON b.x = r.node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM reached r WHERE r.node = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_HOST = "translate(regexp_extract(" + _REST + ", '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(" + _REST + ", '(?s)^[^/?#]*([^?#]*)', 1)"
_NODE = "CASE WHEN " + _HOST + " <> '' THEN " + _HOST + " || regexp_replace(regexp_extract(regexp_replace(" + _REST + ", '(?s)#.*$', ''), '(?s)^[^/?]*(.*)$', 1), '^([^/]|$)', '/\\1') END"
_RULES = "rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(h, p, v))"
_BEST = "(SELECT arg_max({{'rule': h || p, 'verdict': v}}, len(h || p)) FROM rules WHERE ({0} = h OR ends_with({0}, '.' || h)) AND starts_with({1}, p))"
#: Attributes come in either order.
_CANONICAL, _HREF = r"\brel\s*=\s*[\"'']?canonical\b", r"\bhref\s*=\s*[\"'']?([^\"''\s>]+)"
_REFRESH, _CONTENT = r"\bhttp-equiv\s*=\s*[\"'']?refresh\b", r"\bcontent\s*=\s*[\"'']?\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?[\"'']?([^\"''>\s]+)"
_LINKS = " || ".join(f"regexp_extract_all(html, '(?is)<{tag}\\b[^>]*{x}[^>]*{y}', 1)" for tag, pair in (("link", (_CANONICAL, _HREF)), ("meta", (_REFRESH, _CONTENT))) for x, y in (pair, pair[::-1]))

URL_FILTERS = f"""
WITH RECURSIVE {_RULES}, own AS (
  SELECT page_id, url, html, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path, {_NODE.format('url')} AS node FROM pages
), found AS (SELECT node, url, regexp_replace(unnest({_LINKS}), '(?i)&(amp|#0?38|#x26);', '&', 'g') AS href FROM own WHERE html IS NOT NULL AND url IS NOT NULL),
absolute AS (
  SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || href
    WHEN starts_with(href, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || href
    WHEN starts_with(href, '#') THEN url
    ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1), '/') || '/' || href END AS target FROM found
), edges AS (SELECT DISTINCT node AS x, {_NODE.format('target')} AS y FROM absolute),
both_ways AS (SELECT x, y FROM edges WHERE x <> y UNION SELECT y, x FROM edges WHERE x <> y),
reached AS (SELECT x AS node, x AS root FROM both_ways UNION SELECT b.y, r.root FROM reached r JOIN both_ways b ON b.x = r.node),
components AS (SELECT node, min(root) AS component FROM reached GROUP BY node),
judged AS (SELECT component, {_BEST.format("regexp_extract(node, '(?s)^([^/?]*)', 1)", "regexp_extract(node, '(?s)^[^/?]*([^?]*)', 1)")} AS best FROM components),
decided AS (SELECT component, CASE WHEN bool_or(best.verdict = 'allow') THEN 'allow' WHEN bool_or(best.verdict = 'block') THEN 'block' END AS verdict FROM judged GROUP BY component),
passed AS (SELECT node, verdict FROM components JOIN decided USING (component) WHERE verdict IS NOT NULL),
fitted AS (SELECT *, {_BEST.format("host", "path")} AS best FROM own)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, verdict, 'allow') AS verdict, best IS NULL AND verdict IS NOT NULL AS inherited
FROM fitted LEFT JOIN passed USING (node)
"""
