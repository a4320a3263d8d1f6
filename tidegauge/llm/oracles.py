"""DuckDB SQL for the rows of the queries that SQL can express."""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_WORDS = r"""list_filter(list_transform(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '')"""
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

OP6 = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
b AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY ALL),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

_HOST = "translate(regexp_extract({0}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = """(VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS r(rh, rp, rule, rv)"""

OP7 = f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, url, coalesce({_HOST.format('url')}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN contains(url, '://') THEN {_HOST.format('url')} || regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS address FROM pages
), tags AS (
  SELECT address, host, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM u
), targets AS (
  SELECT address, host, CASE WHEN regexp_matches(tag, '(?is)^<link.*\\srel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\\shttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)[\\s;"'']url\\s*=\\s*''?([^"''\\s>;]+)', 1) END AS t FROM tags
), absolute AS (
  SELECT address AS a, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t ELSE t END AS t FROM targets WHERE t <> ''
), e AS (
  SELECT a, {_HOST.format('t')} || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS b FROM absolute WHERE contains(t, '://') AND a IS NOT NULL
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
judged AS (
  SELECT n.address, arg_max(rv, length(rule)) AS v FROM (SELECT address FROM u UNION SELECT b FROM e) n
  JOIN {_RULES} ON (split_part(regexp_extract(n.address, '^[^/?#]*'), '@@', 1) = rh OR ends_with(regexp_extract(n.address, '^[^/?#]*'), '.' || rh)) AND starts_with(regexp_extract(n.address, '^[^/?#]*([^?#]*)', 1), rp) GROUP BY ALL
), bad AS (SELECT DISTINCT r.a FROM reach r JOIN judged j ON r.b = j.address WHERE j.v = 'block')
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM {_RULES} WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(rv, length(rule)) FROM {_RULES} WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), CASE WHEN address IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM c) GROUP BY conv_id, alone
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(text, ''))) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (SELECT *, arg_min(CASE WHEN level <= ratio THEN level END, ratio) FILTER (level <= ratio) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM f),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

_TOKENS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i+1] || ' ' || w[i+2])) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM r WHERE r.a = w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

OP4 = f"""
WITH w AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
v AS (SELECT doc_id, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS h FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
e AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY h, n ORDER BY doc_id, i) > 1 AS later FROM v),
g AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM e),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
