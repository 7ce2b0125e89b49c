"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

# All alignments of documents and items that have 11 words in common, then every window of 13.
OP9 = r"""
WITH
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at FROM (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)),
size AS (SELECT doc_id, count(*) AS dn FROM dw GROUP BY 1),
aligned AS (
  SELECT d.doc_id, i.item_id, d.at - i.at AS shift, any_value(i.n) AS n, list(i.at) AS ats
  FROM dw d JOIN iw i ON d.word = i.word GROUP BY 1, 2, 3 HAVING count(*) >= 11),
begun AS (
  SELECT doc_id, item_id, shift, ats, unnest(generate_series(greatest(0, -shift), least(n, dn - shift) - 13)) AS s
  FROM aligned JOIN size USING (doc_id)),
windows AS (SELECT *, len(list_filter(ats, lambda x: x >= s AND x < s + 13)) AS agree FROM begun)
SELECT doc_id, item_id, shift, min(s) + shift AS doc_from, max(s) + shift + 13 AS doc_to, min(s) AS item_from, max(agree) AS agree
FROM windows WHERE agree >= 11 GROUP BY 1, 2, 3
"""

# Links are read, resolved and followed as redirects; equal urls are one node.
OP10 = r"""
WITH RECURSIVE
rules(action, host, path, rule) AS (VALUES
  ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'),
  ('allow', 'www.example.com', '/en/', 'www.example.com/en/'),
  ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')),
p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM p),
links AS (
  SELECT url, node, trim(replace(link, '&amp;', '&')) AS link FROM (
    SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1) AS link
    FROM n WHERE html ILIKE '%canonical%'
    UNION ALL
    SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*[''"]?([^"''>\s]+)', 1)
    FROM n WHERE html ILIKE '%refresh%') WHERE link <> ''),
targets AS (
  SELECT node AS u, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN link LIKE '//%' THEN regexp_extract(url, '^(.*?)://', 1) || ':' || link
    WHEN link LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || link
    WHEN link LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || link
    WHEN link LIKE '#%' THEN NULL
    WHEN regexp_matches(url, '^.*?://[^/?#]*/') THEN regexp_extract(url, '^(.*?://[^/?#]*/(?:[^?#]*/)?)', 1) || link
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1) || '/' || link END AS to_url
  FROM links),
edges AS (
  SELECT DISTINCT u, h || CASE WHEN t = '' THEN '/' ELSE t END || q AS v FROM (
    SELECT u,
      translate(regexp_extract(to_url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
      regexp_extract(to_url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS t,
      regexp_extract(to_url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS q
    FROM targets WHERE to_url IS NOT NULL) WHERE h <> '' AND u IS NOT NULL),
reach(a, b) AS (
  SELECT u, v FROM edges UNION SELECT v, u FROM edges
  UNION SELECT r.a, CASE WHEN e.u = r.b THEN e.v ELSE e.u END FROM reach r JOIN edges e ON r.b = e.u OR r.b = e.v),
aliases AS (
  SELECT a, b, split_part(b, '/', 1) AS host, regexp_extract(b, '^[^/]*([^?]*)', 1) AS path FROM reach UNION
  SELECT u, u, split_part(u, '/', 1), regexp_extract(u, '^[^/]*([^?]*)', 1) FROM edges),
fits AS (
  SELECT x.host AS h, x.path AS t, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT host, path FROM n UNION SELECT host, path FROM aliases) x
  JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)
  GROUP BY 1, 2),
said AS (SELECT a.a AS node, min(f.action) AS action FROM aliases a JOIN fits f ON f.h = a.host AND f.t = a.path GROUP BY 1)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.action, s.action, 'allow') AS verdict
FROM n LEFT JOIN fits f ON f.h = n.host AND f.t = n.path LEFT JOIN said s ON s.node = n.node
"""


# Levels are built upwards by recursion; the siblings of a node are windows over its run.
OP12 = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents),
f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaf AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM f),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM leaf),
tree AS (
  SELECT key, 0 AS level, place AS idx, n, leaf AS digest FROM ranks
  UNION ALL
  SELECT key, level + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY key, level, idx // 16),
subroots AS (SELECT key, level, digest, row_number() OVER (ORDER BY key) - 1 AS nth, count(*) OVER () AS n FROM tree WHERE n = 1),
summit AS (
  SELECT 0 AS level, nth AS idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM summit WHERE n > 1 GROUP BY level, idx // 16),
sides AS (
  SELECT key, level, idx, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER after, '') AS r FROM tree WHERE n > 1
  WINDOW before AS (PARTITION BY key, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY key, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
top_sides AS (
  SELECT level, idx, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER after, '') AS r FROM summit WHERE n > 1
  WINDOW before AS (PARTITION BY level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
steps AS (
  SELECT r.key, r.place, s.level, s.l, s.r FROM ranks r JOIN sides s ON s.key = r.key AND s.idx = r.place // (16 ** s.level)::BIGINT
  UNION ALL
  SELECT r.key, r.place, u.level + t.level, t.l, t.r FROM ranks r JOIN subroots u ON u.key = r.key JOIN top_sides t ON t.idx = u.nth // (16 ** t.level)::BIGINT),
paths AS (SELECT key, place, list({'l': l, 'r': r} ORDER BY level) AS path FROM steps GROUP BY key, place),
folded AS (
  SELECT r.doc_id, r.leaf, u.digest AS subroot, coalesce(path, []) AS way,
         list_reduce(list_concat([{'l': coalesce(tampered, leaf), 'r': ''}], coalesce(path, [])), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root
  FROM ranks r JOIN subroots u ON u.key = r.key LEFT JOIN paths p ON p.key = r.key AND p.place = r.place)
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
       folded_root, folded_root = root.digest AS verified
FROM folded, (SELECT digest FROM summit WHERE n = 1) root
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3,
        "op9_decontamination": OP9,
        "op10_url_filter": OP10,
        "op12_merkle_manifest": OP12,
    }
