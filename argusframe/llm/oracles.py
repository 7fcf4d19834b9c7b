"""SQL of the operators that SQL can express, by plain definitions rather than by the operators' methods."""

from .linededup import LONG_WORDS, MIN_LINES
from .sharding import PARTS, SLOTS

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT doc_id, octet_length(b) + 1 AS size, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b)[2 * i - 1 : 2 * i])::BIGINT) AS l FROM d),
bits AS (SELECT list(t ORDER BY k) AS crc FROM (SELECT k, list_reduce(range(8), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) AS t FROM range(256) r(k))),
c AS (SELECT doc_id, size, xor(list_reduce(l, lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM bytes, bits),
h AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS m FROM c),
s AS (SELECT doc_id, size, text_crc32, CAST(('0x' || substr(m, 1, 8))::BIGINT % {SLOTS} AS INT) AS vslot, CAST(('0x' || substr(m, 9, 8))::BIGINT % {PARTS} AS INT) AS part FROM h),
v AS (SELECT row_number() OVER (ORDER BY bytes DESC, vslot) AS n, vslot, bytes, (SELECT sum(size) FROM s) // 8 AS share FROM (SELECT vslot, sum(size)::BIGINT AS bytes FROM s GROUP BY 1)),
f(n, load, vslot, shard) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], -1, -1
  UNION ALL
  SELECT n, list_transform(range(1, 9), lambda i: load[i] + CASE WHEN i = to_ + 1 THEN bytes ELSE 0 END), vslot, to_
  FROM (SELECT v.n, f.load, v.vslot, v.bytes, CASE WHEN f.load[v.vslot % 8 + 1] + v.bytes <= v.share THEN v.vslot % 8 ELSE CAST(list_position(f.load, list_min(f.load)) AS INT) - 1 END AS to_ FROM f JOIN v ON v.n = f.n + 1))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY s.vslot, part, doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard, s.vslot, 2 AS map_version FROM s JOIN f ON s.vslot = f.vslot
"""

OP6 = f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
g(len, id, doc_id, name, n) AS (
  SELECT 1, id, doc_id, min(id) OVER (PARTITION BY line), count(*) OVER (PARTITION BY line) FROM s
  UNION ALL
  SELECT len + 1, id, doc_id, min(id) OVER (PARTITION BY name, line), count(*) OVER (PARTITION BY name, line) FROM (SELECT g.len, g.id, g.doc_id, g.name, s.line FROM g JOIN s ON s.id = g.id + g.len AND s.doc_id = g.doc_id WHERE g.n > 1)),
copies AS (SELECT id, max(len) AS len FROM g WHERE name < id GROUP BY 1),
runs AS (SELECT doc_id, k + len AS e, min(k) AS b FROM copies JOIN s USING (id) WHERE len >= {MIN_LINES} GROUP BY 1, 2),
alone AS (SELECT s.doc_id, k FROM copies JOIN s USING (id) WHERE len(list_filter(regexp_split_to_array(line, '[ \\t\\r\\x0b\\x0c]+'), lambda x: x <> '')) > {LONG_WORDS}),
c AS (SELECT doc_id, unnest(range(b, e)) AS k FROM runs UNION SELECT doc_id, k FROM alone),
t AS (SELECT l.doc_id, count(s.k) AS n_lines, count(c.k) AS removed_lines, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.k IS NULL) AS kept
      FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.i = s.i LEFT JOIN c ON c.doc_id = s.doc_id AND c.k = s.k GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n_runs, max(e - b) AS longest_run FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(removed_lines, 0) AS INT) AS removed_lines, CAST(coalesce(n_runs, 0) AS INT) AS n_runs, CAST(coalesce(longest_run, 0) AS INT) AS longest_run,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""

OP7 = r"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE instr(url, '://') > 0),
links AS (SELECT url, regexp_extract(tag, '(?i)(?:href\s*=\s*["'']?|url\s*=\s*''?)([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1) AS dest FROM tags WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
named AS (SELECT DISTINCT url, dest FROM links WHERE dest <> ''),
edges AS (SELECT url AS a, dest AS b FROM named),
seen AS (SELECT a AS url FROM edges UNION SELECT b FROM edges),
parts AS (SELECT url, translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM seen),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(n, m) AS (SELECT url, url FROM seen UNION SELECT e.b, r.m FROM reach r JOIN both_ways e ON r.n = e.a),
said AS (SELECT url, arg_max(verdict, length(h || rules.path)) AS verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(parts.path, rules.path) GROUP BY 1),
group_said AS (SELECT r.n AS url, max(CASE verdict WHEN 'allow' THEN 2 ELSE 1 END) AS rank FROM reach r JOIN said s ON r.m = s.url GROUP BY 1),
own AS (SELECT page_id, arg_max(verdict, length(h || rules.path)) AS verdict, arg_max(h || rules.path, length(h || rules.path)) AS rule FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, rules.path) GROUP BY 1)
SELECT p.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own.verdict, CASE WHEN rank = 1 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN own ON p.page_id = own.page_id LEFT JOIN group_said g ON p.url = g.url
"""

ORACLES = {"op3_sharding": OP3.strip(), "op6_line_dedup": OP6.strip(), "op7_url_filter": OP7.strip()}
