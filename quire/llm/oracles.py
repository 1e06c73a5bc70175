"""Queries whose results SQL gives as well, by plainer ways than the operators'."""

#: CRC-32 of ASCII text ``key`` in a query with ``crc_table`` (bytes' remainders).
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c
  FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS f FROM given, crc_table),
damaged AS (
  SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hit, UNNEST(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) - 1 AS i FROM damaged),
turns AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
inserts(state, mid, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edits(edit, own) AS (VALUES ('K', 0), ('R', 2), ('D', 3)),
walk AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM given
  UNION ALL
  SELECT w.c, w.i + 1, CASE WHEN edit = 'D' THEN mid WHEN edit = 'K' AND initial = 's' THEN 1 WHEN mid = 2 THEN 3 ELSE 2 END AS after,
    min({{'cost': (w.best.cost + 2 * n + own + CASE WHEN edit <> 'D' AND fault = 't' THEN 1 ELSE 0 END)::BIGINT, 'audit': w.best.audit || repeat('I', n) || edit}})
  FROM walk w JOIN turns t ON t.c = w.c AND t.i = w.i JOIN inserts s ON s.state = w.state CROSS JOIN edits
  WHERE edit = 'D' OR (fault NOT IN ('b', 'd') AND (edit = 'R' OR (initial = 's' AND mid = 0) OR (initial = 'u' AND mid <> 2) OR (initial = 'a' AND mid = 2)))
  GROUP BY 1, 2, 3),
last AS (SELECT c, (SELECT count(*) FROM turns t WHERE t.c = g.c) AS i FROM (SELECT DISTINCT c FROM given) g),
best AS (
  SELECT c, min({{'cost': w.best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': w.best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best
  FROM walk w JOIN last USING (c, i) GROUP BY c),
letters AS (SELECT c, k, substr(b.best.audit, k, 1) AS e FROM best b, UNNEST(range(1, length(b.best.audit) + 1)) u(k)),
steps AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY k) - 1 AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY k) AS nth FROM letters),
kept AS (SELECT s.c, k, nth, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, max(CASE WHEN nth = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS system FROM steps s LEFT JOIN turns t ON t.c = s.c AND t.i = s.i WHERE e <> 'D'),
lines AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired FROM kept GROUP BY c),
sums AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 0 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY c)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.best.cost AS cost, b.best.audit AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM given) g JOIN best b USING (c) LEFT JOIN sums USING (c) LEFT JOIN lines USING (c)
"""

TRIE = f"""
WITH {_CRC_TABLE},
given AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'word': md5(md5(role) || md5(text)), 'chars': length(text)}} ORDER BY turn NULLS FIRST, role, md5(text)) AS x FROM given GROUP BY c),
firsts AS (SELECT c, x, {_CRC} % 6 AS h FROM (SELECT *, c::VARCHAR AS key FROM own), crc_table),
rebuilt AS (SELECT f.c, coalesce(list_slice(b.x, 1, h), []) || coalesce(list_slice(f.x, h + 1, len(f.x)), []) AS x FROM firsts f LEFT JOIN own b ON b.c = f.c - f.c % 100),
prefixes AS (SELECT c, d, len(x) AS n, md5(array_to_string(list_transform(list_slice(x, 1, d), lambda y: y.word), ',')) AS node, CASE WHEN d > 0 THEN x[d].chars ELSE 0 END AS chars FROM rebuilt, UNNEST(range(len(x) + 1)) u(d)),
nodes AS (SELECT d, node, min(c) AS c, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM prefixes GROUP BY d, node),
steps AS (SELECT DISTINCT b.d, b.node, a.d AS above_d, a.node AS above FROM prefixes b JOIN prefixes a ON a.c = b.c AND a.d <= b.d),
children AS (SELECT above_d AS d, above AS node, count(*) AS n FROM steps WHERE d = above_d + 1 GROUP BY 1, 2),
subtrees AS (
  SELECT s.above_d AS d, s.above AS node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM steps s JOIN nodes n ON n.d = s.d AND n.node = s.node LEFT JOIN children k ON k.d = s.d AND k.node = s.node GROUP BY 1, 2)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN subtrees t ON t.d = n.d AND t.node = n.node LEFT JOIN children k ON k.d = n.d AND k.node = n.node
LEFT JOIN steps s ON s.d = n.d AND s.node = n.node AND s.above_d = n.d - 1 LEFT JOIN nodes p ON p.d = s.above_d AND p.node = s.above
"""

JOIN = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM words, UNNEST(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a) USING (doc_id)
"""
