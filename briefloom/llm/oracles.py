"""SQL that states what the expressible operators of this subpackage return."""

from __future__ import annotations

#: op4: all pairs by shared n-grams, components by reachability.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, COUNT(*) AS c FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 10 * p.i >= 8 * (x.c + y.c - p.i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), same AS (
  SELECT w, MIN(doc_id) AS first FROM d WHERE len(w) > 0 GROUP BY w
)
SELECT d.doc_id, c.class_id, COALESCE(same.first, d.doc_id) AS text_class_id, COALESCE(k.n_links, 0) AS n_links, d.doc_id = c.class_id AS kept
FROM d JOIN (SELECT a, MIN(b) AS class_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, CAST(COUNT(*) AS BIGINT) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id
LEFT JOIN same ON same.w = d.w
"""

#: op10: matches and their places by splitting, entropy over every window of a candidate.
SECRET_SCAN = r"""
WITH kinds(kind, ord, pat) AS (VALUES
  ('assign', 0, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{32,}'), ('entropy', 3, '[A-Za-z0-9+/_=-]{24,}')
), m AS (
  SELECT doc_id, kind, ord, pat, regexp_extract_all(coalesce(text, ''), pat) AS hits, regexp_split_to_array(coalesce(text, ''), pat) AS gaps FROM documents, kinds
), u AS (
  SELECT doc_id, kind, ord, pat, hits, gaps, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM m WHERE len(hits) > 0
), s AS (
  SELECT doc_id, kind, ord, pat, hit, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start,
    CASE WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN 32 ELSE 24 END AS size
  FROM u
), f AS (
  SELECT doc_id, kind, ord, start, start + length(hit) AS stop FROM s WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(hit, pat, 2)) >= 8 WHEN 'access' THEN length(hit) >= 16 WHEN 'hex' THEN true
    ELSE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
      AND NOT regexp_matches(hit, '(?i)(example|placeholder|changeme|dummy|redacted|lorem|xxxx|0123456789|abcdefgh)')
      AND NOT regexp_matches(hit, '^[A-Za-z]*([-_/=+][A-Za-z]+)*[-_/=+]*[0-9]{0,4}$')
      AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')
      AND coalesce(list_max(list_transform(range(1, length(hit) - size + 2), lambda k: list_aggregate(string_split(substr(hit, k, size), ''), 'entropy'))), 0)
        >= CASE size WHEN 32 THEN 3.0 ELSE 3.9 END
    END
), spans AS (
  SELECT * FROM f WHERE ord < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.ord < 3 AND b.start <= f.start AND b.stop >= f.stop)
), byd AS (
  SELECT doc_id, COUNT(*) FILTER (WHERE ord = 0) AS n_assign, COUNT(*) FILTER (WHERE ord = 1) AS n_access, COUNT(*) FILTER (WHERE ord = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN byd ON byd.doc_id = d.doc_id
"""

_TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text"

#: op11: rebuilt conversations as lists, every beginning of them grouped; crc32 bit by bit.
PREFIX_TRIE = rf"""
WITH t AS ({_TURNS} FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) AS own,
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS bits FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, own, xor(list_reduce(bits, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295) % 6 AS h FROM l
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS s FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100
), m AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r
), n AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '') AS ends FROM m GROUP BY 1, 2
), k AS (
  SELECT p[1:depth - 1] AS p, count(*) AS c FROM n WHERE depth > 0 GROUP BY 1
), u AS (
  SELECT n.p, depth, (n_convs - 1) * coalesce(length(n.p[depth].t), 0) AS s, CASE WHEN k.c IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k ON k.p = n.p
), v AS (
  SELECT p[1:d] AS p, CAST(sum(s) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM u) GROUP BY 1
)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.c, 0) AS n_children, v.n_leaves, v.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN v ON v.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n o ON n.depth > 0 AND o.p = n.p[1:n.depth - 1]
"""

#: op12: turns as they are; the template adds 32 characters a turn and one for each control string.
CHAT_FORMATTING = rf"""
WITH t AS ({_TURNS} FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>?)')) + 32 AS c FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(c) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
