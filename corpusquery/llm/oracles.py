"""SQL that the registered queries are checked against, where SQL can express them."""

from __future__ import annotations

from corpusquery.llm.line_rules import (
    BOILERPLATE,
    INNER_END,
    MAX_BOILERPLATE_WORDS,
    MAX_FRAGMENT_CHARS,
    MAX_FRAGMENT_WORDS,
    MAX_LOST_PERCENT,
    MAX_REPEAT_PERCENT,
    MAX_WORDS_PER_SEPARATOR,
    MIN_SEPARATORS,
    MIN_WORDS,
    SEPARATORS,
    SYMBOL_SHARE,
    SYMBOLS,
    TERMINAL,
)

LLM_ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Links are followed in their absolute form and from the root of a host.
LLM_ORACLES["op1_url_filters"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, instr(url, '://') AS pos,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
named AS (
  SELECT page_id, url, html, pos,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM p
),
keyed AS (SELECT *, CASE WHEN pos > 0 THEN host || path || query END AS alias FROM named),
tags AS (
  SELECT url, host, alias, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM keyed WHERE pos > 0
),
targets AS (
  SELECT url, host, alias, trim(CASE
    WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
      THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"'']*?url\s*=\s*([^"'']*)["'']', 1) END) AS t
  FROM tags
),
links AS (
  SELECT alias AS a, CASE
    WHEN instr(t, '://') > 0 THEN substr(t, instr(t, '://') + 3)
    WHEN starts_with(t, '//') THEN substr(t, 3)
    WHEN starts_with(t, '/') THEN host || t END AS rest
  FROM targets
),
edges AS (
  SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)
            || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS b
  FROM links WHERE rest IS NOT NULL
),
rules(action, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')
),
nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
node_rules AS (
  SELECT node, arg_max(action, length(rule)) AS action
  FROM nodes, rules
  WHERE ('.' || regexp_extract(node, '^([^/?#]*)', 1)) LIKE ('%.' || rhost)
    AND starts_with(regexp_extract(node, '^[^/?#]*([^?#]*)', 1), rpath)
  GROUP BY node
),
reached AS (
  SELECT node FROM node_rules WHERE action = 'block'
  UNION
  SELECT CASE WHEN edges.a = reached.node THEN edges.b ELSE edges.a END
  FROM reached JOIN edges ON edges.a = reached.node OR edges.b = reached.node
),
hit AS (
  SELECT h.host, h.path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM keyed) h JOIN rules
    ON ('.' || h.host) LIKE ('%.' || rhost) AND starts_with(h.path, rpath)
  GROUP BY h.host, h.path
)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.action, CASE WHEN alias IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN hit USING (host, path)
"""

LLM_ORACLES["op6_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
),
w AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
         string_split(t, chr(10)) AS ls,
         length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars
  FROM d
),
windows AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
),
twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1
),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS u(k) GROUP BY r
),
lines AS (
  SELECT r, x, len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> '')) AS n,
         length(x) - length(translate(x, {_quoted(SEPARATORS)}, '')) AS seps,
         length(x) - length(translate(x, {_quoted(SYMBOLS)}, '')) AS symbols,
         length(regexp_replace(x, '[ \t-\r]', '', 'g')) AS chars
  FROM w, unnest(ls) AS u(x)
),
judged AS (
  SELECT r, x, n, chars,
         n > 0 AND ((seps >= {MIN_SEPARATORS} AND n <= {MAX_WORDS_PER_SEPARATOR} * seps)
           OR {SYMBOL_SHARE} * symbols > chars
           OR (n <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(x, {_quoted(BOILERPLATE)}))
           OR (n <= {MAX_FRAGMENT_WORDS} AND length(x) <= {MAX_FRAGMENT_CHARS}
               AND NOT regexp_matches(x, {_quoted(TERMINAL)}) AND NOT regexp_matches(x, {_quoted(INNER_END)}))) AS failed
  FROM lines
),
by_doc AS (
  SELECT r, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS n_dup_lines,
         coalesce(sum(chars) FILTER (failed), 0) AS lost
  FROM judged GROUP BY r
),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, lost
  FROM w LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * lost <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM m
"""

LLM_ORACLES["op4_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS win
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
),
doc_windows AS (
  SELECT r, i, n, w[i:i + n - 1] AS win
  FROM d, (SELECT DISTINCT n FROM item_windows) s, unnest(range(1, len(w) - n + 2)) AS u(i)
),
hits AS (
  SELECT r, i, item_windows.n, item_id FROM doc_windows JOIN item_windows USING (n, win)
),
words_hit AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(0, n)) AS u(k) GROUP BY r
),
items_hit AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256
  FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""

# Leaves of one doc_id and source are ordered by digest, as in the operator.
LLM_ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE
parted AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
           || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         replace(text, chr(10), '') AS joined,
         list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                             WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS unfinished
  FROM documents
),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         -- The finished check sum is the complement.
         CASE WHEN unfinished % 2 = 1 THEN sha256(head || coalesce(strlen(joined) || ':' || joined, '-')) END AS changed
  FROM parted
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS id
  FROM leaves
),
tree AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY grp, pos // 3
),
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY pos // 3
),
climb AS (
  SELECT id, grp, 0 AS level, pos, n, coalesce(changed, leaf) AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT c.id, any_value(c.grp), any_value(c.level) + 1, any_value(c.pos // 3), any_value((c.n + 2) // 3),
         sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.digest ELSE t.digest END, '' ORDER BY t.pos)),
         any_value(c.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), '')
  FROM climb c JOIN tree t ON t.grp = c.grp AND t.level = c.level AND t.pos // 3 = c.pos // 3
  WHERE c.n > 1 GROUP BY c.id
),
last_climb AS (
  SELECT c.id, 0 AS level, s.pos, s.n, c.digest, c.proof FROM climb c JOIN subroots s USING (grp) WHERE c.n = 1
  UNION ALL
  SELECT c.id, any_value(c.level) + 1, any_value(c.pos // 3), any_value((c.n + 2) // 3),
         sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.digest ELSE t.digest END, '' ORDER BY t.pos)),
         any_value(c.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), '')
  FROM last_climb c JOIN top t ON t.level = c.level AND t.pos // 3 = c.pos // 3
  WHERE c.n > 1 GROUP BY c.id
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256,
       c.digest AS folded_root, c.digest = r.digest AS verified
FROM placed p JOIN subroots s USING (grp) JOIN last_climb c ON c.id = p.id AND c.n = 1
CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""

LLM_ORACLES["op11_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
totals AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
tf AS (
  SELECT doc_id, row, n, term, count(*) AS tf
  FROM (SELECT doc_id, row, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
),
asked AS (
  SELECT item_id, item, term, count(*) AS q FROM (
    SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
),
scored AS (
  SELECT item_id, item, doc_id, row,
         sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) CROSS JOIN totals
  GROUP BY item_id, item, doc_id, row
),
ranked AS (
  SELECT item_id, doc_id, score,
         (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
