"""DuckDB SQL with the rows of each query that SQL can express."""

from __future__ import annotations

from forecourt.llm.quality_rules import STOP_WORDS
from forecourt.llm.queries import URL_RULES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT k, unnest(range(1, len(words) - 3)) AS pos, words FROM split WHERE len(words) >= 5),
named AS (SELECT k, pos, array_to_string(words[pos:pos + 4], ' ') AS w FROM windows),
twice AS (SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY k, w) AS n FROM named) WHERE n >= 2),
repeated AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY k),
counted AS (SELECT s.doc_id, cast(len(words) AS bigint) AS n_words, cast(length(array_to_string(words, '')) AS bigint) AS word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  len(lines) AS n_lines, cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
  len(list_filter(words, lambda w: rtrim(lower(w), '.,;:') IN ({_STOP}))) AS n_stop_words,
  cast(coalesce(r.n, 0) AS bigint) AS n_repeat_words FROM split s LEFT JOIN repeated r USING (k)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_words < 10 OR coalesce(word_chars / nullif(n_words, 0) < 2.5, false) OR coalesce(word_chars / nullif(n_words, 0) > 12, false)
  OR coalesce(n_symbols / nullif(n_words, 0) > 0.1, false) OR (n_words >= 20 AND n_stop_words / nullif(n_words, 0) < 0.05)
  OR coalesce(n_dup_lines / nullif(n_lines, 0) > 0.4, false) OR coalesce(n_repeat_words / nullif(n_words, 0) > 0.2, false) AS failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM judged
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

URLS = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
parts AS (SELECT row_number() OVER () AS k, page_id,
  CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (k)
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

PASSAGES = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[s:s + 9], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, n, p, array_to_string(words[p:p + n - 1], ' ') AS w
  FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM docs JOIN lengths ON len(words) >= n)),
found AS (SELECT k, p, item_id, places.n AS n FROM places JOIN windows ON places.w = windows.w AND places.n = windows.n),
hit AS (SELECT k, count(DISTINCT at_word) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS at_word FROM found) GROUP BY k),
listed AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT k, cast(item_id AS varchar) AS item FROM found) GROUP BY k)
SELECT doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (k) LEFT JOIN listed USING (k)
"""

# crc32 of the decimal id, bit by bit; words as in Spark; ties of a turn by the digest of role and text
TRIE = """
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(k, 1, 32)) - 1 AS i, k, w FROM (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(cast(c AS varchar), ''),
  lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM own),
turns AS (SELECT v.c, 0 AS part, o.i, o.k, o.w FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.i < v.h
  UNION ALL SELECT v.c, 1, o.i, o.k, o.w FROM convs v JOIN own o ON o.c = v.c AND o.i >= v.h),
said AS (SELECT c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM convs
  LEFT JOIN (SELECT c, list(k ORDER BY part, i) AS ids, list(w ORDER BY part, i) AS ws FROM turns GROUP BY c) USING (c)),
members AS (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM said),
keyed AS (SELECT c, d, len(ids) = d AS ends, md5(array_to_string(ids[1:d], '/')) AS node,
  CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], '/')) END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM members),
nodes AS (SELECT node, any_value(d) AS d, any_value(parent) AS parent, min(c) AS first, count(*) AS n, any_value(w) AS w,
  string_agg(cast(c AS varchar), ',' ORDER BY c) FILTER (ends) AS list FROM keyed GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
pairs AS (SELECT DISTINCT a.node AS top, b.node AS below FROM keyed a JOIN keyed b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT p.top AS node, sum((n.n - 1) * n.w) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM pairs p JOIN nodes n ON n.node = p.below LEFT JOIN kids ON kids.node = n.node GROUP BY p.top)
SELECT n.first AS conv_id, n.d AS depth, up.first AS parent_conv_id, n.n AS n_convs, cast(coalesce(k, 0) AS bigint) AS n_children,
  cast(leaves AS bigint) AS n_leaves, cast(saved AS bigint) AS saved_tokens, sha256(coalesce(n.list, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node
"""

ORACLES = {"op13_prefix_trie": TRIE, "op9_positional_index": PASSAGES, "op8_quality_rules": QUALITY, "op10_url_rules": URLS}
