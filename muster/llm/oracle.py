"""DuckDB counterparts of the operators' queries, written from what each means, without their methods."""

from __future__ import annotations

from .quality_rules import BOILERPLATE

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(len(ws), 5) AS k FROM i WHERE len(ws) > 0),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k)),
ig AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM (SELECT *, least(len(ws), 5) AS k FROM i WHERE len(ws) > 0))),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM hits JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE s >= 0.8 * (x.n + y.n - s) - 1e-9),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT r.doc_id, min(r.other) AS class_id, (SELECT count(*) FROM links l WHERE l.a = r.doc_id)::BIGINT AS n_links FROM reached r GROUP BY r.doc_id
"""

SUFFIX_DEDUP = r"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS p FROM h WHERE length(x) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
edges AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS fresh FROM again),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
         UNION ALL SELECT s.doc_id, max(b), any_value(length(x)) // 2 FROM spans s JOIN h ON s.doc_id = h.doc_id GROUP BY s.doc_id),
left_ AS (SELECT g.doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS x FROM gaps g JOIN h ON g.doc_id = h.doc_id GROUP BY g.doc_id),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT h.doc_id, (length(h.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(l.x, h.x))) AS kept_sha256
FROM h LEFT JOIN left_ l ON h.doc_id = l.doc_id LEFT JOIN cut c ON h.doc_id = c.doc_id
"""

_LINE = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUALITY_RULES = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, line, {_WORDS.format("line")} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (
  SELECT doc_id, line, len(ws) AS m,
         (len(ws) < 4 AND NOT regexp_matches(ws[-1], '[.!?:;")\]…。！？»”’'']$'))
      OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.3 * len(ws)
      OR 2 * len(list_filter(ws, lambda w: regexp_matches(w, '[!?][!?]$'))) > len(ws)
      OR 2 * len(list_filter(list_zip(ws[2:], ws[:-2]), lambda z: z[1] = z[2])) > len(ws)
      OR (length(regexp_replace(line, '[^|»›]', '', 'g')) >= 2 AND 10 * length(regexp_replace(line, '[^|»›]', '', 'g')) >= len(ws))
      OR {" OR ".join(f"contains({_LINE}, '{x}')" for x in BOILERPLATE)} AS bad
  FROM l WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(m) FILTER (NOT bad), 0)::BIGINT AS n_kept_words, count(*) FILTER (bad) AS n_bad_lines FROM j GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_kept_words, 0) AS n_kept_words, coalesce(n_bad_lines, 0) AS n_bad_lines
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM c
"""
