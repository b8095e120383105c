"""DuckDB counterparts of the queries that SQL can state: every pair and window compared, nothing indexed."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS key FROM starts),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM ranked WHERE n > 1),
cut AS (SELECT doc_id, list(pos) AS cuts FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, list_filter(w, lambda x, i: NOT list_contains(coalesce(cuts, []), i)) AS k
  FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id)
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(size: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of word shingles are alike, by comparing every two with a common shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace('text', _LOWERED, 1)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s
  FROM d),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM cells a JOIN cells b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id{more}
FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id"""


JACCARD_JOIN = _components(4, 85)
SKETCH_DUPLICATES = _components(5, 85, ", s.doc_id = min(r.b) AS kept")

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
items AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM items WHERE len(w) > 0),
ishingles AS (SELECT item_id, n, k, unnest(range(1, n - k + 2)) AS j, w FROM i),
icells AS (SELECT item_id, n, k, j, array_to_string(w[j:j + k - 1], ' ') AS x FROM ishingles),
ks AS (SELECT DISTINCT k FROM i),
dshingles AS (SELECT doc_id, len(w) AS n, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
dcells AS (SELECT doc_id, n, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM dshingles),
placed AS (
  SELECT DISTINCT c.doc_id, c.k, i.item_id, i.n, greatest(0, least(greatest(0, c.p - i.j), c.n - i.n)) AS s
  FROM dcells c JOIN icells i ON i.x = c.x AND i.k = c.k),
found AS (
  SELECT p.doc_id, p.item_id, p.s, p.n, p.k, c.x, count(*) AS m
  FROM placed p JOIN dcells c ON c.doc_id = p.doc_id AND c.k = p.k AND c.p BETWEEN p.s + 1 AND p.s + p.n - p.k + 1 GROUP BY ALL),
wanted AS (SELECT item_id, x, count(*) AS m FROM icells GROUP BY ALL),
judged AS (
  SELECT f.doc_id, f.item_id, f.s, sum(least(f.m, coalesce(w.m, 0))) AS c, sum(f.m) + any_value(f.n - f.k + 1) AS total
  FROM found f LEFT JOIN wanted w ON w.item_id = f.item_id AND w.x = f.x GROUP BY f.doc_id, f.item_id, f.s),
near AS (SELECT doc_id, item_id, s, c / (total - c) AS q FROM judged WHERE c / (total - c) >= 0.8)
SELECT doc_id, item_id, CAST(arg_min(s, (-q, s)) AS INTEGER) AS start, CAST(max(q) AS DOUBLE) AS similarity
FROM near GROUP BY doc_id, item_id"""

_UNITS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"

FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_UNITS} AS u, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
ranks AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut"""
