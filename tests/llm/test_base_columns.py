"""The base columns of the secret and licence scans against SQL on the smallest tables."""

from helixframe.llm.registry import QUERIES

LICENSES = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(words, label)),
h AS (SELECT doc_id, i, label FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w) a, p WHERE a.ws[i + 1 : i + len(p.words)] = p.words),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""

#: Marks put around each match; pieces between them tell the places.
SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)'), (1, 'access', '(AKIA[A-Z0-9]+)'), (2, 'hex', '([0-9a-f]+)')) v(o, kind, rx)),
s AS (SELECT doc_id, 0 AS o, 'assign' AS kind, string_split(regexp_replace(t, (SELECT rx FROM k WHERE o = 0), chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM d
  UNION ALL SELECT doc_id, 1, 'access', string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) FROM d
  UNION ALL SELECT doc_id, 2, 'hex', string_split(regexp_replace(t, '([0-9a-f]+)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) FROM d),
e AS (SELECT doc_id, o, kind, unnest(parts) AS part, unnest(range(len(parts))) AS nth FROM s),
m AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id, o ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e),
f AS (SELECT doc_id, o, kind, a::BIGINT AS a, (a + length(part))::BIGINT AS b FROM m WHERE nth % 2 = 1 AND CASE o
  WHEN 0 THEN length(regexp_replace(part, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) >= 6 WHEN 1 THEN length(part) >= 20 ELSE length(part) >= 24 END)
SELECT d.doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


def test_license_base_columns(same_as_sql):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert same_as_sql(lambda spark, folder: QUERIES["op10_license_scans"](spark, folder).select(*columns), LICENSES) > 0


def test_secret_base_columns(same_as_sql):
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert same_as_sql(lambda spark, folder: QUERIES["op5_secret_scans"](spark, folder).select(*columns), SECRETS) > 0
