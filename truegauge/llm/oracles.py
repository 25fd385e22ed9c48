"""DuckDB SQL of the queries that SQL can express."""

from truegauge.llm import quality_rules as q

ORACLE: dict[str, str] = {}


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


ORACLE["op1_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, t, regexp_extract_all(t, '{q.WORD}+') AS w FROM docs),
spot AS (SELECT doc_id, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i, w FROM base),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {q.WINDOW - 1}], ' ') AS x FROM spot),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, sum(least({q.WINDOW}, coalesce(i - before, {q.WINDOW}))) AS n FROM (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, x, {_count("x", q.WORD + "+")} AS n, {_count("x", q.WORD)} AS c FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '{q.WORD}')),
judged AS (SELECT *, NOT (100 * greatest({_count("x", q.SYMBOL)}, {_count("x", q.DOUBLED)}) >= {q.SYMBOL_SHARE} * n
    OR (n > {q.LONG_LINE} AND NOT regexp_matches(x, '{q.SENTENCE_MARK}'))
    OR ({_count("x", q.SEPARATOR)} >= 3 AND 4 * {_count("x", q.SEPARATOR)} >= n) OR regexp_matches(x, '{q.BOILERPLATE}')) AS ok FROM line),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (NOT ok) AS bad,
  sum(c) AS line_chars, coalesce(sum(c) FILTER (ok), 0) AS clean_chars FROM judged GROUP BY doc_id),
cols AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, {_count("t", q.WORD)}::BIGINT AS word_chars, {_count("t", q.SYMBOL)}::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(w) < {q.LEAST_WORDS} OR 100 * coalesce(rep.n, 0) > {q.REPEAT_SHARE} * len(w) AS base_failed, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(bad, 0)::BIGINT AS n_bad_lines, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(clean_chars, 0)::BIGINT AS clean_chars
  FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, NOT base_failed AND 100 * clean_chars >= {q.KEPT_SHARE} * line_chars AS kept FROM cols
"""

ORACLE["op5_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, s.n
"""

ORACLE["op10_decontamination"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM texts),
shingle AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
size AS (SELECT id, count(*) AS n FROM shingle WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS n_item, count(*) AS n_shared, round(count(*) / n, 6) AS containment
FROM shingle d JOIN shingle i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN size ON size.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) * 100 >= n * 80
"""
