"""SQL counterparts of the first ten operators' queries, for DuckDB, where SQL can say the same. The later ones have theirs in their modules."""

from __future__ import annotations

from tillroll.llm.quality import BOILERPLATE, NAVIGATION, TERMINAL

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NGRAM_JACCARD = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS words FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM split
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM least LEFT JOIN size USING (doc_id)
"""

#: The rules of lines, said in SQL; words of a line are its parts between blanks.
_N = "(length(line) - length(replace(line, ' ', '')) + 1)"


def _many(mark: str) -> str:
    return f"(length(line) - length(replace(line, {quoted(mark)}, '')))"


LINE_FAILS = f"""(
    length(line) - length(regexp_replace(line, '[#*$%&|<>]{{2,}}', '', 'g')) > 0.5::DOUBLE * {_N}
    OR {_many('|')} + {_many('»')} + {_many('›')} + {_many('•')} > 0.2::DOUBLE * {_N}
    OR ({_many('!')} > 0.3::DOUBLE * {_N} AND {_many('!')} >= 2)
    OR ({_N} < 4 AND NOT contains({quoted(TERMINAL)}, right(rtrim(translate(line, chr(9) || chr(13), '  ')), 1)))
    OR ({_N} < 4 AND regexp_matches(line, {quoted(NAVIGATION)}))
    OR {' OR '.join(f'contains(lower(line), {quoted(x)})' for x in BOILERPLATE)}
  )"""

QUALITY_RULES = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM doc),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
ahead AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER w = 5 THEN string_agg(word, ' ') OVER w END AS five FROM word
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
again AS (SELECT doc_id, i, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS again FROM ahead),
covered AS (
  SELECT doc_id, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM again
),
repeats AS (SELECT doc_id, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc),
filled AS (SELECT doc_id, line, count(*) AS copies FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
judged AS (
  SELECT doc_id, copies, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, {LINE_FAILS} AS fails FROM filled
),
lines AS (
  SELECT doc_id, sum(copies - 1) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS n_kept_words FROM judged GROUP BY doc_id
),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words
  FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 1 - CAST(n_kept_words AS DOUBLE) / n_words <= 0.5 AS kept FROM base
"""

WARC = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
    CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
),
first AS (SELECT payload_digest, min(page_id) AS response FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response < page_id THEN response END AS refers_to
FROM page LEFT JOIN first USING (payload_digest)
"""

ORACLE_SQL = {"op3_ngram_jaccard": NGRAM_JACCARD, "op4_quality_rules": QUALITY_RULES, "op6_warc": WARC}
