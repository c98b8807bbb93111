"""SQL that yields the rows of the queries, where SQL can."""

from __future__ import annotations

from sensorlake.llm.license_scan import LICENCES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, {_lowered(f"regexp_replace(line, '{_EDGES}', '', 'g')")} AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.key = f.key
GROUP BY doc_id
"""

SQL["op3_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs)
), twice AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS word FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT docs.doc_id, len(words) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines,
    len(list_filter(words, lambda w: regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS shouted,
    length(regexp_replace(text, '[^!?]', '', 'g')) AS cries
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * shouted > n_words
    OR 2 * cries > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM judged
"""

SQL["op4_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs)
), repeated AS (
  SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows) WHERE least < doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM repeated
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
), kept AS (
  SELECT each.doc_id, count(covered.pos) AS n_removed, string_agg(word, ' ' ORDER BY each.pos) FILTER (covered.pos IS NULL) AS text
  FROM each LEFT JOIN covered ON each.doc_id = covered.doc_id AND each.pos = covered.pos GROUP BY each.doc_id
)
SELECT docs.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(LICENCES))


_SPLIT = f"string_split(trim(regexp_replace({_lowered('body')}, '[^a-z0-9]+', ' ', 'g')), ' ')"
_PAIRS = "list_distinct(list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2]))"

SQL["op7_license_scan"] = f"""
WITH given AS (SELECT k, license_id, {_SPLIT} AS words FROM (VALUES {_VALUES}) AS t(k, license_id, body)),
templates AS (SELECT k, license_id, {_PAIRS} AS own FROM given),
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS unit, unnest(lines) AS body FROM parts
  UNION ALL SELECT doc_id, -1, text FROM parts WHERE len(lines) > 1
), cut AS MATERIALIZED (SELECT doc_id, unit, {_SPLIT} AS words FROM units),
sized AS MATERIALIZED (SELECT doc_id, unit, {_PAIRS} AS own FROM cut WHERE len(words) > 1),
each AS (SELECT doc_id, unit, len(own) AS n_bigrams, unnest(own) AS bigram FROM sized),
index AS (SELECT k, license_id, len(own) AS other, unnest(own) AS bigram FROM templates),
common AS (
  SELECT doc_id, unit, n_bigrams, k, license_id, other, count(*) AS n_common
  FROM each JOIN index USING (bigram) GROUP BY ALL
), found AS (
  SELECT *, 2 * n_common / (n_bigrams + other) AS dice FROM common WHERE 2 * n_common / (n_bigrams + other) >= 0.8
)
SELECT doc_id, unit, license_id, n_bigrams, n_common, dice FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, k) = 1
"""

SQL["op8_source_mixing"] = f"""
WITH sized AS (SELECT doc_id, text, source, len({_WORDS}) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sources),
weighted AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM ranked),
level AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY source_size / weight, rank) AS place
  FROM weighted WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (SELECT place, level FROM level WHERE source_size * 3 > level * weight ORDER BY place LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.place >= o.place THEN o.level * l.weight ELSE CAST(l.source_size * 3 AS DOUBLE) END AS target
  FROM level l LEFT JOIN open o ON true
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

SQL["op10_ngram_jaccard_join"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _lowered("coalesce(text, '')"))} AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS pos FROM docs)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT docs.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM docs JOIN reach ON docs.doc_id = reach.a LEFT JOIN sizes ON sizes.doc_id = docs.doc_id GROUP BY docs.doc_id
"""

SQL["op11_exact_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER stays AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER stays = 1 AS kept, sha256(body) AS text_sha256
FROM docs WINDOW stays AS (PARTITION BY body ORDER BY chars DESC, doc_id)
"""
