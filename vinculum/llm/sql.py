"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vinculum.llm.license_scans import TEMPLATES, bigrams_of, windows_of

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = r"trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_LOW.format(_TRIM.format('line'))} AS key FROM lines),
winners AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, w.key IS NOT NULL AND k.doc_id IS DISTINCT FROM w.keeper AS gone
  FROM keyed k LEFT JOIN winners w ON k.key = w.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
placed AS (
  SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM placed) WHERE n > 1),
inside AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM base LEFT JOIN inside USING (doc_id)),
tested AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (10 * n_symbols > n_words)::INT + (n_letters > 0 AND 2 * n_upper > n_letters)::INT + (5 * n_bangs > n_words)::INT
    + (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT
    + (10 * n_dup_lines > 3 * n_lines)::INT + (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)::INT AS n_broken
  FROM measured),
hosts AS (SELECT source, count(*) AS n_docs, count(*) FILTER (n_broken > 0) AS n_failed FROM tested GROUP BY source),
moments AS (SELECT avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS w FROM moments),
rates AS (SELECT source, (n_failed + m * w) / (n_docs + w) AS rate FROM hosts, prior)
SELECT t.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_broken <= CASE WHEN rate > 0.5 THEN -1 WHEN rate < 0.02 THEN 1 ELSE 0 END AS kept,
  n_broken, round(rate, 9) AS host_rate,
  CASE WHEN rate > 0.5 THEN 'condemned' WHEN rate < 0.02 THEN 'trusted' ELSE 'mixed' END AS host_verdict
FROM tested t JOIN rates r ON t.source IS NOT DISTINCT FROM r.source
"""

_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _found(rank: int, kind: str, pattern: str, group: int, least: int, extra: str = "TRUE") -> str:
    """Matches of a pattern: places are summed from the pieces between them."""
    return rf"""
  SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, start - 1 AS start, start - 1 + length(m) AS finish, value FROM (
    SELECT doc_id, source, ms[i] AS m, vs[i] AS value,
      1 + list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (
      SELECT doc_id, source, ms, vs, bs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs,
          regexp_split_to_array(text, '{pattern}') AS bs
        FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{pattern}'))))
  WHERE length(value) >= {least} AND {extra}"""


SECRET_SCANS = rf"""
WITH base AS ({_found(0, 'assign', _ASSIGN, 2, 12)} UNION ALL {_found(1, 'access', 'AKIA[A-Z0-9]+', 0, 18)}
  UNION ALL {_found(2, 'hex', '[0-9a-f]+', 0, 16)}),
more AS ({_found(3, 'mixed', '[A-Za-z0-9+/_-]+', 0, 24, "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
owned AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners,
    count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, chr(0)))) AS n_repositories FROM every GROUP BY value),
judged AS (
  SELECT e.*, CASE WHEN n_owners > 1 OR n_repositories > 5 THEN 'example'
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8
    THEN 'live' ELSE 'plain' END AS status
  FROM every e JOIN owned USING (value)),
spans AS (
  SELECT doc_id, rank, kind, start, finish FROM base
  UNION ALL
  SELECT DISTINCT doc_id, 3, 'live', finish - length(value), finish FROM judged WHERE status = 'live'),
told AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank, finish) AS spans FROM spans GROUP BY doc_id),
told_base AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank, finish) AS spans,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM base GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) FILTER (status = 'example') AS n_example, count(*) FILTER (status = 'live') AS n_live FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(t.spans, '') AS spans,
  coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN told_base b USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""


def _license_sql() -> str:
    rows = ",\n  ".join(
        f"('{n}', {[*bigrams_of(t)]!r})" for n, t in sorted(TEMPLATES)
    )
    words, text_words = _LOW.format("unit"), _LOW.format("text")
    anchors = ",\n  ".join(f"('{n}', {[*bigrams_of(t)]!r}, '{g}', {at}, {size})" for n, t in sorted(TEMPLATES) for g, at, size in windows_of(t))
    return f"""
WITH templates(license, grams) AS (VALUES
  {rows}),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
worded AS (SELECT doc_id, line, string_split(trim(regexp_replace({words}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
paired AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded),
dice AS (
  SELECT doc_id, line, license, 2.0 * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) AS dice
  FROM paired p JOIN templates t ON len(p.grams) BETWEEN len(t.grams) / 1.5 - 1 AND len(t.grams) * 1.5 + 1),
matched AS (
  SELECT doc_id, line, min(license) AS license, any_value(top) AS dice FROM (
    SELECT *, max(dice) OVER (PARTITION BY doc_id, line) AS top FROM dice) WHERE dice = top AND dice >= 0.8
  GROUP BY doc_id, line),
anchors(license, grams, gram, off, n) AS (VALUES
  {anchors}),
whole AS (SELECT doc_id, string_split(trim(regexp_replace({text_words}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text <> ''),
placed AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM whole),
around AS (
  SELECT doc_id, license, grams, w[greatest(i - off, 1):greatest(i - off, 1) + n - 1] AS v
  FROM placed JOIN anchors ON w[i] || ' ' || w[i + 1] = gram),
compared AS (SELECT doc_id, license, grams, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS own FROM around),
windows AS (
  SELECT doc_id, license, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM compared
  WHERE 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) >= 0.8),
every AS (SELECT doc_id, license, dice, 1 AS unit FROM matched UNION ALL SELECT doc_id, license, dice, 0 FROM windows),
best AS (
  SELECT doc_id, sum(unit)::BIGINT AS n_matches, count(*) - sum(unit)::BIGINT AS n_windows, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice
  FROM every GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_matches, 0) AS n_matches, coalesce(n_windows, 0) AS n_windows, coalesce(licenses, '') AS licenses,
  best_license, round(coalesce(best_dice, 0), 9)::DOUBLE AS best_dice
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN best USING (doc_id)
"""


NGRAM_JOIN = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN list_aggregate(w, 'string_agg', ' ')
    ELSE list_aggregate(w[i:i + 4], 'string_agg', ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""

MIX_SOURCES = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
    1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight
  FROM sized GROUP BY source),
-- the sources capped so far, until no share is above its cap
rounds(step, capped) AS (
  SELECT 0, []::VARCHAR[]
  UNION ALL
  SELECT step + 1, more FROM (
    SELECT step, capped, list_sort(list_distinct(capped || (
      SELECT list(coalesce('s' || source, 'null')) FROM sources s, (
        SELECT (SELECT sum(source_size) FROM sources) - 3 * coalesce(sum(source_size) FILTER (list_contains(capped, coalesce('s' || source, 'null'))), 0) AS rest,
          sum(weight) FILTER (NOT list_contains(capped, coalesce('s' || source, 'null'))) AS w FROM sources)
      WHERE NOT list_contains(capped, coalesce('s' || source, 'null')) AND weight * rest > 3 * source_size * w))) AS more
    FROM rounds) WHERE len(more) > len(capped)),
final AS (SELECT capped FROM rounds ORDER BY step DESC LIMIT 1),
level AS (
  SELECT capped, (SELECT sum(source_size) FROM sources) - 3 * coalesce(sum(source_size) FILTER (list_contains(capped, coalesce('s' || source, 'null'))), 0) AS rest,
    sum(weight) FILTER (NOT list_contains(capped, coalesce('s' || source, 'null'))) AS w
  FROM sources, final GROUP BY capped),
targets AS (
  SELECT source, source_size, n_docs, CASE WHEN list_contains(capped, coalesce('s' || source, 'null')) THEN (3 * source_size)::DOUBLE
    ELSE (weight * rest)::DOUBLE / w::DOUBLE END AS target FROM sources, level),
odds AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM targets),
ranked AS (
  SELECT d.*, o.source_size, o.target, o.whole, o.p, o.target - o.whole * o.source_size AS rest,
    (u / (1 - u)) / (least(greatest(p, 1e-12), 1 - 1e-12) / (1 - least(greatest(p, 1e-12), 1 - 1e-12))
      * (greatest(size, 1)::DOUBLE * n_docs::DOUBLE / greatest(source_size, 1)::DOUBLE)) AS q
  FROM sized d JOIN odds o ON d.source IS NOT DISTINCT FROM o.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * least(3, whole + (upto - size / 2.0 <= rest)::INT)::BIGINT END AS taken
FROM summed
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op4_secret_scans": SECRET_SCANS,
    "op6_ngram_join": NGRAM_JOIN,
    "op7_license_scans": _license_sql(),
    "op10_mix_sources": MIX_SOURCES,
}
