"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from facility_insights.llm import chat, lexical, quality

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASS = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _escaped(column: str) -> str:
    return f"regexp_replace({column}, '{chat.ESCAPABLE}', '\\1\\\\\\2\\3', 'g')"


CHAT = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} + length({_escaped("replace(replace(role, '%', '%25'), ']', '%5D')")}) + length({_escaped("t")})) OVER o AS upto
  FROM given WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM s)),
q AS (SELECT DISTINCT m FROM p),
v AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, q WHERE len(w) >= m)),
h AS (SELECT v.r, v.i, v.m, p.item_id FROM v JOIN p ON v.m = p.m AND v.x = p.x),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

_SPACE = r"\x20\x09-\x0D"
_WIDTH = " ".join(f"WHEN '{m}' THEN {w}" for m, w in quality.MARGIN.items())
_FENCED = " AND ".join(
    f"max(CASE WHEN measure = '{m}' THEN x <= high_q + high_q // 32 + greatest(margin, high_q - mid_q) END)" + (f" AND max(CASE WHEN measure = '{m}' THEN x >= low_q - greatest(margin, mid_q - low_q) END)" if m == quality.MEASURES[0] else "") for m in quality.MEASURES
)


def _quantiles(name: str, keys: str, source: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
{name}_s AS (SELECT {by}measure, low, sum(n) AS n FROM {source} GROUP BY {by}measure, low),
{name} AS (
  SELECT {by}measure, max(total) AS total, {", ".join(f"min(low) FILTER (100 * upto >= {share} * total) AS {q}" for q, share in zip(quality.QUANTILES, (quality.LOW, quality.MIDDLE, quality.HIGH), strict=True))}
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total FROM {name}_s)
  GROUP BY {by}measure)"""


_PICK = "CASE WHEN f.total >= {n} THEN f.{q} WHEN l.total >= {n} THEN l.{q} ELSE c.{q} END AS {q}"

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS times
  FROM (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE times > 1) GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS (
  SELECT r, lang, source, base_failed, 'word_length' AS measure, 100 * word_chars // greatest(1, n_words) AS x FROM b
  UNION ALL SELECT r, lang, source, base_failed, 'symbols', 10000 * n_symbols // greatest(1, n_words) FROM b
  UNION ALL SELECT r, lang, source, base_failed, 'dup_lines', 10000 * n_dup_lines // greatest(1, n_lines) FROM b
  UNION ALL SELECT r, lang, source, base_failed, 'repeats', 10000 * n_repeat_words // greatest(1, n_words) FROM b),
k AS (
  SELECT lang, source, measure, (x >> e) << e AS low, count(*) AS n
  FROM (SELECT *, CAST(greatest(0, length(bin(x)) - {quality.KEPT_BITS}) AS BIGINT) AS e FROM x WHERE NOT base_failed) GROUP BY ALL),
{_quantiles("f", "lang, source", "k")},
{_quantiles("l", "lang", "k")},
{_quantiles("c", "", "k")},
t AS (
  SELECT f.lang, f.source, f.measure, {", ".join(_PICK.format(q=q, n=quality.GROUP_ROWS) for q in quality.QUANTILES)}
  FROM f JOIN l ON f.lang = l.lang AND f.measure = l.measure JOIN c ON f.measure = c.measure),
v AS (
  SELECT r, {_FENCED} AS inside
  FROM (SELECT x.*, {', '.join(quality.QUANTILES)}, CASE measure {_WIDTH} END AS margin FROM x JOIN t USING (lang, source, measure)) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM b LEFT JOIN v USING (r)
"""

# Alike lines share a variant without one word at the same place, or one is a variant of the other.
LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
a AS (
  SELECT r, doc_id, i, trim(raw[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM d)),
n AS (SELECT *, dense_rank() OVER (ORDER BY coalesce(doc_id, 9223372036854775807), i) AS place FROM a WHERE line <> ''),
u AS (SELECT line, min(place) AS place, string_split(line, ' ') AS w FROM n GROUP BY line),
v AS (
  SELECT line, place, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 : len(w)]), ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 5)),
same AS (SELECT x, i, min(place) AS first FROM v GROUP BY x, i HAVING count(*) > 1),
whole AS (SELECT v.x, min(v.place) AS cut, min(u.place) AS whole FROM v JOIN u ON v.x = u.line WHERE len(u.w) >= 5 GROUP BY v.x),
near AS (
  SELECT v.line FROM v JOIN same ON v.x = same.x AND v.i = same.i WHERE same.first < v.place
  UNION SELECT v.line FROM v JOIN whole USING (x) WHERE whole.whole < v.place
  UNION SELECT u.line FROM u JOIN whole ON u.line = whole.x WHERE whole.cut < u.place),
gone AS (SELECT n.r, n.i FROM n JOIN u USING (line) WHERE n.place > u.place OR line IN (SELECT line FROM near)),
kept AS (
  SELECT a.r, string_agg(raw[a.i], chr(10) ORDER BY a.i) AS text
  FROM a JOIN d USING (r) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = a.r AND gone.i = a.i) GROUP BY a.r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  (SELECT count(*) FROM n WHERE n.r = d.r) AS n_lines, (SELECT count(*) FROM gone WHERE gone.r = d.r) AS n_removed
FROM d LEFT JOIN kept USING (r)
"""

# "//" rounds down, as all numbers are positive.
LEXICAL = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d),
b AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all({_LOWER}, '{_CLASS}')) AS term FROM b),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, {lexical.LENGTH - lexical.SLOPE} + ({lexical.SLOPE} * len(w) * n_docs) // n_words AS norm FROM d, s),
x AS (
  SELECT q, item_id, m.r, doc_id, sum(weight * (({lexical.SHARE} * tf) // ({lexical.FREQUENCY} * tf + 20 * norm)))::BIGINT AS score
  FROM t JOIN p USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY q, item_id, m.r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""

ORACLE: dict[str, str] = {"op3_chat": CHAT, "op5_decontamination": DECONTAMINATION, "op9_quality": QUALITY, "op10_lines": LINES, "op11_lexical": LEXICAL}
