"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm.licenses import TEMPLATES, template_bigrams
from tessera.llm.mixing import BITS

ORACLE_SQL: dict[str, str] = {}

_GAP = r"[\x20\x09-\x0D]+"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL["op3_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
-- deal out what is left by weight; stop sources at their caps; again, until none is above
deal AS (
  SELECT 0 AS round, place, weight, cap, false AS stopped, (SELECT 1.5::DOUBLE * sum(source_size) FROM w) AS pot, sum(weight) OVER () AS open_weight FROM w
  UNION ALL
  SELECT round + 1, place, weight, cap, now_full, first(total) OVER () - coalesce(sum(cap) FILTER (now_full) OVER (), 0), coalesce(sum(weight) FILTER (NOT now_full) OVER (), 0)
  FROM (SELECT *, stopped OR pot / open_weight * weight > cap AS now_full, (SELECT 1.5::DOUBLE * sum(source_size) FROM w) AS total FROM deal WHERE open_weight > 0 AND round < 1000)
  QUALIFY bool_or(now_full <> stopped) OVER ()),
t AS (SELECT place, CASE WHEN stopped THEN cap ELSE pot / open_weight * weight END AS target FROM deal WHERE round = (SELECT max(round) FROM deal)),
g AS (SELECT w.source, w.source_size, t.target, CASE WHEN w.source_size > 0 THEN floor(t.target / w.source_size)::BIGINT ELSE 0 END AS whole FROM w JOIN t USING (place)),
b AS (SELECT *, target - whole * source_size AS budget FROM g),
hist AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
run AS (SELECT hist.*, budget, sum(words) OVER (PARTITION BY hist.source ORDER BY h) AS upto FROM hist JOIN b ON hist.source IS NOT DISTINCT FROM b.source),
-- hashes under the one that passes the budget, and that one if it comes nearer; nothing for a budget of nothing
more AS (SELECT source, h FROM run WHERE budget > 0 AND (upto <= budget OR (upto - words <= budget AND 2 * (budget - (upto - words)) >= words AND upto - words >= 0)))
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.whole + CASE WHEN m.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN more m ON d.h = m.h AND d.source IS NOT DISTINCT FROM m.source
"""

ORACLE_SQL["op5_line_dedup"] = f"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM d),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

ORACLE_SQL["op8_vector_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""

ORACLE_SQL["op4_ngram_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 175 * k >= 75 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


def _licenses() -> str:
    known = ", ".join(f"('{i}', [{', '.join(repr(g) for g in template_bigrams(t))}])" for i, t in TEMPLATES)
    return rf"""
WITH known(id, grams) AS (VALUES {known}),
low AS (SELECT min(len(grams)) * 0.8 / 1.2 * (1 - 1e-9) AS least, max(len(grams)) * 1.2 / 0.8 / (1 - 1e-9) AS most FROM known),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, unnest(string_split(text, chr(10))) AS unit FROM d
  UNION ALL SELECT r, unit FROM (SELECT r, unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) AS unit FROM d) WHERE contains(unit, chr(10))),
w AS (SELECT r, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u WHERE length(unit) >= 2 * greatest(1, (SELECT least FROM low)::INT) + 1),
g AS (SELECT row_number() OVER () AS k, r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) - 1 >= (SELECT least FROM low)),
f AS (SELECT * FROM g WHERE len(g) BETWEEN (SELECT least FROM low) AND (SELECT most FROM low)),
s AS (SELECT k, r, id, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM f JOIN known ON list_has_any(g, grams)),
hit AS (SELECT * FROM s WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, id) = 1),
best AS (SELECT r, count(*) AS n, first(id ORDER BY dice DESC, id) AS id, max(dice) AS dice, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY r),
n AS (SELECT r, count(*) AS n FROM f GROUP BY r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_units, coalesce(best.n, 0)::BIGINT AS n_matches, best.id AS license, coalesce(best.dice, 0.0)::DOUBLE AS dice, coalesce(best.ids, '') AS licenses
FROM d LEFT JOIN best ON best.r = d.r LEFT JOIN n ON n.r = d.r
"""


ORACLE_SQL["op9_licenses"] = _licenses()


def _rules(reach: float = 6.0, least: int = 100) -> str:
    from tessera.llm.quality_rules import RATIOS

    names = list(RATIOS)
    # a quantile is the smallest value that enough of the group's values reach
    group = lambda by, level: ", ".join(f"quantile_disc({x}, 0.25) AS {level}1_{x}, quantile_disc({x}, 0.75) AS {level}3_{x}" for x in names)
    pick = lambda x, q: f"CASE WHEN a.n >= {least} THEN a{q}_{x} WHEN b.n >= {least} THEN b{q}_{x} ELSE c{q}_{x} END"
    fence = ", ".join(f"{pick(x, 1)} AS q1_{x}, {pick(x, 3)} AS q3_{x}" for x in names)
    odd = " || ".join(f"CASE WHEN {x} > q3_{x} + greatest(q3_{x} - q1_{x}, {floor}) * {reach}" + (f" OR {x} < q1_{x} - greatest(q3_{x} - q1_{x}, {floor}) * {reach}" if low else "") + f" THEN '{x},' ELSE '' END" for x, (floor, low) in RATIOS.items())
    count = " + ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in "#*$%&|<>")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_GAP}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: trim(x, {_STRIP}) <> '') AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM twice GROUP BY r),
m AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  ({count})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper FROM w LEFT JOIN rep USING (r)),
x AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word,
  CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_share, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share FROM m),
a AS (SELECT lang, source, count(*) AS n, {group("lang, source", "a")} FROM x GROUP BY lang, source),
b AS (SELECT lang, count(*) AS n, {group("lang", "b")} FROM x GROUP BY lang),
c AS (SELECT {group("", "c")} FROM x),
f AS (SELECT a.lang, a.source, {fence} FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN c),
o AS (SELECT x.*, rtrim({odd}, ',') AS outlier, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outlier = '' AS kept, outlier FROM o
"""


ORACLE_SQL["op6_quality_rules"] = _rules()
