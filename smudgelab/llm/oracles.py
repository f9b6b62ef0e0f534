"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
l AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '</?s>|<</?(?:SYS|ROLE)|\[/?INST\]')) AS inside,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17
      ELSE 21 + length(role) END AS marks
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(inside + marks)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
    ([5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)])::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER below, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level
  FROM s
  WINDOW below AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT level FROM l WHERE level * w <= most ORDER BY most / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * w, most))::DOUBLE AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
j AS (
  SELECT d.doc_id, d.source, d.size, d.u, r.source_size, r.target, floor(ratio) AS certain,
    ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS open_words
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM j),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS reached,
    sum(size) OVER (PARTITION BY source, rank, doc_id, size) AS same
  FROM k)
SELECT doc_id, size, source_size, target,
  (size * (certain + CASE WHEN rank IS NOT NULL AND open_words > 0 AND (reached < open_words
    OR (reached - same < open_words AND reached - open_words <= open_words - (reached - same)))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT i, unnest(l) AS w, generate_subscripts(l, 1) AS p
  FROM (SELECT i, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
x AS (
  SELECT i, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY i ORDER BY p)),
y AS (
  SELECT i, p FROM x WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY i, w, w2, w3) > 1),
z AS (
  SELECT i, count(DISTINCT q) AS n FROM (SELECT i, unnest([p, p + 1, p + 2]) AS q FROM y) GROUP BY i),
ws AS (
  SELECT i, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY i),
ln AS (
  SELECT i, count(*) AS n, count(DISTINCT line) AS differ
  FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
c AS (
  SELECT d.i, doc_id, lang, source, coalesce(ws.n, 0)::BIGINT AS n_words,
    coalesce(ws.chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(ln.n, 0)::BIGINT AS n_lines, coalesce(ln.n - ln.differ, 0)::BIGINT AS n_dup_lines,
    coalesce(z.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN ws ON d.i = ws.i LEFT JOIN ln ON d.i = ln.i LEFT JOIN z ON d.i = z.i),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
r AS (
  SELECT i, lang, source, base_failed, unnest(['symbols', 'lines', 'repeats', 'length']) AS rate,
    unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1),
      1000 * n_repeat_words // greatest(n_words, 1),
      least(20 * word_chars // greatest(n_words, 1), 2000)]) AS cell
  FROM b),
s AS (
  SELECT * FROM r WHERE NOT base_failed AND cell > 0),
og AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, rate ORDER BY cell) AS k,
    count(*) OVER (PARTITION BY lang, source, rate) AS n FROM s),
ol AS (
  SELECT *, row_number() OVER (PARTITION BY lang, rate ORDER BY cell) AS k,
    count(*) OVER (PARTITION BY lang, rate) AS n FROM s),
oa AS (
  SELECT *, row_number() OVER (PARTITION BY rate ORDER BY cell) AS k, count(*) OVER (PARTITION BY rate) AS n FROM s),
qa AS (
  SELECT rate, min(cell) FILTER (100 * k >= n) AS low, min(cell) FILTER (100 * k >= 99 * n) AS high
  FROM oa GROUP BY rate),
ql AS (
  SELECT lang, rate, max(n) AS n, min(cell) FILTER (100 * k >= n) AS low, min(cell) FILTER (100 * k >= 99 * n) AS high
  FROM ol GROUP BY lang, rate),
qg AS (
  SELECT lang, source, rate, max(n) AS n, min(cell) FILTER (100 * k >= n) AS low,
    min(cell) FILTER (100 * k >= 99 * n) AS high
  FROM og GROUP BY lang, source, rate),
fl AS (
  SELECT d.lang, qa.rate,
    (coalesce(ql.n, 0) * coalesce(ql.low, 0) + 200 * qa.low) // (coalesce(ql.n, 0) + 200) AS low,
    (coalesce(ql.n, 0) * coalesce(ql.high, 0) + 200 * qa.high) // (coalesce(ql.n, 0) + 200) AS high
  FROM (SELECT DISTINCT lang FROM b) d CROSS JOIN qa
  LEFT JOIN ql ON d.lang IS NOT DISTINCT FROM ql.lang AND qa.rate = ql.rate),
fg AS (
  SELECT d.lang, d.source, fl.rate,
    (coalesce(qg.n, 0) * coalesce(qg.low, 0) + 200 * fl.low) // (coalesce(qg.n, 0) + 200) AS low,
    (coalesce(qg.n, 0) * coalesce(qg.high, 0) + 200 * fl.high) // (coalesce(qg.n, 0) + 200) AS high
  FROM (SELECT DISTINCT lang, source FROM b) d JOIN fl ON d.lang IS NOT DISTINCT FROM fl.lang
  LEFT JOIN qg ON d.lang IS NOT DISTINCT FROM qg.lang AND d.source IS NOT DISTINCT FROM qg.source AND fl.rate = qg.rate),
v AS (
  SELECT r.i, bool_and(r.cell <= f.high AND (r.rate <> 'length' OR r.cell >= f.low)) AS within
  FROM r JOIN fg f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source AND r.rate = f.rate
  GROUP BY r.i)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(within, TRUE) AS kept
FROM b LEFT JOIN v ON b.i = v.i
"""

AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
k AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m GROUP BY part, fails),
l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM l v, l w, l x, l y, l z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f,
    substr(filter_order, 1, step - 1) AS earlier
  FROM o, range(1, 6) t(step)),
x AS (
  SELECT *, contains(fails, f) AS here, translate(earlier, fails, '') <> earlier AS gone FROM s, c),
y AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y
"""

HARD_NEGATIVES = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {
    "op3_chat_format": CHAT,
    "op4_pareto_mix": MIX,
    "op6_quality_rules": QUALITY,
    "op11_filter_audit": AUDIT,
    "op13_hard_negatives": HARD_NEGATIVES,
}
