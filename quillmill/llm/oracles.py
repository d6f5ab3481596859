"""DuckDB SQL for the queries of this package that SQL can express."""

#: The measures of op6 in SQL; the sketches' buckets and cutoffs follow from them by whole-number arithmetic.
OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
pos AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
win AS (SELECT rid, i, word || chr(1) || lead(word, 1) OVER p || chr(1) || lead(word, 2) OVER p AS s FROM pos WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) > 1 AS dup FROM win WHERE s IS NOT NULL),
covered AS (SELECT DISTINCT rid, i + k AS i FROM twice, range(0, 3) r(k) WHERE dup),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
lined AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, d.doc_id, d.lang, d.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN words w USING (rid) LEFT JOIN rep r USING (rid) LEFT JOIN lined l USING (rid)),
s AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (word_chars * 100) // greatest(n_words, 1) AS m_length, (n_symbols * 1000) // greatest(n_words, 1) AS m_symbols, (n_dup_lines * 1000) // greatest(n_lines, 1) AS m_dup, (n_repeat_words * 1000) // greatest(n_words, 1) AS m_repeat FROM m),
v AS (SELECT lang, source, unnest(['m_length', 'm_symbols', 'm_dup', 'm_repeat']) AS measure, unnest([m_length, m_symbols, m_dup, m_repeat]) AS v FROM s WHERE NOT base_failed),
p AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS power FROM v),
b AS (SELECT lang, source, measure, (((v >> power)) << power) AS low, count(*) AS n FROM p GROUP BY ALL),
lev AS (
  SELECT 0 AS level, lang, source, measure, low, n FROM b
  UNION ALL SELECT 1, lang, NULL, measure, low, sum(n) FROM b GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, low, sum(n) FROM b GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM lev),
t(measure, tail, spread) AS (VALUES ('m_length', 75, 10), ('m_symbols', 75, 8), ('m_dup', 99, 2), ('m_repeat', 99, 2)),
q AS (
  SELECT level, lang, source, measure, min(tail) AS tail, min(spread) AS spread, max(total) AS docs, min(CASE WHEN upto * 100 >= total * (100 - tail) THEN low END) AS q_low,
    min(CASE WHEN upto * 100 >= total * 50 THEN low END) AS q_mid, min(CASE WHEN upto * 100 >= total * tail THEN low END) AS q_high FROM run JOIN t USING (measure) GROUP BY level, lang, source, measure),
cut AS (
  SELECT o.level, o.lang, o.source, o.measure, o.docs, o.q_high + o.spread * greatest(o.q_high - o.q_mid, w.q_high - w.q_mid, 1 << greatest(length(bin(o.q_high)) - 6, 0)) AS high,
    o.q_low - o.spread * greatest(o.q_mid - o.q_low, w.q_mid - w.q_low, 1 << greatest(length(bin(o.q_high)) - 6, 0)) AS low
  FROM q o LEFT JOIN q w ON o.level = 0 AND o.tail >= 99 AND w.level = 1 AND w.docs >= 30 AND o.lang IS NOT DISTINCT FROM w.lang AND o.measure = w.measure),
wide AS (SELECT level, lang, source, max(docs) AS docs, max(high) FILTER (measure = 'm_length') AS c1, max(high) FILTER (measure = 'm_symbols') AS c2, max(high) FILTER (measure = 'm_dup') AS c3, max(high) FILTER (measure = 'm_repeat') AS c4, max(low) FILTER (measure = 'm_length') AS c5 FROM cut GROUP BY ALL),
picked AS (
  SELECT a.lang, a.source, unnest([CASE WHEN a.docs >= 30 THEN a ELSE CASE WHEN b.docs >= 30 THEN b ELSE c END END]) AS x
  FROM (SELECT * FROM wide WHERE level = 0) a LEFT JOIN (SELECT * FROM wide WHERE level = 1) b ON a.lang IS NOT DISTINCT FROM b.lang LEFT JOIN (SELECT * FROM wide WHERE level = 2) c ON true)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  NOT s.base_failed AND coalesce(m_length <= x.c1, true) AND coalesce(m_symbols <= x.c2, true) AND coalesce(m_dup <= x.c3, true) AND coalesce(m_repeat <= x.c4, true) AND coalesce(m_length >= x.c5, true) AS kept
FROM s LEFT JOIN picked ON s.lang IS NOT DISTINCT FROM picked.lang AND s.source IS NOT DISTINCT FROM picked.source
"""

#: op12: each document's failing letters, their counts for each part, and every order walked step by step.
OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN words.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM failing GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.l <> b.l AND a.l <> c.l AND a.l <> d.l AND a.l <> e.l AND b.l <> c.l AND b.l <> d.l AND b.l <> e.l AND c.l <> d.l AND c.l <> e.l AND d.l <> e.l),
met AS (SELECT part, o, fails, n, g, x, CASE WHEN contains(fails, substr(o, 1, 1)) THEN 1 WHEN contains(fails, substr(o, 2, 1)) THEN 2 WHEN contains(fails, substr(o, 3, 1)) THEN 3 WHEN contains(fails, substr(o, 4, 1)) THEN 4 WHEN contains(fails, substr(o, 5, 1)) THEN 5 ELSE 6 END AS first FROM counts, orders),
step AS (SELECT *, substr(o, step, 1) AS own FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
walk AS (
  SELECT part, o AS filter_order, step, own, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN first < step AND contains(fails, own) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN x ELSE 0 END) AS toxic_lost
  FROM step GROUP BY part, o, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM walk
"""
