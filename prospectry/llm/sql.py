"""The same results in SQL, where SQL can express them."""

SQL = {
    "op3_curriculum_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight FROM r),
l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY source_size / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_words,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS sharing
  FROM w),
c AS (SELECT *, left_words * weight > 3 * source_size * sharing AS capped FROM l),
f AS (
  SELECT left_words AS rate_left, sharing AS rate_sharing FROM c WHERE NOT capped
  ORDER BY source_size / weight, rank LIMIT 1),
t AS (
  SELECT source, source_size, rank,
    CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
      ELSE CAST(weight * rate_left AS DOUBLE) / rate_sharing END AS target
  FROM c CROSS JOIN f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (t.rank - 1) % 3 AS turn,
    CAST(floor(t.target) AS BIGINT) AS total,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN total // source_size ELSE 0 END AS epochs FROM p),
x AS (
  SELECT *, epochs * size + least(size, greatest(0, total - epochs * source_size - start)) AS taken,
    CASE WHEN target > 0 THEN start / target ELSE 0.0 END AS share
  FROM e)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN least(1.0, CASE turn
    WHEN 1 THEN CASE WHEN share < 0.5
      THEN 0.0 + share * 2.0 / (1.0 + sqrt(1.0))
      ELSE 0.5 + (share - 0.5) * 2.0 / (1.0 + sqrt(1.0)) END
    WHEN 0 THEN CASE WHEN share * 0.75 < 0.4375
      THEN 0.0 + (share * 0.75 - 0.0) * 2.0 / (1.0 + sqrt(1.0 + (share * 0.75 - 0.0) * -1.0))
      ELSE 0.5 + (share * 0.75 - 0.4375) * 2.0
        / (0.75 + sqrt(0.5625 + (share * 0.75 - 0.4375) * -1.0)) END
    ELSE CASE WHEN share * 0.75 < 0.3125
      THEN 0.0 + (share * 0.75 - 0.0) * 2.0 / (0.5 + sqrt(0.25 + (share * 0.75 - 0.0) * 1.0))
      ELSE 0.5 + (share * 0.75 - 0.3125) * 2.0
        / (0.75 + sqrt(0.5625 + (share * 0.75 - 0.3125) * 1.0)) END
    END) END AS first_position
FROM x
""",
    "op10_chat_template": r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
      '(<)(/?s>)|(\[)(/?(?:INST|TEXT)\]|OUT\]|ROLE\])', '\1\3\\\2\4', 'g') AS escaped,
    regexp_replace(replace(role, '\', '\\'),
      '(<)(/?s>)|(\[)(/?(?:INST|TEXT)\]|OUT\]|ROLE\])', '\1\3\\\2\4', 'g') AS escaped_role
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text)
      FILTER (WHERE role = 'assistant'), '') AS loss,
    3 + sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
      ELSE 23 + length(escaped_role) END) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d),
k AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN k USING (doc_id) GROUP BY part, mask),
l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order,
    [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM l v, l w, l x, l y, l z
  WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND (v.bit | w.bit | x.bit | y.bit | z.bit) = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (VALUES (1), (2), (3), (4), (5)) n(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
n AS (SELECT row_number() OVER () AS row_no, * FROM d),
e AS (SELECT row_no, lang, source, unnest(terms) AS term FROM n),
k AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (lang)),
o AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, g.v,
    sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n,
    sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang) AS lang_total
  FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (
  SELECT lang, source, term, n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM s),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
""",
}
