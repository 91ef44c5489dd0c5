"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
k AS (
  SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
t AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS stop FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY stop, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t),
f AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * max(level) OVER ()) AS target
  FROM l),
p AS (
  SELECT k.doc_id, k.size, f.source_size, f.target,
         CASE WHEN f.source_size > 0 THEN floor(f.target + 1e-6)::BIGINT // f.source_size ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target + 1e-6)::BIGINT - epochs * source_size - first)))::BIGINT AS taken
FROM p""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_host_quality": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d),
tri AS (
  SELECT doc_id, i, w[i:i+2] AS t FROM g),
rep AS (
  SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
q AS (
  SELECT sum(f) / sum(n) AS m, var_pop(f / n) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * avg(1 / n) AS v FROM h),
r AS (
  SELECT source, CASE WHEN v > 0 THEN (f + m * greatest(m * (1 - m) / v - 1, 0))
                                      / (n + greatest(m * (1 - m) / v - 1, 0)) ELSE m END AS host_rate
  FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR host_rate > 0.5) AS kept, host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + length(text) - length(replace(text, chr(92), ''))
           + len(regexp_extract_all(text,
             '</?s>|<[|]im_(start|end)[|]>|<</?SYS>>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
         ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS gram FROM d),
s AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  JOIN s p ON p.doc_id = x.doc_id JOIN s q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= 0.8),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (
  SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, c.doc_id = class_id AS is_first
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = c.doc_id""",
}
