"""SQL twins (DuckDB) of the registered queries, where SQL can express them."""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

LLM_ORACLE["op3_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM turns
), roles AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq) AS spoken,
    coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS trained,
    sum(length('<turn ') + length(url_encode(role)) + 2
        + length(regexp_replace(text, '(\\*)(</turn>|<turn)', '\\\1\2', 'g')) + 9) AS formatted_chars,
    bool_and(CASE WHEN seq = 1 THEN role IN ('system', 'user') ELSE true END) AS opens,
    list(role ORDER BY seq) AS order_of
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(trained) AS loss_chars,
  sha256(trained) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  regexp_full_match(array_to_string(order_of, '>'),
    '(system>)?user>assistant(>(user|tool)>assistant)*') AS valid
FROM roles
"""

LLM_ORACLE["op4_quality_rules"] = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT doc_id, w, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM twice)
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), measures AS (
  SELECT b.doc_id, lang, source, len(w) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM base b JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols * 1000000 // greatest(word_chars, 1) AS v1, n_dup_lines * 1000000 // greatest(n_lines, 1) AS v2,
    n_repeat_words * 1000000 // greatest(n_words, 1) AS v3, word_chars * 1000 // greatest(n_words, 1) AS v4
  FROM measures
), vals AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS m, unnest([v1, v2, v3, v4]) AS v FROM judged WHERE NOT base_failed
), bins AS (
  SELECT lang, source, m, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket,
    count(*) AS n
  FROM vals GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, m, bucket, n FROM bins
  UNION ALL SELECT 2, lang, NULL, m, bucket, sum(n) FROM bins GROUP BY lang, m, bucket
  UNION ALL SELECT 3, NULL, NULL, m, bucket, sum(n) FROM bins GROUP BY m, bucket
), ranked AS (
  SELECT level, lang, source, m, bucket,
    sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, m) AS total,
    sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER (PARTITION BY level, lang, source, m ORDER BY bucket) AS upto_pos,
    sum(CASE WHEN bucket > 0 THEN n ELSE 0 END) OVER (PARTITION BY level, lang, source, m) AS total_pos
  FROM levels
), edges AS (
  SELECT level, lang, source, m, level = 3 OR (total >= 100 AND total_pos >= 20) AS enough,
    q1 - greatest(coalesce(spread, 0), 3 * (q3 - q1)) AS low, q3 + greatest(coalesce(spread, 0), 3 * (q3 - q1)) AS high
  FROM (SELECT level, lang, source, m, max(total) AS total, max(total_pos) AS total_pos,
          min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3,
          min(bucket) FILTER (bucket > 0 AND 100 * upto_pos >= 95 * total_pos)
            - min(bucket) FILTER (bucket > 0 AND 2 * upto_pos >= total_pos) AS spread
        FROM ranked GROUP BY level, lang, source, m)
), chosen AS (
  SELECT a.lang, a.source, a.m,
    CASE WHEN a.enough THEN a.low WHEN b.enough THEN b.low ELSE c.low END AS low,
    CASE WHEN a.enough THEN a.high WHEN b.enough THEN b.high ELSE c.high END AS high
  FROM edges a JOIN edges b ON a.level = 1 AND b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.m = b.m
  JOIN edges c ON c.level = 3 AND c.m = a.m
), broken AS (
  SELECT j.doc_id FROM judged j JOIN chosen t
    ON j.lang IS NOT DISTINCT FROM t.lang AND j.source IS NOT DISTINCT FROM t.source
  GROUP BY j.doc_id
  HAVING bool_or((t.m = 1 AND v1 > high) OR (t.m = 2 AND v2 > high) OR (t.m = 3 AND v3 > high)
    OR (t.m = 4 AND (v4 > high OR v4 < low)))
)
SELECT doc_id, lang, source, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  CAST(n_lines AS BIGINT) AS n_lines, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM judged
"""

LLM_ORACLE["op6_poisson_mixing"] = r"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rated AS (
  SELECT source, rate, greatest(ceil(rate / 16.0), 1) AS parts
  FROM (SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM counts)
          * (SELECT sum(n) FROM counts)::DOUBLE * 1.0::DOUBLE / n::DOUBLE AS rate FROM counts)
), terms AS (
  SELECT source, rate / parts AS rate, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < 80
), upto AS (SELECT source, list(c ORDER BY k) AS c FROM terms GROUP BY source
), draws AS (
  SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, unnest(range(1, CAST(r.parts AS BIGINT) + 1)) AS part
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), copies AS (
  SELECT doc_id, d.source, any_value(text) AS text, any_value(lang) AS lang, any_value(n_chars) AS n_chars,
    CAST(sum(len(list_filter(c, lambda x: x <= ('0x' || substr(md5('mix|' || doc_id || '|' || part), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE))) AS BIGINT) AS n_copies
  FROM draws d JOIN upto u ON d.source IS NOT DISTINCT FROM u.source GROUP BY doc_id, d.source
), each AS (
  SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM copies
)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
  md5('mix|deal|' || doc_id || '|' || copy_no) AS mix_key
FROM each
"""

LLM_ORACLE["op7_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
