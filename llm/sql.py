"""DuckDB counterparts of the queries that SQL can express."""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM grams, range(0, 3) AS r(k) WHERE n > 1 GROUP BY rid),
m AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (
  SELECT rid, lang, source, base_failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeat_words']) AS ratio,
         unnest([1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(n_words, 1),
                 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS v,
         unnest([2500, 100, 200, 150]) AS floor_
  FROM b),
s AS (
  SELECT lang, source, ratio, floor_,
         CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 8 + (v // (1 << (length(bin(v)) - 4))::BIGINT) END AS bucket,
         count(*) AS n
  FROM r WHERE NOT base_failed GROUP BY ALL),
levels AS (
  SELECT 1 AS lv, lang, source, ratio, bucket, n FROM s
  UNION ALL SELECT 2, lang, NULL, ratio, bucket, sum(n) FROM s GROUP BY lang, ratio, bucket
  UNION ALL SELECT 3, NULL, NULL, ratio, bucket, sum(n) FROM s GROUP BY ratio, bucket),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, ratio ORDER BY bucket) AS below,
         sum(n) OVER (PARTITION BY lv, lang, source, ratio) AS total FROM levels),
q AS (
  SELECT lv, lang, source, ratio, max(total) AS total,
         min(bucket) FILTER (below * 4 >= total) AS b1, min(bucket) FILTER (below * 4 >= total * 3) AS b3
  FROM cum GROUP BY ALL),
low AS (
  SELECT lv, lang, source, ratio, total,
         CASE WHEN b1 < 16 THEN b1 ELSE (b1 - (b1 // 8 - 1) * 8) * (1 << (b1 // 8 - 1)::INT) END AS q1,
         CASE WHEN b3 < 16 THEN b3 ELSE (b3 - (b3 // 8 - 1) * 8) * (1 << (b3 // 8 - 1)::INT) END AS q3
  FROM q),
fence AS (
  SELECT o.lang, o.source, o.ratio, f.floor_ + CASE
           WHEN o.total >= 40 THEN o.q3 + 3 * (o.q3 - o.q1)
           WHEN l.total >= 40 THEN l.q3 + 3 * (l.q3 - l.q1)
           ELSE g.q3 + 3 * (g.q3 - g.q1) END AS fence
  FROM low o JOIN low l ON l.lv = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio
  JOIN low g ON g.lv = 3 AND g.ratio = o.ratio
  JOIN (SELECT DISTINCT ratio, floor_ FROM s) f ON f.ratio = o.ratio
  WHERE o.lv = 1),
wide AS (
  SELECT lang, source, max(fence) FILTER (ratio = 'word_length')::BIGINT AS fence_word_length,
         max(fence) FILTER (ratio = 'symbols')::BIGINT AS fence_symbols,
         max(fence) FILTER (ratio = 'dup_lines')::BIGINT AS fence_dup_lines,
         max(fence) FILTER (ratio = 'repeat_words')::BIGINT AS fence_repeat_words
  FROM fence GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(1000 * word_chars // greatest(n_words, 1) > fence_word_length, false)
         AND NOT coalesce(1000 * n_symbols // greatest(n_words, 1) > fence_symbols, false)
         AND NOT coalesce(1000 * n_dup_lines // greatest(n_lines, 1) > fence_dup_lines, false)
         AND NOT coalesce(1000 * n_repeat_words // greatest(n_words, 1) > fence_repeat_words, false) AS kept,
       fence_word_length, fence_symbols, fence_dup_lines, fence_repeat_words
FROM b LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM b.lang AND wide.source IS NOT DISTINCT FROM b.source
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
      FROM o, range(1, 4) AS s(size) WHERE i + size - 1 <= len(ws)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.n AS l, r.n AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, part, max(n) AS longer FROM (
        SELECT lang, n, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
        FROM f WHERE size = 3) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.part = b.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT z.lang, rank, phrase, a, l, r, t.n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""
