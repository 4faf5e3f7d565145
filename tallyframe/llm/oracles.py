"""DuckDB twins of the registered queries that SQL can express."""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s),
o AS (
  SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS full_at,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clamped,
         CAST(sum(weight) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free
  FROM w),
l AS (SELECT max((total - clamped) / CAST(free AS DOUBLE)) AS level FROM o WHERE (total - clamped) / CAST(free AS DOUBLE) <= full_at),
t AS (
  SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM o, l),
p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 3) END AS repeats FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.repeats, greatest(0, CAST(round_even(p.target, 0) AS BIGINT) - p.repeats * p.source_size) AS fraction,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * repeats + least(greatest(fraction - before, 0), size) AS BIGINT) AS taken FROM c
"""

#: The checksum is computed byte by byte from the table of its polynomial.
OP8 = """
WITH c AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         CAST('0x' || substr(md5('29:' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h,
         CAST('0x' || substr(md5('29:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hid,
         count(*) OVER (PARTITION BY source) AS n_source
  FROM documents),
b AS (
  SELECT d.*, least(CAST(floor(CAST(h AS DOUBLE) / 1152921504606846976 * ((n_source + 499) // 500)) AS BIGINT), (n_source + 499) // 500 - 1) AS b, g.ids
  FROM d LEFT JOIN (SELECT source AS s2, h AS h2, count(DISTINCT hid) AS ids FROM d GROUP BY ALL) g ON d.source IS NOT DISTINCT FROM g.s2 AND d.h = g.h2),
r AS (
  SELECT *, CASE WHEN ids > 500 THEN h ELSE -1 END AS long_text,
         CASE WHEN ids > 500 THEN least(CAST(floor(CAST(hid AS DOUBLE) / 1152921504606846976 * ((ids + 499) // 500)) AS BIGINT), (ids + 499) // 500 - 1) ELSE 0 END AS sub
  FROM b),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY b, long_text, sub, h, doc_id NULLS FIRST) - CAST(0.5 AS DOUBLE)) / n_source AS frac FROM r),
p AS (
  SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM f),
s AS (SELECT *, CAST(pos * 8 // n AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                       lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
       'rows' AS law, shard, CAST(pos - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, c
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3, "op4_mixing": OP4, "op8_sharding": OP8, "op10_exact_dedup": OP10}
