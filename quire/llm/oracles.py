"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return "list_filter(regexp_split_to_array(" + _LOWER.format(f"coalesce({text}, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


OP2 = """
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS t,
         CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616::UHUGEINT - (-doc_id)::UHUGEINT ELSE coalesce(doc_id, 0)::UHUGEINT END AS k0
  FROM documents),
walk AS (
  SELECT r, n, 0::BIGINT AS spot, 0::BIGINT AS ahead, k0 AS k FROM base, (VALUES (8), (9)) AS s(n)
  UNION ALL
  SELECT r, n, ahead,
         CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST(((k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT) // 8589934592::UHUGEINT + 1 AS DOUBLE))) AS BIGINT),
         (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT
  FROM walk WHERE ahead < n),
shards AS (SELECT r, n, max(spot) AS shard FROM walk GROUP BY r, n),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t8),
crcs AS (SELECT r, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                lambda c, b: xor(t8[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32 FROM base, crc_table),
placed AS (SELECT b.doc_id, b.size, c.text_crc32, CAST(s.shard AS INTEGER) AS shard, CAST(g.shard AS INTEGER) AS grown_shard
           FROM base b JOIN crcs c USING (r) JOIN shards s ON s.r = b.r AND s.n = 8 JOIN shards g ON g.r = b.r AND g.n = 9)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY (((coalesce(doc_id, 0) % 4096 + 4096) % 4096 + text_crc32) % 4096), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM placed
"""

OP5 = rf"""
WITH b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
x AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g))),
h AS (SELECT x.r, x.i, x.k, g.item_id FROM x JOIN g ON x.p = g.p AND x.k = g.k),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM d),
x AS (SELECT r, unnest(s) AS t FROM s),
n AS (SELECT r, len(s) AS n FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM x a JOIN x b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b WHERE 100 * p.both >= 90 * (na.n + nb.n - p.both)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON w.a = reach.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.a = s.r JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""

# base32 of a SHA-1: its 160 bits in 32 groups of five.
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hx FROM p),
b AS (SELECT hx, n, max(page_id) AS first_id FROM q GROUP BY hx, n),
bits AS (SELECT DISTINCT hx, array_to_string(list_transform(regexp_extract_all(hx, '.'), lambda c: list_extract(
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], CAST('0x' || c AS INTEGER) + 1)), '') AS s FROM q),
digest AS (SELECT hx, array_to_string(list_transform(regexp_extract_all(s, '.....'), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(g[1] AS INTEGER) + 8 * CAST(g[2] AS INTEGER) + 4 * CAST(g[3] AS INTEGER) + 2 * CAST(g[4] AS INTEGER) + CAST(g[5] AS INTEGER) AS INTEGER), 1)), '') AS d FROM bits)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, digest.d AS payload_digest,
       CASE WHEN q.page_id IS NOT DISTINCT FROM b.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN q.page_id IS NOT DISTINCT FROM b.first_id THEN NULL ELSE b.first_id END AS refers_to
FROM q JOIN b USING (hx, n) JOIN digest USING (hx)
"""
