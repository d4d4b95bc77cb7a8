"""SQL of the join, resampling and trie queries, for a comparison on the same tables."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JOIN_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
tok AS MATERIALIZED (SELECT r, unnest(g) AS x FROM s),
held AS MATERIALIZED (SELECT r, x FROM tok WHERE x IN (SELECT x FROM tok GROUP BY x HAVING count(*) > 1)),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM held a JOIN held b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (SELECT a, b FROM met JOIN s one ON one.r = a JOIN s two ON two.r = b WHERE 100 * o >= 90 * (len(one.g) + len(two.g) - o)),
sides AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, t) AS (SELECT r, r FROM s UNION SELECT reach.r, sides.b FROM reach JOIN sides ON sides.a = reach.t)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id,
  CAST((SELECT count(*) FROM sides WHERE sides.a = reach.r) AS BIGINT) AS n_links
FROM reach JOIN s ON s.r = reach.r JOIN s o ON o.r = reach.t GROUP BY reach.r"""

#: CRC-32 by table: the 256 entries follow from the polynomial, one step per byte of the text ``f``.
CRC_TABLE = """(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]),
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i)))"""
CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST(
  (strpos('0123456789ABCDEF', substr(hex(encode(f)), CAST(2*i-1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(f)), CAST(2*i AS BIGINT), 1)) - 1 AS BIGINT)),
  lambda a, b: xor(a // 256, tb[CAST(xor(a % 256, b) + 1 AS BIGINT)])), 4294967295)"""

_WORDS = rf"coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_GRAMS = "list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)"

RESAMPLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest({_GRAMS}) AS f FROM d) GROUP BY r, f),
bf AS (SELECT unnest({_GRAMS}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
tab AS MATERIALIZED (SELECT {CRC_TABLE} AS tb),
code AS MATERIALIZED (SELECT f, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)), tab),
s AS MATERIALIZED (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM df JOIN code USING (f) GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM bf JOIN code USING (f) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000 AS sn, coalesce((SELECT sum(t) FROM t), 0) + 10000 AS tn),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * sn / ((s + 1) * tn))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM df JOIN code USING (f) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
  list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST(i AS BIGINT), 1)) - 1 AS BIGINT)),
    lambda a, b: a * 16 + b) AS h FROM d LEFT JOIN wt USING (r)),
sc AS MATERIALIZED (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS k, count(*) OVER () AS able FROM sc WHERE words >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN k <= 25 * able // 100 THEN k END AS BIGINT) AS rank FROM sc LEFT JOIN k USING (r)"""

TRIE_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS MATERIALIZED (SELECT {CRC_TABLE} AS tb),
c AS MATERIALIZED (SELECT conv_id, own, {CRC} % 9 AS h, conv_id - ((conv_id % 5) + 5) % 5 AS lender
  FROM (SELECT conv_id, max(pos) AS own, CAST(conv_id AS VARCHAR) AS f FROM t GROUP BY conv_id), tab),
b AS MATERIALIZED (SELECT c.conv_id, c.h, c.lender, least(c.h, coalesce(l.own, 0)) AS taken FROM c LEFT JOIN c l ON l.conv_id = c.lender),
r AS (SELECT b.conv_id, t.pos AS depth, role, text FROM b JOIN t ON t.conv_id = b.lender AND t.pos <= b.taken
  UNION ALL SELECT b.conv_id, t.pos - b.h + b.taken, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos > b.h
  UNION ALL SELECT conv_id, 0, NULL, '' FROM b),
k AS MATERIALIZED (SELECT conv_id, depth, octet_length(encode(text)) AS bytes, md5(array_to_string(list(coalesce(md5(length(role) || ':' || role || text), '')) OVER
  (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), ',')) AS key FROM r),
n AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM k GROUP BY key, depth),
up AS MATERIALIZED (SELECT n.*, p.key AS pkey FROM n LEFT JOIN k p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS MATERIALIZED (SELECT pkey AS key, count(*) AS children FROM up WHERE pkey IS NOT NULL GROUP BY pkey),
under AS (SELECT a.key, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE kids.key IS NULL) AS leaves
  FROM n LEFT JOIN kids USING (key) JOIN k a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM k
  JOIN (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id) USING (conv_id, depth) GROUP BY key)
SELECT up.conv_id, CAST(up.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(up.n AS BIGINT) AS n_convs, CAST(coalesce(children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM up LEFT JOIN n p ON p.key = up.pkey LEFT JOIN kids ON kids.key = up.key JOIN under ON under.key = up.key LEFT JOIN ends ON ends.key = up.key"""
