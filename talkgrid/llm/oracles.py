"""DuckDB statements for the training-data queries that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.c)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS g FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION SELECT item_id, 10, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) FROM b WHERE len(w) >= 10
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, ks WHERE len(w) >= k),
h AS (SELECT DISTINCT doc_id, item_id, i, dw.k FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
ww AS (SELECT DISTINCT k, g, string_split(g, ' ') AS l FROM bw WHERE k >= 2),
wj AS (SELECT g, k, unnest(l) AS t, unnest(range(0, k)) AS j FROM ww),
wr AS (SELECT g, k, arg_min(t, (coalesce(n, 0), t, j)) AS t, arg_min(j, (coalesce(n, 0), t, j)) AS j FROM wj LEFT JOIN (SELECT t, count(*) AS n FROM dp GROUP BY 1) USING (t) GROUP BY g, k),
nc AS (SELECT DISTINCT dp.doc_id, wr.g, dp.i - wr.j + o AS st FROM wr JOIN dp ON dp.t = wr.t, (SELECT unnest(range(-3, 4)) AS o)),
nr AS (SELECT DISTINCT nc.doc_id, bw.item_id FROM nc JOIN d ON d.doc_id = nc.doc_id JOIN ww ON ww.g = nc.g JOIN bw ON bw.g = nc.g AND bw.k = ww.k WHERE st >= 1 AND st + ww.k - 1 <= len(w)
  AND len(list_filter(range(0, ww.k), lambda j: list_contains(w[greatest(1, st + j - 3) : least(len(w), st + j + 3)], l[j + 1]))) = ww.k),
nn AS (SELECT doc_id, count(*) AS n_near FROM nr ANTI JOIN h USING (doc_id, item_id) GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, (SELECT unnest(range(10)) AS o) WHERE o < k GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, n FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents) WHERE n > 0),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS tok FROM d GROUP BY 1), g AS (SELECT CAST(sum(tok) AS DOUBLE) AS total, count(*) AS k, CAST(min(tok) AS DOUBLE) AS least FROM s),
z AS (SELECT a, sum(pow(tok / total, a / 4096.0)) AS s0, sum(pow(tok / total, a / 4096.0) * ln(tok / total)) AS s1 FROM (SELECT unnest(range(4097)) AS a), s, g GROUP BY a),
e AS (SELECT greatest(coalesce(max(a) FILTER (ln(s0) - a / 4096.0 * s1 / s0 >= 0.97 * ln(k) - 1e-9), 0), coalesce(min(a) FILTER (pow(least / total, a / 4096.0 - 1) / s0 <= 4.0 + 1e-9), 4096)) / 4096.0 AS alpha FROM z, g),
w AS (SELECT source, tok, pow(tok / total, alpha) / (SELECT sum(pow(tok / total, alpha)) FROM s, g, e) AS weight, CAST(ceil(sqrt(CAST(tok AS DOUBLE))) AS BIGINT) AS blocks FROM s, g, e),
p AS (SELECT *, CAST(floor(weight * total + 1e-6) AS BIGINT) AS due FROM w, g),
q AS (SELECT source, tok, weight, blocks, due // tok AS whole, due - due // tok * tok AS rest FROM p),
x AS (SELECT d.*, q.weight, q.whole, q.rest, md5('mix|' || CAST(doc_id AS VARCHAR)) AS place, q.blocks FROM d JOIN q USING (source)),
y AS (SELECT *, CAST('0x' || substr(place, 1, 8) AS BIGINT) % blocks AS block FROM x),
b AS (SELECT source, block, sum(n) AS size, any_value(rest) AS rest, md5('mix|block|' || source || '|' || CAST(block AS VARCHAR)) AS mark FROM y GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mark, block) AS block_rank, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM b),
v AS (SELECT y.*, o.block_rank, o.free, o.size, sum(n) OVER (PARTITION BY y.source, y.block ORDER BY place, doc_id, n ROWS UNBOUNDED PRECEDING) AS seen FROM y JOIN o ON o.source = y.source AND o.block = y.block),
c AS (SELECT *, whole + CASE WHEN free >= size OR (free > 0 AND seen <= free) THEN 1 ELSE 0 END AS copies FROM v)
SELECT doc_id, source, n AS n_tokens, unnest(range(1, copies + 1)) AS epoch, round(weight, 9) AS weight, CAST(block_rank AS BIGINT) AS block_rank, place FROM c
"""
