"""DuckDB SQL for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = "regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
bw AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
bwin AS (SELECT item_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM bw, unnest(generate_series(1, len(w) - m + 1)) AS t(k)),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM dw, (SELECT DISTINCT m FROM bwin), unnest(generate_series(1, len(w) - m + 1)) AS t(i)),
hits AS (SELECT doc_id, item_id, m, i, i - k AS diagonal FROM dwin JOIN bwin USING (m, s)),
places AS (SELECT DISTINCT doc_id, p FROM (SELECT DISTINCT doc_id, i, m FROM hits), unnest(generate_series(i, i + m - 1)) AS t(p)),
spans AS (SELECT doc_id, count(*) AS n, min(p) - 1 AS s, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM places) GROUP BY doc_id, g),
pos AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hit, string_agg(s || ':' || e, ',' ORDER BY s) AS hit_spans FROM spans GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, max(n) AS longest, arg_max(s, n * 100000000 - s) AS longest_at FROM (SELECT doc_id, count(*) - 1 + max(m) AS n, min(i) - 1 AS s FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS g FROM hits) GROUP BY doc_id, item_id, diagonal, g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_spans, '') AS hit_spans, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN runs USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(node, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM edges) UNION SELECT b, root FROM reach JOIN edges ON node = a),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = w.doc_id
"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS m
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.m, b.m) AS BIGINT) AS score
    FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
),
positive AS (SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

# CRC-32 of each distinct run, bit by bit: a byte (two hex digits) is taken in, then eight steps (-1) follow
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(x) // 2), lambda i: [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

IMPORTANCE = f"""
WITH words AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents
    UNION ALL SELECT 'b', NULL, row_number() OVER (), {_WORDS.format('text')} FROM benchmark
),
runs AS (
    SELECT side, r, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM words, (VALUES (1), (2), (3)) AS orders(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i)
),
counted AS (SELECT side, r, s, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT s, {_CRC} % 10000 AS bucket FROM (SELECT s, hex(s) AS x FROM (SELECT DISTINCT s FROM counted))),
buckets AS (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counted JOIN hashed USING (s) GROUP BY bucket
),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM buckets) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM buckets) + 10000)::DOUBLE))) AS BIGINT) AS g FROM buckets
),
weight AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN hashed USING (s) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
    SELECT doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weight USING (r) WHERE side = 'd'
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN eligible AND row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) <= 5 * (SELECT count(*) FROM scored WHERE eligible) // 100
        THEN row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) END AS rank
FROM scored
"""
