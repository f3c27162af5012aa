"""Registered query: scored search in the query language, ten shapes of query over the words of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.text import words
from larkspur.operators import lexquery, sparse
from larkspur.plans import retrieval as R
from larkspur.plans.registry import query
from larkspur.sources import bindings as S

#: Query text by shape, in words a, b, c and e of an item, and what it means in SQL: leaves
#: (name, words, slop, boost), when a sentence satisfies it, and its score (L: a leaf's units, null where it does not hold).
SHAPES = [
    ("{a} {b}^2 {c}", [("P", "a", 0, 1), ("Q", "b", 0, 2), ("R", "c", 0, 1)], "P > 0 OR Q > 0 OR R > 0", "P + Q + R"),
    ('"{a} {b}"^1.5 {c}', [("P", "a, b", 0, 1.5), ("Q", "c", 0, 1)], "P > 0 OR Q > 0", "P + Q"),
    ("+{a} -{b} {c}", [("P", "a", 0, 1), ("Q", "b", 0, 1), ("R", "c", 0, 1)], "P > 0 AND Q = 0", "P + R"),
    ("{a} AND {b} OR {c}", [("P", "a", 0, 1), ("Q", "b", 0, 1), ("R", "c", 0, 1)], "(P > 0 AND Q > 0) OR R > 0", "CASE WHEN P > 0 AND Q > 0 THEN P + Q ELSE 0 END + R"),
    ("({a} OR {b}) AND {c}", [("P", "a", 0, 1), ("Q", "b", 0, 1), ("R", "c", 0, 1)], "(P > 0 OR Q > 0) AND R > 0", "P + Q + R"),
    ('"{a} {c}"~3', [("P", "a, c", 3, 1)], "P > 0", "P"),
    ("{a} AND NOT ({b} OR {c})", [("P", "a", 0, 1), ("Q", "b", 0, 1), ("R", "c", 0, 1)], "P > 0 AND Q = 0 AND R = 0", "P"),
    ('({a} OR "{b} {c}")^2 {e}', [("P", "a", 0, 2), ("Q", "b, c", 0, 2), ("R", "e", 0, 1)], "P > 0 OR Q > 0 OR R > 0", "P + Q + R"),
    ("{a} AND ({b} OR {c}", [("P", "a", 0, 1), ("Q", "b", 0, 1), ("R", "c", 0, 1)], "(P > 0 AND Q > 0) OR R > 0", "CASE WHEN P > 0 AND Q > 0 THEN P + Q ELSE 0 END + R"),
    ('-{c} +({a} {b})^0.5 "{a} {b} {e}"~9', [("P", "a", 0, 0.5), ("Q", "b", 0, 0.5), ("R", "c", 0, 1), ("S", "a, b, e", 9, 1)], "(P > 0 OR Q > 0) AND R = 0", "P + Q + S"),
]

_LEAVES = " UNION ALL ".join(
    f"SELECT query_id, shape, '{name}' AS leaf, [{ws}] AS ws, {slop} AS slop, {boost}::DOUBLE AS boost FROM asked WHERE shape = {i}"
    for i, (_, leaves, _, _) in enumerate(SHAPES) for name, ws, slop, boost in leaves
)
_HOLDS = " ".join(f"WHEN {i} THEN {holds}" for i, (_, _, holds, _) in enumerate(SHAPES))
_UNITS = " ".join(f"WHEN {i} THEN {units}" for i, (_, _, _, units) in enumerate(SHAPES))
_SQL = f"""{S.sql('live', 'queries')}, {R._SENT}, {R._POST}, {R._COLL},
    df AS (SELECT tenant_id, term, count(*) AS df FROM post GROUP BY ALL),
    qw AS (SELECT query_id, query_id % {len(SHAPES)} AS shape, {R.WORDS.format('query')} AS w FROM queries),
    asked AS (SELECT query_id, shape, coalesce(w[1], 'the') AS a, coalesce(w[2], 'the') AS b, coalesce(w[3], 'the') AS c, coalesce(w[4], 'the') AS e FROM qw),
    leaf AS ({_LEAVES}),
    start AS (
        SELECT l.query_id, l.shape, l.leaf, l.ws, l.slop, l.boost, t.tenant_id, t.chunk_id, t.sentence_idx, t.tokens, p AS p1
        FROM leaf l JOIN post ON post.term = l.ws[1] JOIN tok t USING (tenant_id, chunk_id, sentence_idx), unnest(range(1, len(t.tokens) + 1)) AS r(p)
        WHERE t.tokens[p] = l.ws[1]
    ),
    second AS (SELECT *, CASE WHEN len(ws) > 1 THEN p1 + nullif(list_position(tokens[p1 + 1:], ws[2]), 0) ELSE p1 END AS p2 FROM start),
    third AS (SELECT *, CASE WHEN len(ws) > 2 THEN p2 + nullif(list_position(tokens[p2 + 1:], ws[3]), 0) ELSE p2 END AS p3 FROM second),
    tf AS (
        SELECT query_id, shape, leaf, ws, boost, tenant_id, chunk_id, sentence_idx, len(any_value(tokens)) AS dl, count(*) AS tf
        FROM third WHERE p3 - p1 - (len(ws) - 1) <= slop GROUP BY ALL
    ),
    idf AS (
        SELECT query_id, leaf, tenant_id, list_sum(list(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) ORDER BY i)) AS idf
        FROM leaf, unnest(range(1, len(ws) + 1)) AS r(i), df JOIN coll USING (tenant_id) WHERE df.term = ws[i] GROUP BY ALL
    ),
    units AS (
        SELECT query_id, shape, tenant_id, chunk_id, sentence_idx, leaf, CAST(round(boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 1e9) AS BIGINT) AS u
        FROM tf JOIN idf USING (query_id, leaf, tenant_id) JOIN coll USING (tenant_id)
    ),
    held AS (
        SELECT query_id, shape, tenant_id, chunk_id, sentence_idx, {', '.join(f"coalesce(max(u) FILTER (leaf = '{x}'), 0) AS {x}" for x in 'PQRS')} FROM units GROUP BY ALL
    ),
    scored AS (SELECT query_id, tenant_id, chunk_id, sentence_idx, CASE shape {_UNITS} END / 1e9 AS score FROM held WHERE CASE shape {_HOLDS} END)
    SELECT query_id, tenant_id, chunk_id, sentence_idx, {R.SIX} AS score, rank FROM (SELECT *, {R._TOPQ} AS rank FROM scored) WHERE rank <= 10"""


@query("parsed_search_scored", _SQL)
def parsed_search_scored(spark: SparkSession, d: str) -> DataFrame:
    """The ten best sentences of each tenant for a query of each shape in turn, in words of the items of ``benchmark``."""
    asked = S.queries(spark, d).withColumn("w", words(F.col("query")))
    named = asked.select("query_id", *(F.coalesce(F.get("w", F.lit(i)), F.lit("the")).alias(x) for i, x in enumerate("abce")))
    text = F.element_at(F.array(*(F.lit(shape) for shape, *_ in SHAPES)), (F.col("query_id") % len(SHAPES) + 1).cast("int"))
    for x in "abce":
        text = F.replace(text, F.lit("{" + x + "}"), F.col(x))
    found = lexquery.search_of(sparse.sentences(S.live(spark, d)), named.select("query_id", text.alias("query")), 10)
    return found.select("query_id", "tenant_id", "chunk_id", "sentence_idx", R._score(), "rank")
