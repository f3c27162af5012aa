"""Registered queries: text functions, lexical and dense retrieval, fusion, packing, search API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.functions import text as T, times, vectors as V
from larkspur.operators import dense, fusion, lexquery, ranking, search, sparse
from larkspur.plans.registry import query
from larkspur.sources import bindings as S
from larkspur.tables import written

NOW = S.EPOCH + 400 * S.HOUR
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
CODE = " OR ".join(f"contains(t, '{m}')" for m in T.CODE_MARKERS)


def _six(score: str) -> str:
    """SQL (for both engines but for the division of whole numbers) of a score in whole units, to six decimals, halves up."""
    return f"((CAST(round({score} * 1e9) AS BIGINT) + 500) {{div}} 1000) / 1e6"


def _score() -> Column:
    return F.expr(_six("score").format(div="div")).alias("score")


SIX = _six("score").format(div="//")


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


@query(
    "is_code_line",
    f"""WITH {LINES}, cut AS (SELECT doc_id, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN t <> '' AND (({CODE}) OR regexp_matches(t, '^(async )?function ')
        OR (regexp_matches(line, '^(    |\\t)') AND regexp_matches(t, '[=(.]'))
        OR (t[-1] IN ('{{', '}}', ';', ')', ',') AND (NOT contains(t, ' ') OR (contains(t, '(') AND contains(t, ')'))))) THEN 1 ELSE 0 END) AS BIGINT) AS n_code FROM cut GROUP BY doc_id""",
)
def is_code_line(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.when(T.is_code_line(F.col("line")), 1).otherwise(0)).alias("n_code"))


_PIECES = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s_.,;:!?''\"(){}\\[\\]<>=+\\-*/\\\\|&^%$#@~`]+'), lambda x: x <> '')"
_PARTS = f"flatten(list_transform({_PIECES}, lambda w: list_filter(string_split(regexp_replace(regexp_replace(w, '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1~\\2', 'g'), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1~\\2', 'g'), '~'), lambda y: y <> '')))"


@query(
    "token_stats",
    f"""WITH t AS (SELECT doc_id, {_PARTS} AS parts FROM documents)
        SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_tokens, CAST(len(list_filter(parts, lambda x: regexp_full_match(x, '\\p{{Ll}}+'))) AS BIGINT) AS n_prose,
        CAST(len(list_filter(parts, lambda x: regexp_full_match(x, '[A-Z]'))) AS BIGINT) AS n_mixed,
        CAST(len(list_filter(parts, lambda x: NOT regexp_full_match(x, '\\p{{Ll}}+') AND NOT regexp_full_match(x, '[A-Z]'))) AS BIGINT) AS n_code FROM t""",
)
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    toks = S.table(spark, d, "documents").select("doc_id", T.code_tokens(F.col("text")).alias("t"))

    def n(kind: str):
        return F.size(F.filter("t", lambda x: x["token_type"] == kind)).cast("bigint")

    return toks.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), n("prose").alias("n_prose"), n("mixed").alias("n_mixed"), n("code").alias("n_code"))


@query(
    "camel_tokens",
    f"WITH t AS (SELECT doc_id, unnest({_PARTS}) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token",
)
def camel_tokens(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.explode(F.filter(F.split(F.coalesce("text", F.lit("")), T.SEPARATORS), lambda x: x != ""))
    words = S.table(spark, d, "documents").select(pieces.alias("w")).groupBy("w").agg(F.count("*").alias("c"))  # each distinct word is split once
    return words.select(F.explode(T.camel_parts(F.col("w"))).alias("token"), "c").groupBy("token").agg(F.sum("c").alias("n"))


@query(
    "validate_ids",
    "SELECT DISTINCT url, regexp_matches(url, '^[A-Za-z0-9_]+$') AS tenant_ok, regexp_matches(url, '^[A-Za-z0-9_-]+$') AS episode_ok FROM (SELECT url FROM pages UNION ALL SELECT source FROM documents UNION ALL SELECT o_orderpriority FROM orders)",
)
def validate_ids(spark: SparkSession, d: str) -> DataFrame:
    names = S.table(spark, d, "pages").select("url").union(S.table(spark, d, "documents").select("source")).union(S.table(spark, d, "orders").select("o_orderpriority")).distinct()
    return names.select("url", T.valid_tenant(F.col("url")).alias("tenant_ok"), T.valid_episode(F.col("url")).alias("episode_ok"))


@query(
    "l2_normalize",
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))",
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = S.table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("mock_embed")
def mock_embed(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", V.mock_embedding(F.col("text"), 16).alias("embedding"))


@query(
    "parse_iso",
    "SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN epoch_us(ts) // 1000 - 1e13 < 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso FROM events",
)
def parse_iso(spark: SparkSession, d: str) -> DataFrame:
    iso = S.table(spark, d, "events").select("event_id", times.format_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))
    return iso.select("event_id", times.parse_iso(F.col("iso")).alias("ms"), "iso")


# --- lexical ---------------------------------------------------------------------------

_SENT = "sent AS (SELECT tenant_id, chunk_id, i - 1 AS sentence_idx, line AS text FROM (SELECT tenant_id, chunk_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM live) WHERE trim(line) <> '')"
_POST = f"tok AS (SELECT tenant_id, chunk_id, sentence_idx, {WORDS.format('text')} AS tokens FROM sent), post AS (SELECT tenant_id, chunk_id, sentence_idx, term, count(*) AS tf, CAST(max(dl) AS BIGINT) AS dl FROM (SELECT tenant_id, chunk_id, sentence_idx, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL)"
_COLL = "coll AS (SELECT tenant_id, count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT DISTINCT tenant_id, chunk_id, sentence_idx, dl FROM post) GROUP BY tenant_id)"
_SCORED = f"df AS (SELECT tenant_id, term, count(*) AS df FROM post GROUP BY ALL), qt AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM queries), scored AS (SELECT query_id, tenant_id, chunk_id, sentence_idx, sum(CAST(round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 1e9) AS BIGINT)) / 1e9 AS score FROM post JOIN qt USING (term) JOIN df USING (tenant_id, term) JOIN coll USING (tenant_id) GROUP BY ALL)"
_BM25 = f"{S.sql('live', 'queries')}, {_SENT}, {_POST}, {_COLL}, {_SCORED}"
_TOPQ = "row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY round(score, 9) DESC, chunk_id, sentence_idx)"


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return sparse.index(sparse.sentences(S.live(spark, d)))


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return sparse.bm25_top_of(sparse.sentences(S.live(spark, d)), S.queries(spark, d), k)


@query("bm25_index", f"{S.sql('live')}, {_SENT}, {_POST} SELECT tenant_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY ALL")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("tenant_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_stats", f"{S.sql('live')}, {_SENT}, {_POST}, {_COLL} SELECT tenant_id, n_docs, round(avgdl, 6) AS avgdl FROM coll")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return sparse.collection(_postings(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_topk", f"{_BM25} SELECT query_id, tenant_id, chunk_id, sentence_idx, {SIX} AS score, rank FROM (SELECT *, {_TOPQ} AS rank FROM scored) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 10).select("query_id", "tenant_id", "chunk_id", "sentence_idx", _score(), "rank")


@query("doc_count", f"{S.sql('live')}, {_SENT} SELECT tenant_id, count(*) AS n_sentences, count(DISTINCT chunk_id) AS n_chunks FROM sent GROUP BY tenant_id")
def doc_count(spark: SparkSession, d: str) -> DataFrame:
    return sparse.sentences(S.live(spark, d)).groupBy("tenant_id").agg(F.count("*").alias("n_sentences"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("bm25_delete", f"{S.sql('chunks')}, live AS (SELECT * FROM chunks), {_SENT}, {_POST} SELECT tenant_id, count(*) AS n_postings FROM post WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.status = 'deleted' AND c.tenant_id = post.tenant_id AND c.chunk_id = post.chunk_id) GROUP BY tenant_id")
def bm25_delete(spark: SparkSession, d: str) -> DataFrame:
    every = S.chunks(spark, d)
    return sparse.delete(sparse.index(sparse.sentences(every)), every.where("status = 'deleted'")).groupBy("tenant_id").agg(F.count("*").alias("n_postings"))


@query("substring_search", f"{S.sql('live')} SELECT tenant_id, chunk_id, 1.0::DOUBLE AS score FROM live WHERE contains(lower(text), 'thor')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return sparse.substring(S.live(spark, d), "Thor").select("tenant_id", "chunk_id", "score")


_HAS = "contains(' ' || array_to_string(tokens, ' ') || ' ', ' {0} ')"


@query("parsed_search", f"{S.sql('live')}, {_SENT}, tok AS (SELECT *, {WORDS.format('text')} AS tokens FROM sent) SELECT tenant_id, chunk_id, sentence_idx FROM tok WHERE ({_HAS.format('and the')} OR ({_HAS.format('is')} AND {_HAS.format('in')} AND NOT {_HAS.format('to')})) AND NOT {_HAS.format('of')}")
def parsed_search(spark: SparkSession, d: str) -> DataFrame:
    rows = sparse.sentences(S.live(spark, d))
    return lexquery.matching(rows, '"and the"^2 (is AND in NOT to OR +is AND +in AND -to) NOT of').select("tenant_id", "chunk_id", "sentence_idx")


# --- dense -------------------------------------------------------------------------------

_PAIR = "list_cosine_similarity"


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return S.vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", "embedding")


@query("cosine_pairs", f"{S.sql('vectors')} SELECT q.vec_id AS query_id, v.vec_id, round({_PAIR}(q.embedding, v.embedding), 6) AS score FROM vectors q JOIN vectors v ON q.tenant_id = v.tenant_id WHERE q.vec_id % 50 = 0")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dense.pairs(S.vectors(spark, d), _vector_queries(spark, d)).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_DENSE = f"dense AS (SELECT query_id, tenant_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.tenant_id, v.vec_id, round({_PAIR}(q.embedding, v.embedding), 9) AS score FROM vectors q, vectors v WHERE q.vec_id % 50 = 0))"


@query("dense_topk", f"{S.sql('vectors')}, {_DENSE} SELECT query_id, tenant_id, vec_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.topk(S.vectors(spark, d), _vector_queries(spark, d), 10).select("query_id", "tenant_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("lsh_buckets")
def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return dense.lsh_bucket(S.vectors(spark, d)).select("vec_id", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("index_stats", f"{S.sql('vectors')} SELECT tenant_id, count(*) AS n_vectors, max(len(embedding)) AS dim, count(*) * max(len(embedding)) * 8 AS bytes FROM vectors GROUP BY tenant_id")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return dense.index_stats(S.vectors(spark, d))


# --- fusion, ranking, packing --------------------------------------------------------------
# Dense list: chunks and queries have the vector of their number, where the vector table has it; sparse list: sentences, several a chunk.

_VECTORS = f"dv AS (SELECT l.tenant_id, l.chunk_id, CAST(v.embedding AS DOUBLE[]) AS embedding FROM live l JOIN embeddings v ON CAST(v.vec_id AS VARCHAR) = l.chunk_id), qv AS (SELECT q.query_id, CAST(v.embedding AS DOUBLE[]) AS embedding FROM queries q JOIN embeddings v ON v.vec_id = q.query_id), near AS (SELECT query_id, tenant_id, chunk_id, round({_PAIR}(qv.embedding, dv.embedding), 9) AS score FROM qv, dv)"
_CHANNELS = f"{_VECTORS}, dlist AS (SELECT query_id, tenant_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= 20), slist AS (SELECT query_id, tenant_id, chunk_id, score, rank FROM (SELECT *, {_TOPQ} AS rank FROM scored) WHERE rank <= 20)"
_FUSED = f"fused AS (SELECT query_id, tenant_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(CASE WHEN l = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN l = 'sparse' THEN rank END) AS sparse_rank FROM (SELECT query_id, tenant_id, chunk_id, rank, 'dense' AS l FROM dlist UNION ALL SELECT query_id, tenant_id, chunk_id, rank, 'sparse' FROM slist) GROUP BY query_id, tenant_id, chunk_id)"
_ALL = f"{_BM25}, {_CHANNELS}, {_FUSED}"
_ORDER = "row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY round(score, 12) DESC, chunk_id)"


def _vector_lists(spark: SparkSession, d: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors of chunks and those of queries, whose number they have."""
    vectors = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    chunks = S.live(spark, d).select("tenant_id", "chunk_id").join(vectors.withColumn("vec_id", F.col("vec_id").cast("string")), F.col("chunk_id") == F.col("vec_id"))
    return chunks, asked.select("query_id").join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.lit(None).cast("string").alias("tenant_id"), "embedding")


def _lists(spark: SparkSession, d: str, k: int = 20, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse list of every query (those of ``benchmark`` unless given) and tenant."""
    asked = S.queries(spark, d) if asked is None else asked
    chunks, questions = _vector_lists(spark, d, asked)
    near = dense.topk(chunks, questions, k, "chunk_id", each_tenant=True)
    found = sparse.bm25_top_of(sparse.sentences(S.live(spark, d)), asked, k)
    return written(near, "near"), written(found, "found")  # k rows a query and tenant, which several steps read


@query("rrf_fuse", f"{_ALL} SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, dense_rank, sparse_rank FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rrf(*_lists(spark, d), by=("query_id", "tenant_id", "chunk_id")).withColumn("score", F.round("score", 6))


# Both lists whole: every chunk with a vector and every sentence with a word of the query has its rank.
_WHOLE_LISTS = f"{_BM25}, {_CHANNELS.replace(' WHERE rank <= 20', '')}, {_FUSED}"


@query("hybrid_search", f"{_WHOLE_LISTS} SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_ORDER} AS rank FROM fused) WHERE rank <= 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    asked, live = S.queries(spark, d), S.live(spark, d)
    vectors, questions = _vector_lists(spark, d, asked)
    return fusion.whole(live, vectors, asked, questions, 10).select("query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("tiered_search", f"{_BM25}, {_CHANNELS.replace('rank <= 20), slist', 'rank <= 10), slist')}, {_FUSED}, any_words AS (SELECT DISTINCT query_id, tenant_id FROM slist), both_lists AS (SELECT query_id, tenant_id, chunk_id, score FROM fused SEMI JOIN any_words USING (query_id, tenant_id) UNION ALL SELECT query_id, tenant_id, chunk_id, score FROM dlist ANTI JOIN any_words USING (query_id, tenant_id)) SELECT query_id, tenant_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_ORDER} AS rank FROM both_lists) WHERE rank <= 10")
def tiered_search(spark: SparkSession, d: str) -> DataFrame:
    return search.tiered(*_lists(spark, d), k=10).select("query_id", "tenant_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_RECENCY = f"exp(-ln(2) * greatest(({NOW}::DOUBLE - timestamp_created) / 86400000.0::DOUBLE, 0) / 7)"


@query("rerank", f"{_ALL} SELECT query_id, tenant_id, chunk_id, round(score + 0.1 * {_RECENCY} + 0.2 * CASE WHEN project_id = 'en' THEN 1 ELSE 0 END + 0.05 * CASE WHEN chunk_type = 'doc' THEN 1 ELSE 0 END, 6) AS final_score FROM fused JOIN live USING (tenant_id, chunk_id)")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.rrf(*_lists(spark, d), by=("query_id", "tenant_id", "chunk_id"))
    meta = S.live(spark, d).select("tenant_id", "chunk_id", "timestamp_created", "project_id", "chunk_type")
    out = ranking.rerank(fused.join(meta, ["tenant_id", "chunk_id"]), NOW, F.lit("en"), ("doc",))
    return out.select("query_id", "tenant_id", "chunk_id", F.round("final_score", 6).alias("final_score"))


@query("recency_decay", f"{S.sql('chunks')} SELECT chunk_id, round({_RECENCY}, 6) AS recency FROM chunks")
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("chunk_id", F.round(ranking.recency(F.col("timestamp_created"), NOW), 6).alias("recency"))


_RANKED = f"ranked AS (SELECT f.query_id, f.tenant_id, f.chunk_id, f.score, l.text, l.hash, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f.chunk_id) AS rank FROM fused f JOIN live l ON f.tenant_id = l.tenant_id AND f.chunk_id = l.chunk_id)"


def _ranked(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """The fused list of every query with what its chunks need: texts stay where they are, their hash, bytes and ``more`` go on."""
    fused = ranking.rrf(*_lists(spark, d), by=("query_id", "tenant_id", "chunk_id")).withColumn("score", F.round("score", 12))
    rows = fused.join(S.live(spark, d).select("tenant_id", "chunk_id", "hash", "chunk_type", F.octet_length("text").alias("n_bytes"), *more), ["tenant_id", "chunk_id"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query("pack_hash_dedup", f"{_ALL}, {_RANKED} SELECT query_id, hash, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, hash ORDER BY rank) AS n FROM ranked) WHERE n = 1")
def pack_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hash_dedup(_ranked(spark, d)).select("query_id", "hash", "chunk_id")


@query("pack_budget", f"{_ALL}, {_RANKED} SELECT query_id, chunk_id, rank, CAST(ceil(used / 4.0) AS BIGINT) AS used_tokens FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked) WHERE used <= 16000")
def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    return ranking.budget(_ranked(spark, d)).select("query_id", "chunk_id", "rank", "used_tokens")


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, V.mock_embedding(F.col("text"), 16).cast("array<float>").alias("embedding"))


@query("similarity_dedup")
def similarity_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ranking.similarity_dedup(_embedded(spark, d)).select("query_id", "tenant_id", "chunk_id")


@query("mmr_select")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mmr(_embedded(spark, d), 20).select("query_id", "tenant_id", "chunk_id", "mmr_rank")


@query("pack")
def pack(spark: SparkSession, d: str) -> DataFrame:
    rows = _embedded(spark, d)
    return ranking.pack_counters(rows, ranking.pack(rows))


# --- search API ----------------------------------------------------------------------------


@query("search_filters", f"{S.sql('live')} SELECT tenant_id, chunk_id FROM live WHERE project_id = 'en' AND chunk_type IN ('doc', 'code') AND timestamp_created BETWEEN {S.EPOCH + 100 * S.HOUR} AND {S.EPOCH + 700 * S.HOUR}")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    return search.filters(S.live(spark, d), "en", ("doc", "code"), start=S.EPOCH + 100 * S.HOUR, end=S.EPOCH + 700 * S.HOUR).select("tenant_id", "chunk_id")


_WHOLE = _BM25.replace(_SENT, "sent AS (SELECT tenant_id, chunk_id, 0 AS sentence_idx, text FROM live)")


@query("search", f"{_WHOLE}, r AS (SELECT s.query_id, s.chunk_id, s.score, l.hash, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, s.chunk_id) AS rank FROM scored s JOIN live l ON s.tenant_id = l.tenant_id AND s.chunk_id = l.chunk_id WHERE l.project_id = 'en') SELECT query_id, chunk_id, rank, {SIX} AS score, chunk_id || ':' || substr(hash, 1, 12) AS citation_id, FALSE AS repaired FROM r WHERE rank <= 20")
def search_query(spark: SparkSession, d: str) -> DataFrame:
    chunks = S.chunks(spark, d)
    whole = sparse.whole(S.live(spark, d))

    def run(queries: DataFrame, pool: DataFrame) -> DataFrame:
        found = written(sparse.bm25_top_of(whole, queries, 100, pool), "found")  # 100 rows a query and tenant
        return sparse.top(found.drop("rank"), 100, tie=("chunk_id",))

    found = search.search(S.queries(spark, d), chunks, run, 20, project="en")
    cited = search.cite(found.join(S.live(spark, d), ["tenant_id", "chunk_id"]))
    return cited.select("query_id", "chunk_id", "rank", _score(), F.col("citation.citation_id").alias("citation_id"), "repaired")


@query("adaptive_fetch_k", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 100 WHEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) >= 6 OR strlen(text) >= 80 THEN least(greatest(2 * 15, 1), 100) ELSE 15 END AS fetch_k FROM benchmark")
def adaptive_fetch_k(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select("item_id", T.adaptive_fetch_k(F.col("text"), F.lit(15), F.col("item_id") % 3 == 0).alias("fetch_k"))


@query("query_repair", "SELECT item_id, CASE WHEN fixed <> '' AND fixed <> text THEN fixed END AS repaired FROM (SELECT item_id, text, lower(trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS fixed FROM benchmark)")
def query_repair(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select("item_id", T.repair_query(F.col("text")).alias("repaired"))


@query("citation", f"{S.sql('chunks')} SELECT chunk_id, chunk_id || ':' || substr(hash, 1, 12) AS citation_id, path AS source_path, project_id FROM chunks")
def citation(spark: SparkSession, d: str) -> DataFrame:
    return search.cite(S.chunks(spark, d)).select("chunk_id", F.col("citation.citation_id").alias("citation_id"), F.col("citation.source_path").alias("source_path"), "project_id")


@query("episode_extract", f"{S.sql('messages')} SELECT chunk_id, substr(list_filter(tags, lambda t: starts_with(t, 'episode:'))[1], 9) AS episode_id FROM messages")
def episode_extract(spark: SparkSession, d: str) -> DataFrame:
    return S.messages(spark, d).select("chunk_id", T.episode_of(F.col("tags")).alias("episode_id"))


@query("get", f"{S.sql('live')} SELECT tenant_id, chunk_id, hash FROM live WHERE tenant_id = 'src1' AND chunk_id = '1'")
def get(spark: SparkSession, d: str) -> DataFrame:
    return search.get(S.chunks(spark, d), "src1", "1").select("tenant_id", "chunk_id", "hash")


@query("list_chunks", f"{S.sql('live')} SELECT tenant_id, chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp_created DESC, chunk_id) AS position FROM live) WHERE position > 5 AND position <= 25")
def list_chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.list_chunks(S.chunks(spark, d), 20, 5).select("tenant_id", "chunk_id", "position")


@query("delete_visible", f"{S.sql('live')}, tomb AS (SELECT DISTINCT doc_id AS k FROM labels WHERE toxic = 1) SELECT tenant_id, count(*) AS n FROM live WHERE CAST(chunk_id AS BIGINT) NOT IN (SELECT k FROM tomb) GROUP BY tenant_id")
def delete_visible(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of deletion at once: the status, and tombstones (here the toxic documents)."""
    every = S.chunks(spark, d)
    gone = S.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    tombs = every.join(gone, "chunk_id", "left_semi")
    return search.live(every, tombs).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("stats", f"{S.sql('chunks')} SELECT tenant_id, count(*) AS total, CAST(sum(CASE WHEN status = 'deleted' THEN 0 ELSE 1 END) AS BIGINT) AS active, CAST(sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN status <> 'deleted' AND chunk_type = 'doc' THEN 1 ELSE 0 END) AS BIGINT) AS n_doc FROM chunks GROUP BY tenant_id")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return search.stats(S.chunks(spark, d)).select("tenant_id", "total", "active", "deleted", F.coalesce(F.col("types")["doc"], F.lit(0)).alias("n_doc"))


@query(
    "consolidate_episode",
    f"{S.sql('messages')}, k AS (SELECT *, substr(tags[1], 9) AS episode_id, row_number() OVER (PARTITION BY tags[1] ORDER BY timestamp_created DESC, chunk_id) AS n FROM messages) SELECT episode_id, count(*) AS n_sources, 'Episode ' || episode_id || ' summary (' || count(*) || ' chunks):' || chr(10) || string_agg('- [' || chunk_type || '] ' || substr(trim(replace(coalesce(text, ''), chr(10), ' ')), 1, 180), chr(10) ORDER BY timestamp_created, chunk_id) AS text FROM k WHERE n <= 50 GROUP BY episode_id",
)
def consolidate_episode(spark: SparkSession, d: str) -> DataFrame:
    return search.consolidate(S.messages(spark, d)).select("episode_id", "n_sources", "text")


@query("tenant_list", f"{S.sql('chunks')} SELECT DISTINCT tenant_id FROM chunks WHERE regexp_matches(tenant_id, '^[A-Za-z0-9_]+$')")
def tenant_list(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("tenant_id").where(T.valid_tenant(F.col("tenant_id"))).distinct()
