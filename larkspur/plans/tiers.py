"""Registered queries: semantic cache, hot tier, maintenance and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions import vectors as V
from larkspur.operators import maintenance as M, tiered as T
from larkspur.plans.registry import query
from larkspur.sources import bindings as S

NOW = S.EPOCH + 31 * 24 * S.HOUR

# cache entries: every vector with an even id, queries: every vector with an odd one, projects by parity of the label's digit
_ENTRIES = f"entries AS (SELECT CAST(vec_id AS VARCHAR) AS entry_id, tenant_id, CASE WHEN vec_id % 4 = 0 THEN 'p' END AS project_id, embedding, vec_id % 5 AS memory_version, {NOW} - vec_id * 60000 AS created_at, 0.5 AS confidence, [CAST(vec_id AS VARCHAR), CAST(vec_id + 1 AS VARCHAR)] AS result_ids FROM vectors WHERE vec_id % 2 = 0)"
_ASKED = "asked AS (SELECT vec_id AS query_id, tenant_id, CASE WHEN vec_id % 4 = 1 THEN 'p' END AS project_id, embedding FROM vectors WHERE vec_id % 2 = 1)"
_LIVE = f"created_at > {NOW - T.TTL_MS}"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d).where("vec_id % 2 = 0")
    return v.select(F.col("vec_id").cast("string").alias("entry_id"), "tenant_id", F.when(F.col("vec_id") % 4 == 0, "p").alias("project_id"), F.col("embedding").alias("query_embedding"), (F.col("vec_id") % 5).alias("memory_version"), (F.lit(NOW) - F.col("vec_id") * 60000).alias("created_at"), F.lit(0.5).alias("confidence"), F.array(F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")).alias("result_ids"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d).where("vec_id % 2 = 1")
    return v.select(F.col("vec_id").alias("query_id"), "tenant_id", F.when(F.col("vec_id") % 4 == 1, "p").alias("project_id"), "embedding")


_LOOKUP = f"hits AS (SELECT query_id, entry_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM (SELECT a.query_id, e.entry_id, round(list_cosine_similarity(a.embedding, e.embedding), 9) AS similarity FROM asked a JOIN entries e ON a.tenant_id = e.tenant_id AND a.project_id IS NOT DISTINCT FROM e.project_id WHERE e.{_LIVE}) WHERE similarity >= 0.85)"


@query("cache_lookup", f"{S.sql('vectors')}, {_ENTRIES}, {_ASKED}, {_LOOKUP} SELECT a.query_id, h.entry_id, round(h.similarity, 6) AS similarity, CASE WHEN h.entry_id IS NULL THEN NULL ELSE 0.6::DOUBLE END AS confidence FROM asked a LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (query_id)")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    found = T.cache_lookup(asked, _entries(spark, d), NOW)
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"), "confidence")


@query("cache_insert", f"{S.sql('vectors')}, {_ENTRIES}, {_ASKED} SELECT tenant_id, count(*) AS n FROM (SELECT tenant_id, entry_id FROM entries WHERE {_LIVE} UNION SELECT DISTINCT tenant_id, coalesce(project_id, '') || CAST(embedding AS VARCHAR) FROM asked) GROUP BY tenant_id")
def cache_insert(spark: SparkSession, d: str) -> DataFrame:
    new = _asked(spark, d).select("tenant_id", "project_id", F.col("embedding").alias("query_embedding"), F.lit(0).cast("bigint").alias("memory_version"), F.lit(NOW).cast("bigint").alias("created_at"), F.lit(0.5).alias("confidence"), F.array(F.lit("0")).alias("result_ids"))
    return T.cache_insert(_entries(spark, d), new, NOW).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("cache_invalidate", f"{S.sql('vectors')}, {_ENTRIES} SELECT entry_id, tenant_id FROM entries WHERE tenant_id <> '3' AND memory_version >= 1 AND NOT EXISTS (SELECT 1 FROM documents WHERE list_contains(result_ids, CAST(doc_id AS VARCHAR)) AND doc_id % 7 = 0)")
def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    gone = S.chunks(spark, d).where("status = 'deleted'")
    return T.cache_invalidate(_entries(spark, d), "3", 1, gone).select("entry_id", "tenant_id")


@query("cache_stats", f"{S.sql('vectors')}, {_ENTRIES}, {_ASKED}, {_LOOKUP} SELECT (SELECT count(*) FROM asked) AS lookups, (SELECT count(*) FROM hits WHERE n = 1) AS hits, (SELECT count(*) FROM asked) - (SELECT count(*) FROM hits WHERE n = 1) AS misses, (SELECT count(*) FROM entries WHERE NOT {_LIVE}) AS expirations, (SELECT avg(confidence) FROM entries WHERE {_LIVE})::DOUBLE AS avg_confidence")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    found = asked.select("query_id").join(T.cache_lookup(asked, _entries(spark, d), NOW), "query_id", "left")
    return T.cache_stats(found, _entries(spark, d), NOW)


_STATS = "st AS (SELECT chunk_id, count(*) AS access_count, min(timestamp_ms) AS first_access, max(timestamp_ms) AS last_access, sum(CASE WHEN project_id = 'click' THEN 1 ELSE 0 END) AS clicks FROM access_log GROUP BY chunk_id)"
_SCORE = f"sc AS (SELECT *, 0.4 * log2(access_count + 1) / (SELECT greatest(max(log2(access_count + 1)), 1) FROM st) + 0.4 * exp(-greatest(({NOW}::DOUBLE - last_access) / 3600000.0::DOUBLE, 0) / 24) + CASE WHEN clicks > 0 THEN 0.2 ELSE 0 END AS promotion_score FROM st WHERE access_count >= 2)"


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return T.access_stats(S.access_log(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return T.promotion_scores(_stats(spark, d), NOW, "click")


@query("access_stats", f"{S.sql('access_log')}, {_STATS} SELECT chunk_id, access_count, first_access, last_access, CAST(clicks AS BIGINT) AS clicks FROM st")
def access_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("chunk_id", "access_count", "first_access", "last_access", F.coalesce(F.col("project_hits")["click"], F.lit(0)).alias("clicks"))


@query("promotion_score", f"{S.sql('access_log')}, {_STATS}, {_SCORE} SELECT chunk_id, round(promotion_score, 6) AS promotion_score FROM sc")
def promotion_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("chunk_id", F.round("promotion_score", 6).alias("promotion_score"))


@query("top_candidates", f"{S.sql('access_log')}, {_STATS}, {_SCORE} SELECT chunk_id, round(promotion_score, 6) AS promotion_score FROM sc ORDER BY round(promotion_score, 9) DESC, chunk_id LIMIT 20")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.top_candidates(_scored(spark, d), 20).select("chunk_id", F.round("promotion_score", 6).alias("promotion_score"))


@query("decay_all", f"{S.sql('access_log')}, {_STATS} SELECT chunk_id, round(decay, 6) AS decay FROM (SELECT chunk_id, exp(-greatest(({NOW}::DOUBLE - last_access) / 3600000.0::DOUBLE, 0) / 24) AS decay FROM st) WHERE decay >= 0.01")
def decay_all(spark: SparkSession, d: str) -> DataFrame:
    return T.decay_all(_stats(spark, d), NOW).select("chunk_id", F.round("decay", 6).alias("decay"))


_HOT = "hot AS (SELECT chunk_id FROM st WHERE CAST(chunk_id AS BIGINT) % 3 = 0)"


def _hot(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).where("cast(chunk_id as bigint) % 3 = 0").select("chunk_id")


@query("promotions", f"{S.sql('access_log')}, {_STATS}, {_SCORE}, {_HOT} SELECT chunk_id FROM sc WHERE round(promotion_score, 9) >= 0.4 AND chunk_id NOT IN (SELECT chunk_id FROM hot)")
def promotions(spark: SparkSession, d: str) -> DataFrame:
    return T.promotions(_scored(spark, d), _hot(spark, d)).select("chunk_id")


@query("demotions", f"{S.sql('access_log')}, {_STATS.replace('access_log GROUP', chr(39).join(['access_log WHERE timestamp_ms < ', '']).replace(chr(39), '') + str(S.EPOCH + 3 * 24 * S.HOUR) + ' GROUP')}, {_SCORE.replace('WHEN clicks > 0', 'WHEN FALSE')}, {_HOT} SELECT h.chunk_id FROM hot h LEFT JOIN sc USING (chunk_id) WHERE coalesce(round(promotion_score, 9), 0) < 0.2")
def demotions(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the log's first three days, seen at the end of the month."""
    stats = T.access_stats(S.access_log(spark, d).where(F.col("timestamp_ms") < S.EPOCH + 3 * 24 * S.HOUR))
    hot = stats.where("cast(chunk_id as bigint) % 3 = 0").select("chunk_id")
    return T.demotions(T.promotion_scores(stats, NOW), hot, 1000)


@query("promote_on_access", f"{S.sql('access_log')}, {_STATS}, {_SCORE} SELECT chunk_id FROM sc WHERE round(promotion_score, 9) >= 0.4 AND clicks > 0")
def promote_on_access(spark: SparkSession, d: str) -> DataFrame:
    return T.promote_on_access(_scored(spark, d), S.access_log(spark, d), "click").select("chunk_id")


@query("hot_evict", f"{S.sql('access_log')}, {_STATS}, {_SCORE} SELECT chunk_id FROM sc ORDER BY round(promotion_score, 9) DESC, chunk_id LIMIT CAST(trunc(least((SELECT count(*) FROM documents) * 0.1, 50000)) AS BIGINT)")
def hot_evict(spark: SparkSession, d: str) -> DataFrame:
    return T.evict(_scored(spark, d), S.table(spark, d, "documents").count()).select("chunk_id")


_MERGE_SQL = "cand AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding, v.embedding), 9) AS score FROM vectors q, vectors v WHERE q.vec_id % 50 = 0), best AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN 'hot' ELSE 'warm' END AS tier FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best)"


def _tiers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from larkspur.operators import dense

    asked = S.vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", "embedding")
    rename = lambda df: df.select("query_id", F.col("vec_id").alias("chunk_id"), "score")
    every = S.vectors(spark, d)
    return rename(dense.topk(every.where("vec_id % 3 = 0"), asked, 10)), rename(dense.topk(every, asked, 10))


@query("hot_search", f"{S.sql('vectors')}, {_MERGE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM best WHERE tier = 'hot') WHERE n <= 10")
def hot_search(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d)[0].withColumn("score", F.round("score", 6))


@query("tier_merge", f"{S.sql('vectors')}, {_MERGE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, tier, rank FROM r WHERE rank <= 10")
def tier_merge(spark: SparkSession, d: str) -> DataFrame:
    return T.merge(*_tiers(spark, d), k=10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "tier", "rank")


# --- maintenance -----------------------------------------------------------------------------

_LOG = "wal AS (SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'add' WHEN event_type = 'purchase' THEN 'delete' WHEN event_type = 'error' AND event_id = (SELECT max(event_id) // 2 FROM events) THEN 'checkpoint' ELSE 'noop' END AS op, 'ops' AS tenant_id, CAST(user_id AS VARCHAR) AS chunk_id, props AS payload FROM events), mark AS (SELECT coalesce(max(CASE WHEN op = 'checkpoint' THEN seq END), -1) AS done FROM wal)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    half = e.agg(F.expr("max(event_id) div 2").alias("half"))
    op = F.when(F.col("event_type").isin("view", "click", "signup"), "add").when(F.col("event_type") == "purchase", "delete").when((F.col("event_type") == "error") & (F.col("event_id") == F.col("half")), "checkpoint").otherwise("noop")
    return e.join(F.broadcast(half), F.lit(True)).select(F.col("event_id").alias("seq"), op.alias("op"), F.lit("ops").alias("tenant_id"), F.col("user_id").cast("string").alias("chunk_id"), F.col("props").alias("payload"))


@query("wal_replay", f"WITH {_LOG} SELECT chunk_id, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, chunk_id ORDER BY seq DESC) AS n FROM wal, mark WHERE seq > done AND op IN ('add', 'delete')) WHERE n = 1 AND op = 'add'")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    return M.wal_replay(_log(spark, d)).select("chunk_id", "seq", "payload")


@query("metadata_upsert", f"{S.sql('access_log')} SELECT chunk_id, max(timestamp_ms) AS timestamp_ms FROM access_log GROUP BY chunk_id")
def metadata_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = S.access_log(spark, d).select("chunk_id", "timestamp_ms")
    cut = S.EPOCH + 10 * 24 * S.HOUR
    return M.upsert(log.where(F.col("timestamp_ms") < cut), log.where(F.col("timestamp_ms") >= cut), ("chunk_id",), "timestamp_ms")


@query("compaction_metrics", f"{S.sql('chunks')} SELECT tenant_id, total, deleted, round(deleted / total, 6) AS tombstone_ratio, round(greatest(total - n_cached, 0) / total, 6) AS staleness, n_segments, (deleted / total > 0.2 OR n_segments > 10 OR greatest(total - n_cached, 0) / total > 0.15) AS needs_compaction FROM (SELECT tenant_id, count(*) AS total, CAST(sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN CAST(chunk_id AS BIGINT) % 5 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cached, CAST(ceil(count(*) / 10000.0) AS BIGINT) AS n_segments FROM chunks GROUP BY tenant_id)")
def compaction_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    cached = c.where("cast(chunk_id as bigint) % 5 > 0").groupBy("tenant_id").agg(F.count("*").alias("n_cached"))
    segments = c.groupBy("tenant_id").agg(F.ceil(F.count("*") / 10000).alias("n_segments"))
    out = M.compaction_metrics(c, cached, segments)
    return out.withColumn("tombstone_ratio", F.round("tombstone_ratio", 6)).withColumn("staleness", F.round("staleness", 6))


@query("tombstone_audit", f"{S.sql('chunks')} SELECT count(*) AS leaked FROM (SELECT chunk_id FROM chunks WHERE status <> 'deleted' INTERSECT SELECT chunk_id FROM chunks WHERE status = 'deleted')")
def tombstone_audit(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    return M.tombstone_audit(c.where("status <> 'deleted'"), c.where("status = 'deleted'")).agg(F.count("*").alias("leaked"))


def _at(p: int) -> str:
    return f"list_sort(list(duration_ms))[CAST(floor({p} * (count(*) - 1) / 100) AS BIGINT) + 1]"


@query("latency_stats", f"{S.sql('tool_traces')} SELECT tool_name, count(*) AS n, round(avg(duration_ms), 6) AS mean, {_at(50)} AS p50, {_at(90)} AS p90, {_at(99)} AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY timestamp_ms DESC, trace_id DESC) AS n FROM tool_traces) WHERE n <= 1000 GROUP BY tool_name")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_stats(S.tool_traces(spark, d)).withColumn("mean", F.round("mean", 6))


def _suite(p: int) -> str:
    return f"list_sort(list(duration_ms))[CAST(least(floor(count(*) * {p / 100}::DOUBLE), count(*) - 1) AS BIGINT) + 1]"


@query("suite_percentiles", f"{S.sql('tool_traces')} SELECT tool_name, {_suite(50)} AS p50, {_suite(90)} AS p90, {_suite(99)} AS p99 FROM tool_traces GROUP BY tool_name")
def suite_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.suite_percentiles(S.tool_traces(spark, d), "tool_name", "duration_ms")


@query("recent_metrics", f"{S.sql('tool_traces')} SELECT tool_name, trace_id, position FROM (SELECT *, row_number() OVER (PARTITION BY tool_name ORDER BY timestamp_ms DESC, trace_id DESC) AS position FROM tool_traces) WHERE position <= 10")
def recent_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.recent(S.tool_traces(spark, d)).select("tool_name", "trace_id", "position")


@query("tiered_metrics", f"{S.sql('tool_traces')} SELECT count(*) AS n_queries, round(avg(CASE WHEN tool_name = 'view' THEN 1.0::DOUBLE ELSE 0 END), 6) AS cache_hit_rate, round(avg(CASE WHEN tool_name = 'click' THEN 1.0::DOUBLE ELSE 0 END), 6) AS hot_hit_rate, round(avg(duration_ms), 6) AS avg_ms FROM tool_traces")
def tiered_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = S.tool_traces(spark, d).select((F.col("tool_name") == "view").alias("cache_hit"), (F.col("tool_name") == "click").alias("hot_hit"), F.col("duration_ms").alias("total_ms"))
    out = M.tiered_metrics(rows)
    return out.select("n_queries", *(F.round(c, 6).alias(c) for c in ("cache_hit_rate", "hot_hit_rate", "avg_ms")))


@query("tier_label", f"{S.sql('tool_traces')} SELECT trace_id, CASE WHEN tool_name = 'view' THEN 'cache' WHEN tool_name = 'signup' THEN 'hybrid' WHEN tool_name = 'click' THEN 'hot' ELSE 'warm' END AS source_tier FROM tool_traces")
def tier_label(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.operators.search import tier_label as label

    t = F.col("tool_name")
    return label(S.tool_traces(spark, d).select("trace_id", (t == "view").alias("cache_hit"), t.isin("click", "signup").alias("hot"), t.isin("signup", "purchase").alias("warm"))).select("trace_id", "source_tier")


@query("tiered_lookup", f"{S.sql('vectors')}, {_MERGE_SQL}, {_ENTRIES}, asked AS (SELECT vec_id AS query_id, tenant_id, NULL AS project_id, embedding FROM vectors WHERE vec_id % 50 = 0), {_LOOKUP} SELECT query_id, result_id, source_tier FROM (SELECT h.query_id, unnest(e.result_ids) AS result_id, 'cache' AS source_tier FROM hits h JOIN entries e USING (entry_id) WHERE h.n = 1 UNION ALL SELECT query_id, CAST(chunk_id AS VARCHAR), tier FROM r WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM hits WHERE n = 1))")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The whole tiered path: a cache hit gives its stored results, every other query hot and warm ones merged."""
    entries = _entries(spark, d)
    asked = S.vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", F.lit(None).cast("string").alias("project_id"), "embedding")
    found = T.cache_lookup(asked, entries, NOW)
    cached = found.join(entries.select("entry_id", "result_ids"), "entry_id").select("query_id", F.explode("result_ids").alias("result_id"), F.lit("cache").alias("source_tier"))
    rest = T.merge(*_tiers(spark, d), k=10).join(found.select("query_id"), "query_id", "left_anti")
    return cached.unionByName(rest.select("query_id", F.col("chunk_id").cast("string").alias("result_id"), F.col("tier").alias("source_tier")))


_ASKED_50 = "asked AS (SELECT vec_id AS query_id, tenant_id, CASE WHEN vec_id % 4 = 0 THEN 'p' END AS project_id, embedding FROM vectors WHERE vec_id % 50 = 0)"


@query(
    "search_write_back",
    f"""{S.sql('vectors')}, {_ENTRIES}, {_ASKED_50}, {_LOOKUP},
    one AS (SELECT query_id, EXISTS (SELECT 1 FROM hits h WHERE h.query_id = asked.query_id) AS cached, (SELECT least(count(*), 5) FROM vectors v WHERE v.tenant_id = asked.tenant_id) AS n FROM asked)
    SELECT 1 AS run, CASE WHEN cached THEN 'cache' ELSE 'search' END AS source, count(*) AS n_queries, CAST(sum(CASE WHEN cached THEN 2 ELSE n END) AS BIGINT) AS n_results FROM one GROUP BY cached
    UNION ALL SELECT 2, 'cache', count(*), CAST(sum(CASE WHEN cached THEN 2 ELSE n END) AS BIGINT) FROM one""",
)
def search_write_back(spark: SparkSession, d: str) -> DataFrame:
    """Vector search through the cache, twice: what the first run writes back answers the second."""
    from larkspur.operators import dense

    vectors = S.vectors(spark, d)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", F.when(F.col("vec_id") % 4 == 0, "p").alias("project_id"), "embedding")

    def search(queries: DataFrame) -> DataFrame:
        return dense.topk(vectors, queries, 5, same_tenant=True).select("query_id", F.col("vec_id").alias("chunk_id"), "rank")

    first = T.search_through(asked, _entries(spark, d), search, NOW)
    kept = T.cache_insert(_entries(spark, d), first.entries, NOW)
    second = T.search_through(asked, kept, search, NOW + 1000)
    rows = first.results.withColumn("run", F.lit(1)).unionByName(second.results.withColumn("run", F.lit(2)))
    return rows.groupBy("run", "source").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_results"))
