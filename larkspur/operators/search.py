"""The search API over chunk tables: retrieval, filters, repair, citations, episodes, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larkspur.functions.text import episode_of, repair_query, tag_number
from larkspur.operators import ranking

CHANNEL_K = 100


def filters(df: DataFrame, project: str | None = None, types: tuple[str, ...] = (), episode: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that satisfy every given filter; the time range includes both ends."""
    if project is not None:
        df = df.where(F.col("project_id") == project)
    if types:
        df = df.where(F.col("chunk_type").isin(*types))
    if episode is not None:
        df = df.where(F.array_contains("tags", f"episode:{episode}"))
    if start is not None:
        df = df.where(F.col("timestamp_created") >= start)
    if end is not None:
        df = df.where(F.col("timestamp_created") <= end)
    return df


def live(chunks: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Chunks that are not deleted, by status or by a tombstone (tenant_id, chunk_id)."""
    out = chunks.where("status is distinct from 'deleted'")
    return out if tombstones is None else out.join(tombstones.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_anti")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "tenant_id")) -> DataFrame:
    """Fuse two ranked lists and keep the ``k`` best of each query and tenant with ``rank``."""
    fused = ranking.rrf(dense, sparse, (*by, "chunk_id"))
    w = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tiered(dense: DataFrame, sparse: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "tenant_id")) -> DataFrame:
    """As ``hybrid`` with only ``k`` dense candidates; a query without lexical hits keeps its raw cosine."""
    near = dense.where(F.col("rank") <= k)
    fused = ranking.rrf(near, sparse, (*by, "chunk_id"))
    no_words = near.join(sparse.select(*by).distinct(), list(by), "left_anti")
    raw = no_words.select(*by, "chunk_id", "score", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    keep = fused.join(sparse.select(*by).distinct(), list(by), "left_semi")
    w = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), "chunk_id")
    return keep.select(raw.columns).unionByName(raw).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cite(df: DataFrame) -> DataFrame:
    """Add ``citation`` (id, place in the source, offsets of a split piece) and ``episode_id``."""
    citation = F.struct(
        F.concat(F.col("chunk_id"), F.lit(":"), F.left("hash", F.lit(12))).alias("citation_id"), F.col("chunk_id").alias("chunk_id"), F.col("project_id").alias("project_id"),
        (F.col("source.path") if "source" in df.columns else F.lit(None).cast("string")).alias("source_path"), tag_number(F.col("tags"), "char_start:").alias("char_start"), tag_number(F.col("tags"), "char_end:").alias("char_end"),
    )
    return df.withColumn("citation", citation).withColumn("episode_id", episode_of(F.col("tags")))


def search(queries: DataFrame, chunks: DataFrame, run, k: int = 20, **wanted) -> DataFrame:
    """Search with filters, then once more with the repaired query where nothing was found.

    ``run(queries, chunks)`` gives ranked rows (query_id, chunk_id, score, rank).  Filters are
    applied to the chunks before retrieval, so they cost no recall.  Adds ``repaired``.
    """
    pool = filters(live(chunks), **wanted)
    first = run(queries, pool).where(F.col("rank") <= k)
    missed = queries.join(first.select("query_id").distinct(), "query_id", "left_anti").withColumn("fixed", repair_query(F.col("query"))).where("fixed is not null")
    second = run(missed.select("query_id", F.col("fixed").alias("query")), pool).where(F.col("rank") <= k)
    return first.withColumn("repaired", F.lit(False)).unionByName(second.withColumn("repaired", F.lit(True)))


def get(chunks: DataFrame, tenant: str, chunk_id: str) -> DataFrame:
    return live(chunks).where((F.col("tenant_id") == tenant) & (F.col("chunk_id") == chunk_id))


def list_chunks(chunks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first within each tenant, ``limit`` after ``offset`` of each."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc("timestamp_created"), "chunk_id")
    return live(chunks).withColumn("position", F.row_number().over(w)).where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def stats(chunks: DataFrame) -> DataFrame:
    """(tenant_id, total, active, deleted, types): the histogram counts active chunks only."""
    kinds = chunks.where("status <> 'deleted'").groupBy("tenant_id", "chunk_type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("tenant_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "n")))).alias("types"))
    gone = F.sum(F.when(F.col("status") == "deleted", 1).otherwise(0))
    return chunks.groupBy("tenant_id").agg(F.count("*").alias("total"), (F.count("*") - gone).alias("active"), gone.alias("deleted")).join(kinds, "tenant_id", "left")


def consolidate(chunks: DataFrame, max_chunks: int = 50) -> DataFrame:
    """One summary chunk for each tenant and episode, from its ``max_chunks`` newest chunks in order of time."""
    rows = live(chunks) if "status" in chunks.columns else chunks
    rows = rows.withColumn("episode_id", episode_of(F.col("tags"))).where("episode_id is not null")
    w = Window.partitionBy("tenant_id", "episode_id").orderBy(F.desc("timestamp_created"), "chunk_id")
    kept = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_chunks)
    line = F.concat(F.lit("- ["), "chunk_type", F.lit("] "), F.left(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")), F.lit(180)))
    groups = kept.groupBy("tenant_id", "episode_id").agg(F.count("*").alias("n_sources"), F.sort_array(F.collect_list(F.struct("timestamp_created", "chunk_id", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("Episode "), "episode_id", F.lit(" summary ("), F.col("n_sources").cast("string"), F.lit(" chunks):\n"), F.array_join(F.col("lines.line"), "\n"))
    tags = F.array(F.concat(F.lit("episode:"), "episode_id"), F.lit("episode_summary:true"), F.concat(F.lit("episode_source_chunks:"), F.col("n_sources").cast("string")))
    return groups.select("tenant_id", "episode_id", "n_sources", F.lit("summary").alias("chunk_type"), text.alias("text"), tags.alias("tags"))


def tier_label(df: DataFrame) -> DataFrame:
    """Where a result came from: ``cache_hit``, ``hot`` and ``warm`` flags give ``source_tier``."""
    return df.withColumn("source_tier", F.when(F.col("cache_hit"), "cache").when(F.col("hot") & F.col("warm"), "hybrid").when(F.col("hot"), "hot").otherwise("warm"))
