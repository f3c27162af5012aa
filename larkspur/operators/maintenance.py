"""Change-log replay, upserts, compaction and its metrics, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.tables import written


def wal_replay(log: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """State after a change log (seq, op, tenant_id, chunk_id, payload): the last add of each chunk not deleted since.

    Records up to the last checkpoint are applied already and skipped, as are adds of chunks
    already ``present``; records behind the first corrupt one (``op`` null) are not trusted.
    """
    marks = log.agg(F.coalesce(F.max(F.when(F.col("op") == "checkpoint", F.col("seq"))), F.lit(-1)).alias("done"), F.min(F.when(F.col("op").isNull(), F.col("seq"))).alias("bad"))
    tail = log.join(F.broadcast(marks), F.lit(True)).where("seq > done and (bad is null or seq < bad) and op in ('add', 'delete')")  # one row
    w = Window.partitionBy("tenant_id", "chunk_id").orderBy(F.desc("seq"))
    last = tail.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 'add'").select("tenant_id", "chunk_id", "seq", "payload")
    return last if present is None else last.join(present.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The newest row of each key by ``version``; a change wins over a base row of the same version."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_groups(base: DataFrame, fresh: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Reindexing: all rows of the groups that ``fresh`` holds are replaced by its rows."""
    return base.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def compaction_metrics(chunks: DataFrame, cached: DataFrame, segments: DataFrame) -> DataFrame:
    """(tenant_id, total, deleted, tombstone_ratio, staleness, n_segments, needs_compaction).

    ``cached`` counts index rows by tenant, ``segments`` files by tenant.  Compaction is due
    above 20 % tombstones, 10 segments or 15 % staleness.
    """
    gone = F.sum(F.when(F.col("status") == "deleted", 1).otherwise(0))
    base = chunks.groupBy("tenant_id").agg(F.count("*").alias("total"), gone.alias("deleted"))
    out = base.join(cached, "tenant_id", "left").join(segments, "tenant_id", "left").fillna(0, ["n_cached", "n_segments"])
    out = out.withColumn("tombstone_ratio", F.col("deleted") / F.col("total")).withColumn("staleness", F.greatest(F.col("total") - F.col("n_cached"), F.lit(0)) / F.col("total"))
    due = (F.col("tombstone_ratio") > 0.20) | (F.col("n_segments") > 10) | (F.col("staleness") > 0.15)
    return out.select("tenant_id", "total", "deleted", "tombstone_ratio", "staleness", "n_segments", due.alias("needs_compaction"))


def tombstone_audit(visible: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Deleted rows that a reader can still see; empty when all is well."""
    return visible.join(tombstones.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi")


def _exact(value: Column, p: int) -> Column:
    """Value at sorted index floor(p (n - 1) / 100)."""
    s = F.sort_array(F.collect_list(value))
    return F.element_at(s, (F.floor(F.lit(p) * (F.size(s) - 1) / 100) + 1).cast("int"))


def latency_stats(metrics: DataFrame, last: int = 1000, by: str = "tool_name", value: str = "duration_ms", order: tuple[str, ...] = ("timestamp_ms", "trace_id")) -> DataFrame:
    """Count, mean and exact p50/p90/p99 of the newest ``last`` rows of each group (the size of the metrics ring)."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    kept = metrics.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    v = F.col(value)
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), *(_exact(v, p).alias(f"p{p}") for p in (50, 90, 99)))


def suite_percentiles(metrics: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """p50/p90/p99 by the other rule: sorted[floor(n p)], the index at most the last.

    A distributed selection.  Equal values are counted first; the counts are dealt by ranges of
    group and value, and the sums of the ranges tell which range holds each wanted place.
    Only those ranges are then counted through, each on its own, so no task sees all values
    of a group.
    """
    counts = metrics.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    n = max(1, int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = written(counts.repartitionByRange(n, by, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(by, "_part").agg(F.sum("_c").alias("_s"))  # one row a group and range
    upto = sums.withColumn("_upto", F.sum("_s").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    whole = sums.groupBy(by).agg(F.sum("_s").alias("_n"))
    places = F.explode(F.array(*(F.struct(F.lit(f"p{p}").alias("_p"), F.least(F.floor(F.col("_n") * (p / 100)), F.col("_n") - 1).alias("_place")) for p in percents)))
    wanted = upto.join(whole.select(by, places.alias("_w")).select(by, "_w.*"), by).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_s")))
    wanted = wanted.select(by, "_part", "_p", (F.col("_place") - F.col("_upto") + F.col("_s")).alias("_place"))

    w = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranges = dealt.join(wanted.select(by, "_part").distinct(), [by, "_part"], "left_semi").withColumn("_upto", F.sum("_c").over(w))
    found = ranges.join(wanted, [by, "_part"]).where(F.col("_upto") > F.col("_place")).groupBy(by, "_p").agg(F.min(value).alias("_v"))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("_p") == f"p{p}", F.col("_v"))).alias(f"p{p}") for p in percents))


def recent(metrics: DataFrame, n: int = 10, by: str = "tool_name", order: tuple[str, ...] = ("timestamp_ms", "trace_id")) -> DataFrame:
    """The ``n`` newest rows of each group with their ``position``."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return metrics.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def tiered_metrics(rows: DataFrame) -> DataFrame:
    """One row of averages over queries with ``cache_hit`` and ``hot_hit`` flags and ``total_ms``."""
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return rows.agg(F.count("*").alias("n_queries"), share("cache_hit").alias("cache_hit_rate"), share("hot_hit").alias("hot_hit_rate"), F.avg("total_ms").alias("avg_ms"))
