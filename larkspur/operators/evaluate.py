"""Retrieval evaluation: recall, reciprocal rank, precision, bootstrap, paired tests, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.tables import numbered


def per_query(queries: DataFrame, qrels: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, mrr, precision) of ranked results (query_id, doc_id, rank) against qrels.

    Recall and precision look at the first ``k`` ranks, the reciprocal rank at all.  A query
    without relevant documents has recall 1; one without results has precision 0.
    """
    rel = qrels.distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return _scores(queries, rel, results.join(qrels.distinct(), ["query_id", "doc_id"]), results, k)


def per_query_by_class(queries: DataFrame, docs: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """``per_query`` where the relevant documents of a query (query_id, class) are those (doc_id, class) of its class.

    Documents are counted by class and only the results look up theirs, so no pair of a query
    and a relevant document is formed that the results do not show.
    """
    docs = docs.select("doc_id", "class").distinct()
    asked = queries.select("query_id", "class").distinct()
    sizes = docs.groupBy("class").agg(F.count("*").alias("n_rel"))
    rel = asked.join(sizes, "class").select("query_id", "n_rel")
    hit = results.join(asked, "query_id").join(docs, ["doc_id", "class"])
    return _scores(queries, rel, hit, results, k)


def _scores(queries: DataFrame, rel: DataFrame, hit: DataFrame, results: DataFrame, k: int) -> DataFrame:
    shown = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_shown"))
    hits = hit.groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias("n_hit"), F.min("rank").alias("first"))
    out = queries.select("query_id").join(rel, "query_id", "left").join(shown, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["n_rel", "n_shown", "n_hit"])
    return out.select(
        "query_id",
        F.when(F.col("n_rel") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_rel")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_shown") == 0, 0.0).otherwise(F.col("n_hit") / F.col("n_shown")).alias("precision"),
    )


def bootstrap(values: DataFrame, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """(n, mean, std, lower, upper) of column ``value``: seeded resampled means, percentiles 2.5 and 97.5.

    Draw j of an iteration takes the row at place md5("seed:iteration:j") (its first 12 hex
    digits, modulo n) in order of ``query_id``, so the result is the same on any cluster.
    The draws are counted by iteration and row before they meet the values.
    """
    rows = numbered(values.select("query_id", "value"), "query_id")
    n = rows.count()
    if not n:
        return values.sparkSession.createDataFrame([], "n bigint, mean double, std double, lower double, upper double")
    draws = values.sparkSession.range(iterations * n).select(F.expr(f"id div {n}").alias("it"), F.expr(f"id % {n}").alias("j"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("it"), F.col("j")).cast("binary")), 1, 12)
    taken = draws.select("it", (F.conv(digits, 16, 10).cast("bigint") % n).alias("i")).groupBy("it", "i").agg(F.count("*").alias("times"))
    means = taken.join(rows.select("i", "value"), "i").groupBy("it").agg((F.sum(F.col("value") * F.col("times")) / n).alias("m"))
    spread = means.agg(F.sort_array(F.collect_list("m")).alias("s"))  # one mean an iteration
    at = lambda p: F.element_at("s", F.lit(int(p * (iterations - 1) / 100) + 1))
    base = values.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return base.join(spread, F.lit(True)).select("n", "mean", "std", at(2.5).alias("lower"), at(97.5).alias("upper"))  # one row each


def erf(x: Column) -> Column:
    """Error function by the Abramowitz-Stegun polynomial 7.1.26 (error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row comparing two runs (query_id, value): n, mean_diff, wins, losses, ties, t, p, cohens_d of b - a.

    p is the two-sided normal one from 30 queries on; below, 0.01, 0.05 or 1 by |t| against
    2.576 and 1.96.
    """
    d = a.select("query_id", F.col("value").alias("x")).join(b.select("query_id", F.col("value").alias("y")), "query_id").withColumn("d", F.col("y") - F.col("x"))
    won = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), won(F.col("d") > 1e-9).alias("wins"), won(F.col("d") < -1e-9).alias("losses"), won(F.abs("d") <= 1e-9).alias("ties"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    s = s.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0))
    t = F.abs("t")
    p = F.when(F.col("n") >= 30, 1 - erf(t / F.sqrt(F.lit(2.0)))).when(t > 2.576, 0.01).when(t > 1.96, 0.05).otherwise(1.0)
    return s.select("n", "mean_diff", "wins", "losses", "ties", "t", p.alias("p"), F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).otherwise(0.0).alias("cohens_d"))


def gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, mean, threshold, passed) of each threshold over the per-query ``metrics``."""
    means = metrics.agg(*(F.avg(m).alias(m) for m in thresholds))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), F.lit(t).alias("threshold")) for m, t in thresholds.items())))
    return means.select(rows.alias("r")).select("r.*").withColumn("passed", F.col("mean") >= F.col("threshold"))


def set_scores(expected: Column, found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; 0 for empty denominators."""
    both = F.size(F.array_intersect(expected, found))
    n_found, n_expected = F.size(F.array_distinct(found)), F.size(F.array_distinct(expected))
    p = F.when(n_found > 0, both / n_found).otherwise(0.0)
    r = F.when(n_expected > 0, both / n_expected).otherwise(0.0)
    return p, r, F.when(both > 0, 2 * p * r / (p + r)).otherwise(0.0)


def report(runs: DataFrame, base: str) -> DataFrame:
    """(dataset, run, mean, delta) of per-query values (dataset, run, query_id, value) against run ``base``."""
    means = runs.groupBy("dataset", "run").agg(F.avg("value").alias("mean"))
    ref = means.where(F.col("run") == base).select("dataset", F.col("mean").alias("base_mean"))
    return means.join(ref, "dataset", "left").select("dataset", "run", "mean", (F.col("mean") - F.col("base_mean")).alias("delta"))
