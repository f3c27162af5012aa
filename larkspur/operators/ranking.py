"""Fusion, reranking and context packing over ranked lists (query_id, chunk_id, score or rank)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60
DAY_MS = 86_400_000.0
HALF_LIFE_DAYS = 7.0
WEIGHTS = {"rrf": 1.0, "recency": 0.1, "project": 0.2, "type": 0.05}
SIMILAR = 0.9
LAMBDA = 0.7
BUDGET_TOKENS = 4000
BYTES_A_TOKEN = 4


def rrf(dense: DataFrame, sparse: DataFrame, by: tuple[str, ...] = ("query_id", "chunk_id"), dense_weight: float = 1.0, sparse_weight: float = 1.0, agg: str = "sum") -> DataFrame:
    """Reciprocal-rank fusion of two lists with ``rank``: score, dense_rank, sparse_rank.

    A chunk that a list holds several times (sentences) adds each of its terms, and its rank
    is the last one; ``agg='best'`` counts only its best rank.
    """
    both = dense.select(*by, "rank", F.lit("dense").alias("list")).unionByName(sparse.select(*by, "rank", F.lit("sparse").alias("list")))
    if agg == "best":
        both = both.groupBy(*by, "list").agg(F.min("rank").alias("rank"))
    weight = F.when(F.col("list") == "dense", dense_weight).otherwise(sparse_weight)
    return both.groupBy(*by).agg(
        F.sum(weight / (RRF_K + F.col("rank"))).alias("score"),
        F.max(F.when(F.col("list") == "dense", F.col("rank"))).alias("dense_rank"),
        F.max(F.when(F.col("list") == "sparse", F.col("rank"))).alias("sparse_rank"),
    )


def recency(created_ms: Column, now_ms: int) -> Column:
    """Half-life decay of the age in days; times to come count as now."""
    age = F.greatest((F.lit(float(now_ms)) - created_ms) / DAY_MS, F.lit(0.0))
    return F.exp(-F.log(F.lit(2.0)) * age / HALF_LIFE_DAYS)


def project_bonus(project: Column, wanted: Column) -> Column:
    return F.when(project == wanted, 1.0).otherwise(0.0)


def type_bonus(kind: Column, preferred: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*preferred), 1.0).otherwise(0.0) if preferred else F.lit(0.0)


def rerank(fused: DataFrame, now_ms: int, project: Column, preferred: tuple[str, ...] = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add ``final_score``: the fused score and the weighted features of the chunk's metadata."""
    total = weights["rrf"] * F.col("score") + weights["recency"] * recency(F.col("timestamp_created"), now_ms) + weights["project"] * project_bonus(F.col("project_id"), project) + weights["type"] * type_bonus(F.col("chunk_type"), preferred)
    return fused.withColumn("final_score", total)


def hash_dedup(ranked: DataFrame) -> DataFrame:
    """The best row of each (query_id, hash); ties by chunk_id."""
    w = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "chunk_id")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def budget(ranked: DataFrame, tokens: int = BUDGET_TOKENS) -> DataFrame:
    """The leading rows of each query whose bytes together fit the budget; adds ``used_tokens``.

    Rows come by ``rank``; the first overflow ends the list.  Bytes are ``n_bytes`` where the rows have it, else those of ``text``.
    """
    size = F.col("n_bytes") if "n_bytes" in ranked.columns else F.octet_length("text")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("_bytes", F.sum(size).over(w))
    return run.where(F.col("_bytes") <= tokens * BYTES_A_TOKEN).withColumn("used_tokens", F.ceil(F.col("_bytes") / BYTES_A_TOKEN).cast("bigint")).drop("_bytes")


def _vectors(table: pa.Table) -> list[np.ndarray | None]:
    out = []
    for v in table["embedding"].to_pylist():
        a = None if v is None else np.array(v, np.float64)
        n = 0.0 if a is None else float(np.linalg.norm(a))
        out.append(None if a is None else a / n if n > 0 else a)
    return out


def _by_dimension(vectors: list[np.ndarray | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each dimension; only these are compared."""
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None:
            sizes.setdefault(len(v), []).append(i)
    return {n: (np.array(rows), np.vstack([vectors[i] for i in rows])) for n, rows in sizes.items()}


def _similarity_dedup(table: pa.Table) -> pa.Table:
    table = table.sort_by([("score", "descending"), ("chunk_id", "ascending")])
    keep = np.ones(table.num_rows, bool)
    for rows, matrix in _by_dimension(_vectors(table)).values():
        held = 0
        for i, v in zip(rows, matrix.copy(), strict=True):  # the kept vectors move to the front of the matrix
            if held and float((matrix[:held] @ v).max()) > SIMILAR:
                keep[i] = False
            else:
                matrix[held] = v
                held += 1
    return table.filter(pa.array(keep))


def similarity_dedup(ranked: DataFrame) -> DataFrame:
    """Greedy per query: a row goes when its cosine with a kept better row is above 0.9.

    Lists are the candidates of one query (at most a few hundred by the retrieval depth).
    """
    return ranked.groupBy("query_id").applyInArrow(_similarity_dedup, ranked.schema)


def _mmr(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("chunk_id", "ascending")])
        score = table["score"].to_numpy().astype(np.float64)
        spread = score.max() - score.min()
        relevance = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
        groups = _by_dimension(_vectors(table))
        group_of = {int(i): (n, j) for n, (rows, _) in groups.items() for j, i in enumerate(rows)}
        kinds = np.array(table["chunk_type"].to_pylist(), dtype=object)
        near, seen, free = np.full(len(score), -np.inf), np.zeros(len(score)), np.ones(len(score), bool)
        chosen: list[int] = []
        while len(chosen) < min(k, len(score)):
            other = np.where(seen > 0, 0.5 / np.maximum(seen, 1), 1.0)
            gain = LAMBDA * relevance + (1 - LAMBDA) * np.where(near > -np.inf, 1 - near, other)
            best = int(np.where(free, gain, -np.inf).argmax())
            chosen.append(best)
            free[best] = False
            seen += kinds == kinds[best]
            if best in group_of:
                n, j = group_of[best]
                rows, matrix = groups[n]
                near[rows] = np.maximum(near[rows], matrix @ matrix[j])
        out = table.take(pa.array(chosen, pa.int64()))
        return out.append_column("mmr_rank", pa.array(range(1, len(chosen) + 1), pa.int32()))

    return run


def mmr(ranked: DataFrame, k: int) -> DataFrame:
    """Maximal marginal relevance per query: ``k`` rows with ``mmr_rank``, relevance 0.7 against diversity."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.groupBy("query_id").applyInArrow(_mmr(k), f"{ddl}, mmr_rank int")


def pack(ranked: DataFrame, k: int = 20, tokens: int = BUDGET_TOKENS) -> DataFrame:
    """Hash dedup, similarity dedup, marginal relevance, budget: the context of each query."""
    chosen = mmr(similarity_dedup(hash_dedup(ranked)), k)
    return budget(chosen.withColumn("rank", F.col("mmr_rank")), tokens)


def pack_counters(ranked: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, n_candidates, n_hash_removed, n_packed, used_tokens)."""
    before = ranked.groupBy("query_id").agg(F.count("*").alias("n_candidates"), (F.count("*") - F.countDistinct("hash")).alias("n_hash_removed"))
    after = packed.groupBy("query_id").agg(F.count("*").alias("n_packed"), F.max("used_tokens").alias("used_tokens"))
    return before.join(after, "query_id", "left").fillna(0, ["n_packed", "used_tokens"])
