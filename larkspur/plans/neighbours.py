"""Registered queries: approximate nearest neighbours, and what they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.operators import ann, dense
from larkspur.plans.registry import query
from larkspur.sources import bindings as S

_EXACT = """asked AS (SELECT vec_id AS query_id, embedding FROM vectors WHERE vec_id % 50 = 0),
    exact AS (
        SELECT query_id, vec_id FROM asked, vectors
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(asked.embedding, vectors.embedding), 9) DESC, vec_id) <= 10
    )"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return S.vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", "embedding")


@query("ann_topk")
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors by inverted lists, with the probes that reach a recall of 0.95 on stored vectors."""
    vectors = S.vectors(spark, d)
    model = ann.fit(vectors)
    listed = ann.assign(vectors, model)
    model = ann.calibrate(listed, model, 10, 0.95)
    return ann.search(listed, _asked(spark, d), model, 10)


@query(
    "ann_recall",
    f"""{S.sql('vectors')}, {_EXACT}
    SELECT (SELECT count(*) FROM asked) AS n_queries, (SELECT count(*) FROM exact) AS n_neighbours, TRUE AS recall_ok, 0::BIGINT AS n_wrong_scores""",
)
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of ``ann_topk`` against the exact search: whether it is 0.9 or more, and scores that differ from the exact cosine."""
    found, exact = ann_topk(spark, d), dense.topk(S.vectors(spark, d), _asked(spark, d), 10)
    measured = ann.recall(found, exact).agg(F.count("*").alias("n_queries"), F.sum("wanted").alias("n_neighbours"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_ok"))
    both = found.join(exact.select("query_id", "vec_id", F.col("score").alias("true")), ["query_id", "vec_id"])
    wrong = both.agg(F.coalesce(F.sum(F.when(F.abs(F.col("score") - F.col("true")) > 1e-8, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_wrong_scores"))
    return measured.join(F.broadcast(wrong), F.lit(True))  # one row each
