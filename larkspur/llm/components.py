"""Connected components of an edge table by alternating large-star and small-star steps.

All state stays in DataFrames; every round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most; a round's tables go when the next
is written.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import Tables


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Map (node, component): each linked node and the smallest node it can reach.

    Nodes without edges are absent; self-loops and repeated edges do no harm; an empty
    edge table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    t = Tables(edges.sparkSession, "components")
    e = t.write(e, "edges")
    state = _state(e)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = t.write(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = t.write(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        t.drop("edges", "large-star")
        t.drop("small-star", keep=1)
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
