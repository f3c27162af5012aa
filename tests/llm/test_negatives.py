"""Hard negatives against brute force: windows, ties, hot lists, nulls and odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SMALL
from oracle import differences
from pyspark.sql import functions as F

from larkspur.llm import negatives as N, queries, sql

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, rank int"
ODD = float("nan"), float("inf"), float("-inf"), None


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """Every anchor (id divisible by 100) against every row, in plain Python numbers."""
    used = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(used):
        if i is None or i % 100:
            continue
        clip = lambda x: max(-N.MOST, min(N.MOST, x))
        scored = [(-clip(sum(x * y for x, y in zip(v, w, strict=False))), (j is None, j or 0), j, other) for b, (j, w, other) in enumerate(used) if b != a]
        scored.sort(key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == lab][:positives]:
            fits = [x for x in scored if x[3] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, r, x[2], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, "row", 7) for i, v, lab in rows], SCHEMA)
    return sorted((tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=repr)


def vectors(n, dim=6, seed=3, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    return [(int(i) * 20, [float(x) for x in np.round(centre[rng.integers(5)] + 0.2 * rng.normal(size=dim), 2)], int(rng.integers(labels))) for i in range(n)]


def test_equals_sql(spark):
    assert differences(spark, queries.op11_hard_negatives, sql.HARD_NEGATIVES, SMALL) == ""


@pytest.mark.parametrize("max_lists,block", [(1, 4096), (40, 5), (400, 3)])
def test_lists_blocks_and_waves_do_not_change_results(spark, max_lists, block):
    rows = vectors(400)
    want = brute(rows)
    assert want and found(spark, rows, max_lists=max_lists, block=block) == want


def test_a_common_vector_is_split_and_its_ties_go_by_id(spark):
    rows = vectors(60) + [(5000 + i, [1.0, 0.5, 0.0, 0.0, -0.5, 0.25], i % 3) for i in range(200)]
    assert found(spark, rows, block=8) == brute(rows)


def test_nulls_odd_components_repeats_and_short_vectors(spark):
    rows = vectors(40) + [(i, [x, *[0.5] * 5], 1) for i, x in enumerate(ODD)] + [(100, None, 1), (200, [0.1] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 0)]
    rows += [(300, [0.5] * 6, 1)] * 3 + [(301, [0.5] * 6, 2)] * 3 + [(400, [], 1), (401, [0.5, 0.25], 2), (500, [0.0] * 6, 0)]
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_doubles_are_exact_and_bounded(spark):
    rows = [(100, [1e6, 1.0], 0), (101, [1e6, 2.0], 0), (102, [1e6, 3.0], 1), (103, [1e6, 1.5], 1), (104, [1e30, 1.0], 0), (105, [1e30, 1.0], 1), (106, [1e305, 0.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert found(spark, [(100, [0.5], 1)]) == []


def test_bounds_skip_lists(spark):
    """Far groups of vectors are not visited, and the result stays whole."""
    from larkspur.llm import common as C

    rows = [(i, [math.cos(g) + 0.001 * (i % 9), math.sin(g)], i % 2) for i, g in enumerate(np.repeat(np.arange(0, 6, 0.06), 10))]
    df = N.usable(spark.createDataFrame(rows, "id bigint, embedding array<double>, label bigint")).withColumn("anchor", F.col("id") % 100 == 0)
    lists = N.Lists(df.select("id", "label", "embedding", "anchor"), C.Tables(spark, "test"), 256)
    probes = lists.table.where("anchor").select("row", "label", "embedding", F.array(F.lit(60000)).alias("lo"), F.array(F.lit(N.MOST)).alias("hi"))
    went, of = lists.visits(probes, 0, N.MAX_LISTS).count(), probes.count() * len(lists.centre)
    assert went < of / 2
    assert found(spark, rows) == brute(rows)
