"""Approximate search: measured recall, exact scores, blocks, tenants, and the stored index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ann, dense


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    rows = [(i, f"t{i % 3}", [float(x) for x in np.round(centre[i % 12] + 0.35 * rng.normal(size=16), 3)]) for i in range(1500)]
    rows += [(5000 + i, "t0", [1.0] * 16) for i in range(300)]  # a common vector
    return spark.createDataFrame(rows, "vec_id bigint, tenant_id string, embedding array<float>").cache()


def asked(vectors):
    return vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "tenant_id", "embedding")


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.tenant_id, round(r.score, 6)) for r in df.collect())


def test_recall_is_measured_and_lists_are_skipped(vectors):
    model = ann.fit(vectors, lists=24)
    listed = ann.assign(vectors, model)
    model = ann.calibrate(listed, model, 10, 0.95)
    assert model.probes <= 8  # of 24: the groups are apart
    found, exact = ann.search(listed, asked(vectors), model, 10), dense.topk(vectors, asked(vectors), 10)
    assert ann.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in dense.topk(vectors, asked(vectors), 2000).collect()}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-8 for r in found.collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_all_lists_give_the_exact_result(vectors, block):
    model = ann.fit(vectors, lists=9)
    model.probes = 9
    listed = ann.assign(vectors, model)
    assert rows(ann.search(listed, asked(vectors), model, 5, block=block)) == rows(dense.topk(vectors, asked(vectors), 5))
    assert rows(ann.search(listed, asked(vectors), model, 5, same_tenant=True, block=block)) == rows(dense.topk(vectors, asked(vectors), 5, same_tenant=True))


def test_empty_null_and_wrong_vectors(spark, vectors):
    none = vectors.limit(0)
    model = ann.fit(none)
    assert ann.search(ann.assign(none, model), none.withColumnRenamed("vec_id", "query_id"), model, 3).isEmpty()
    nulls = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "t", None)], "vec_id bigint, tenant_id string, embedding array<float>")
    model = ann.fit(nulls)
    listed = ann.assign(nulls, model)
    assert [r.vec_id for r in ann.search(listed, nulls.withColumnRenamed("vec_id", "query_id"), model, 3).collect()] == [1]
    with pytest.raises(Exception, match="dimensions"):
        ann.assign(vectors, model).count()


def test_stored_index_inserts_replaces_and_deletes(spark, vectors, tmp_path):
    base = str(tmp_path / "index")
    stored = vectors.withColumnRenamed("vec_id", "id")
    made = ann.VectorIndex(spark, base).create(stored.where("id < 1000"), 5, 0.95)
    index = ann.VectorIndex(spark, base).open()
    assert index.model.probes == made.model.probes and index.live().count() == 1000
    index.insert(stored.where("id between 900 and 1099"))
    index.insert(spark.createDataFrame([("7", "t9", [1.0] + [0.0] * 15)], "id string, tenant_id string, embedding array<float>"))
    index.delete(spark.createDataFrame([("8",), ("nobody",)], "id string"))
    live = {r.id: r.tenant_id for r in index.live().collect()}
    assert len(live) == 1099 and live["7"] == "t9" and "8" not in live
    near = index.search(spark.createDataFrame([(1, None, [1.0] + [0.0] * 15)], "query_id int, tenant_id string, embedding array<float>"), 1).first()
    assert (near.id, round(near.score, 6)) == ("7", 1.0)
