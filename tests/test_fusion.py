"""Fusion of whole lists: no chunk is left out before the sums are whole."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from larkspur.operators import fusion, sparse
from larkspur.plans.all import REGISTRY
from oracle import differences


def test_a_chunk_far_down_in_both_lists_can_be_the_best(spark, tmp_path):
    angle = np.linspace(0.1, 1.0, 40)
    near = [i for i in range(1, 40) if i % 7][:25]  # nearer to the query than the last, without its word
    words = [i for i in range(100, 140) if i % 7][:25]  # better sentences, without a vector
    docs = [(i, "other words") for i in near] + [(i, "needle") for i in words] + [(50, "needle in a long line of other words")]
    vec = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in zip(near, angle)] + [(50, [0.0, 1.0])]
    tables = {
        "documents": pa.table({"doc_id": [d[0] for d in docs], "source": ["t"] * len(docs), "lang": ["en"] * len(docs), "text": [d[1] for d in docs]}),
        "embeddings": pa.table({"vec_id": [v[0] for v in vec], "embedding": pa.array([v[1] for v in vec], pa.list_(pa.float32()))}),
        "benchmark": pa.table({"item_id": [1], "text": ["needle"]}),
    }
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
    q = REGISTRY["hybrid_search"]
    best = q.run(spark, str(tmp_path)).where("rank = 1").collect()
    assert [(r.chunk_id, r.score) for r in best] == [("50", round(2 / 86, 6))]
    assert differences(spark, q.run, q.sql, str(tmp_path)) == ""


def _brute(spark, chunks, vectors, queries, questions, k):
    lists: dict = {}
    for r in sparse.bm25(sparse.index(sparse.sentences(chunks)), sparse.query_terms(queries)).collect():
        lists.setdefault((r.query_id, r.tenant_id), ([], []))[0].append((-round(r.score * 1e9), r.chunk_id is None, r.chunk_id or ""))
    for q, b in questions:
        for t, c, a in vectors:
            if a is None or b is None:
                key = 2.0
            else:
                scale = np.linalg.norm(a) * np.linalg.norm(b)
                key = -round(float(np.dot(a, b) / scale), 9) if scale > 0 else -2.0
            lists.setdefault((q, t), ([], []))[1].append((key, False, c))
    out = set()
    for (q, t), both in lists.items():
        total: dict = {}
        for one in both:
            for rank, (_, none, c) in enumerate(sorted(one), 1):
                total[none, c] = total.get((none, c), 0.0) + 1 / (60 + rank)
        for rank, ((none, c), s) in enumerate(sorted(total.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k], 1):
            out.add((q, t, None if none else c, round(s, 9), rank))
    return out


@pytest.mark.parametrize("case", ["plain", "split", "repeated rows", "few cells"])
def test_equals_brute_force(spark, monkeypatch, case):
    rng = random.Random(3)
    vocab = ["ab", "cd", "ef", "gh", "éa", "жук"]
    lines = lambda: "\n".join(" ".join(rng.choices(vocab, [9, 5, 3, 2, 1, 1], k=rng.choice([1, 2, 2, 5]))) for _ in range(rng.choice([1, 2, 8])))
    rows = [(rng.choice(["t", "t", "u", None]), str(i), lines()) for i in range(90)] + [("t", None, lines()), ("u", "x", None)]
    if case == "repeated rows":
        rows += rows[:5]
    if case == "few cells":
        monkeypatch.setattr(fusion, "CELLS", 40)
    if case == "split":
        monkeypatch.setattr(fusion, "SPLIT", 30)
    chunks = spark.createDataFrame(rows, "tenant_id string, chunk_id string, text string").repartition(5)
    vec = lambda: rng.choice([[float(rng.randint(-3, 3)) for _ in range(3)], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], None])
    vectors = [(t, c, vec()) for t, c, _ in rows[:70]]
    asked = [(1, "ab"), (2, "ab gh éa"), (3, "жук cd nothing"), (4, "nothing"), (5, None), (1, "ef")]
    questions = [(1, [1.0, 2.0, 0.0]), (2, None), (4, [0.0, 1.0, -1.0]), (5, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(vectors, "tenant_id string, chunk_id string, embedding array<float>")
    q = spark.createDataFrame(asked, "query_id bigint, query string")
    got = fusion.whole(chunks, v, q, spark.createDataFrame(questions, "query_id bigint, embedding array<float>"), 10).collect()
    got = [(r.query_id, r.tenant_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in got]
    want = _brute(spark, chunks, vectors, q, questions, 10)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


@pytest.mark.parametrize("big", [1 << 20, 1 << 38, 1 << 47])
def test_packed_scores_come_back(big):
    rng = np.random.default_rng(5)
    query, i = np.repeat([0, 2], 50), np.concatenate([np.sort(rng.integers(7, 7 + n, 50)) for n in (90, 70_000)])
    key = rng.integers(0, big, 100)
    back = [fusion._unpacked(pa.Table.from_batches([fusion._packed([10, 11, 12], "t", False, query, key, i)]).slice(n, 1)) for n in (0, 1)]
    assert np.array_equal(np.concatenate([b[0] for b in back]), key) and np.array_equal(np.concatenate([b[1] for b in back]), i)


@pytest.mark.parametrize("big", [4, 1 << 36, 1 << 60])
def test_order_of_a_list(big):
    rng = np.random.default_rng(6)
    key, i = rng.integers(0, big, 500), rng.integers(1000, 1100, 500)
    assert fusion._in_order(key, i).tolist() == i[np.lexsort((i, -key))].tolist()


def test_cells_follow_scores():
    key = np.unique(np.concatenate([np.arange(3000), np.random.default_rng(7).integers(0, 1 << 50, 3000), [(1 << 62) - 1]]))
    cell = fusion._cell(key)
    assert (np.diff(cell) >= 0).all() and cell[0] == 0 and cell[-1] < 8192
