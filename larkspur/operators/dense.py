"""Dense retrieval: exact cosine top-k in blocks, and a random-hyperplane index.

The exact search sends the queries, whose number and bytes are checked, to every task as one
matrix; a task multiplies each Arrow batch of vectors with it and keeps k rows a query and
tenant.  What leaves a task is bounded by queries x tenants x k, whatever the corpus.
More queries than ``MAX_QUERY_BYTES`` allows are taken in several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

MAX_QUERY_BYTES = 64 << 20
#: Scores that a task computes at once.
CELLS = 1 << 22
#: Pairs that a task passes on at once.
PAIRS = 1 << 17


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, list]]:
    ids, rows, tenants, size = [], [], [], 0
    for r in queries.select("query_id", "embedding", "tenant_id").toLocalIterator():
        ids.append(r.query_id)
        rows.append(np.array(r.embedding, np.float64))
        tenants.append(r.tenant_id)
        size += 8 * len(r.embedding)
        if size > MAX_QUERY_BYTES:
            yield ids, np.vstack(rows), tenants
            ids, rows, tenants, size = [], [], [], 0
    if ids:
        yield ids, np.vstack(rows), tenants


def topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", same_tenant: bool = False, each_tenant: bool = False) -> DataFrame:
    """(query_id, tenant_id, id_col, score, rank): the ``k`` nearest vectors of each query, by cosine.

    With ``same_tenant`` a query sees only vectors of its tenant (equal ``tenant_id``), with
    ``each_tenant`` it gets ``k`` vectors of every tenant, ranked by tenant.
    Vectors of another dimension than the queries raise an error; null vectors are skipped.
    """
    kinds = dict(vectors.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, tenant_id string, {id_col} {kinds[id_col]}, score double"
    types = (to_arrow_type(queries.schema["query_id"].dataType), pa.string(), to_arrow_type(vectors.schema[id_col].dataType), pa.float64())
    out = None
    for ids, matrix, tenants in _query_blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit(matrix), np.array(tenants, dtype=object)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, qt = shared.value
            best: dict[tuple, list[tuple]] = {}
            for batch in batches:
                m = _matrix(batch.column("embedding"))
                if not len(m):
                    continue
                if m.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have {m.shape[1]} dimensions, queries {q.shape[1]}")
                unit, keys = _unit(m), batch.column(id_col).to_pylist()
                tenant = np.array(batch.column("tenant_id").to_pylist(), dtype=object)
                if same_tenant or each_tenant:
                    groups = [(t, np.flatnonzero(tenant == t), np.flatnonzero(qt == t) if same_tenant else np.arange(len(qid))) for t in set(tenant.tolist())]
                else:
                    groups = [(None, np.arange(len(keys)), np.arange(len(qid)))]
                for t, pick, asks in groups:
                    step = max(1, CELLS // len(pick))
                    for a in range(0, len(asks), step):
                        part = asks[a : a + step]
                        s = np.round(q[part] @ unit[pick].T, 9)
                        last = max(0, len(pick) - k)
                        floor = np.partition(s, last, axis=1)[:, last]
                        who, at = np.nonzero(s >= floor[:, None])  # everything as good as the k-th, so that ties are settled by id below
                        cuts = np.flatnonzero(np.diff(who, prepend=-1))
                        for x, y in zip(cuts, np.append(cuts[1:], len(who)), strict=True):
                            i = int(part[who[x]])
                            new = [(-float(s[who[x], j]), keys[pick[j]], tenant[pick[j]]) for j in at[x:y]]
                            best[i, t] = sorted(best.get((i, t), []) + new, key=lambda r: r[:2])[:k]
            rows = [(qid[i], t, key, -s) for (i, _), found in best.items() for s, key, t in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["query_id", "tenant_id", id_col, "score"])

        part = vectors.where("embedding is not null").select(id_col, "tenant_id", "embedding").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id", *(["tenant_id"] if each_tenant else [])).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id_col, score): the cosine of each query with every vector of its tenant.

    The result is all these pairs, so it grows with queries times vectors; a task makes them in
    blocks of ``PAIRS`` scores from matrices and passes each block on.  Null vectors give null
    scores; vectors of another dimension than the queries raise an error.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {id_col} {dict(vectors.dtypes)[id_col]}, score double"
    types = (to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema[id_col].dataType))
    known = queries.where("embedding is not null and tenant_id is not null")
    out = None
    for ids, matrix, tenants in _query_blocks(known):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit(matrix), np.array(tenants, dtype=object)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, qt = shared.value
            qid = pa.array(qid, types[0])
            asks_of = {t: np.flatnonzero(qt == t) for t in set(qt.tolist())}
            for batch in batches:
                m = _matrix(batch.column("embedding"))
                if not len(m):
                    continue
                if m.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors have {m.shape[1]} dimensions, queries {q.shape[1]}")
                unit, tenant = _unit(m), np.array(batch.column("tenant_id").to_pylist(), dtype=object)
                for t in set(tenant.tolist()) & asks_of.keys():
                    pick, asks = np.flatnonzero(tenant == t), asks_of[t]
                    step = max(1, PAIRS // len(pick))
                    for a in range(0, len(asks), step):
                        part = asks[a : a + step]
                        s = q[part] @ unit[pick].T
                        ask, at = qid.take(pa.array(np.repeat(part, len(pick)))), batch.column(id_col).take(pa.array(np.tile(pick, len(part))))
                        yield pa.RecordBatch.from_arrays([ask, at, pa.array(s.ravel())], ["query_id", id_col, "score"])

        part = vectors.where("embedding is not null").select(id_col, "tenant_id", "embedding").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    none = lambda df, why: df.where(why).select(*df.columns)
    v, n = vectors.select(id_col, "tenant_id", "embedding"), queries.select("query_id", "tenant_id", "embedding")
    missing = none(v, "embedding is null").join(n.drop("embedding"), "tenant_id").unionByName(none(v, "embedding is not null").drop("embedding").join(none(n, "embedding is null"), "tenant_id"))
    missing = missing.select("query_id", id_col, F.lit(None).cast("double").alias("score"))
    return missing if out is None else out.unionByName(missing)


def lsh_bucket(vectors: DataFrame, planes: int = 8, tables: int = 8, dim: int = 64, seed: int = 7) -> DataFrame:
    """Add ``buckets`` (array<long>): the signs of ``planes`` random projections, once for each table."""
    rng = np.random.default_rng(seed)
    normal = rng.normal(size=(tables * planes, dim))
    shared = vectors.sparkSession.sparkContext.broadcast(normal)
    fields = vectors.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("embedding"))
            if len(m):
                bits = ((m @ shared.value.T) > 0).reshape(len(m), tables, planes)
                codes = (bits * (1 << np.arange(planes))).sum(axis=2) + (np.arange(tables) << planes)
            else:
                codes = np.zeros((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "buckets"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return vectors.mapInArrow(run, f"{ddl}, buckets array<bigint>")


def index_stats(vectors: DataFrame) -> DataFrame:
    """(tenant_id, n_vectors, dim, bytes) with two copies of four-byte floats counted."""
    out = vectors.groupBy("tenant_id").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("bigint").alias("dim"))
    return out.withColumn("bytes", F.col("n_vectors") * F.col("dim") * 8)
