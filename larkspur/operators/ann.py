"""Approximate nearest neighbours by cosine: inverted lists with multi-probe search and exact rescoring.

Centroids are fitted on a bounded sample and every vector is stored in the list of its
nearest one.  A query probes the lists whose centroids are nearest to it and scores all their
vectors exactly, so scores are right and only neighbours in unprobed lists are missed.  How
many lists to probe is not guessed: ``calibrate`` measures, against the exact search on a
sample of stored vectors, the least number that reaches a wanted recall.

Lists of many vectors are split into blocks, so a task never holds more than a block; queries
stream past the blocks they probe in one equi-join on the block, and ``k`` rows a query and
block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.operators import dense

#: Rows of the sample that centroids are fitted on, and stored vectors that probes are measured with.
SAMPLE, MEASURED = 8192, 64
MAX_LISTS = 1024
BLOCK = 4096
CELLS = 1 << 21


@dataclass
class Model:
    """``centroids`` (unit rows) and how many lists a search probes."""

    centroids: np.ndarray
    probes: int = 1


def fit(vectors: DataFrame, lists: int | None = None, rounds: int = 10, seed: int = 5) -> Model:
    """Spherical k-means on ``SAMPLE`` vectors, chosen by hash; ``lists`` is the square root of the row count unless given."""
    rows = vectors.where("embedding is not null")
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()
    m = dense._unit(dense._matrix(picked.column("embedding").combine_chunks())) if n else np.zeros((1, 1))
    distinct = np.unique(m, axis=0)
    k = min(lists or max(1, round(n**0.5)), MAX_LISTS, len(distinct))
    centre = distinct[np.sort(np.random.default_rng(seed).choice(len(distinct), k, replace=False))]
    for _ in range(rounds):
        of = (m @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, m)
        centre = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, dense._unit(sums), centre)
    return Model(centre)


def assign(vectors: DataFrame, model: Model) -> DataFrame:
    """``vectors`` with their ``list``; rows without a vector are left out, another dimension is an error."""
    centre = model.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = dense._unit(dense._matrix(batch.column("embedding")))
            if len(m) and m.shape[1] != centre.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} dimensions, centroids {centre.shape[1]}")
            of = (m @ centre.T).argmax(axis=1) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], [*batch.schema.names, "list"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.where("embedding is not null").mapInArrow(run, f"{ddl}, list int")


def _probed(queries: DataFrame, model: Model, sizes: dict[int, int], block: int) -> DataFrame:
    """A row for each query and block of the lists it probes."""
    centre, probes = model.centroids, model.probes
    blocks = np.array([-(-sizes.get(i, 0) // block) for i in range(len(centre))], np.int64)
    first = np.cumsum(blocks) - blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = dense._unit(dense._matrix(batch.column("embedding")))
            if not len(q):
                continue
            if q.shape[1] != centre.shape[1]:
                raise ValueError(f"queries have {q.shape[1]} dimensions, centroids {centre.shape[1]}")
            of = np.argsort(-(q @ centre.T), axis=1, kind="stable")[:, :probes].ravel()
            who = np.repeat(np.arange(len(q)), len(of) // len(q))
            n = blocks[of]
            at = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = np.repeat(who, n)
            for a in range(0, len(who), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 4096], pa.int64()), *batch.take(pa.array(who[a : a + 4096])).columns], ["block", *batch.schema.names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"block bigint, {ddl}")


def _score(k: int, same_tenant: bool):
    """Stream (block, asks?, …) rows sorted by block with stored vectors first; the ``k`` best of each query and block."""
    names = ["query_id", "tenant_id", "id", "score"]

    def against(stored: pa.Table, m: np.ndarray, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = dense._unit(dense._matrix(asked.column("embedding")))
        keys, tenant = stored["id"].combine_chunks(), np.array(stored["tenant_id"].to_pylist(), object)
        place = np.argsort(np.argsort(np.array(keys.to_pylist())))
        wanted = np.array(asked.column("tenant_id").to_pylist(), object)
        step = max(1, CELLS // len(m))
        for a in range(0, len(q), step):
            s = np.round(q[a : a + step] @ m.T, 9)
            if same_tenant:
                s[wanted[a : a + step, None] != tenant] = -np.inf
            floor = np.partition(s, -min(k, len(m)), axis=1)[:, -min(k, len(m))]
            who, at = np.nonzero((s >= floor[:, None]) & (s > -np.inf))  # ties of the k-th stay until ids settle them
            order = np.lexsort((place[at], -s[who, at], who))
            who, at = who[order], at[order]
            start = np.flatnonzero(np.diff(who, prepend=-1))
            keep = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
            who, at = who[keep], at[keep]
            yield pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(a + who)), pa.array(tenant[at], pa.string()), keys.take(pa.array(at)), pa.array(s[who, at])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, stored, m = [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero((np.diff(at, prepend=at[0] - 1) != 0) | (np.diff(asks, prepend=-1) != 0))
            for x, y in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                part = batch.slice(x, y - x)
                if at[x] != block:
                    held, block, stored = [], at[x], None
                if not asks[x]:
                    held.append(part)
                elif held:
                    if stored is None:
                        stored = pa.Table.from_batches(held)
                        m = dense._unit(dense._matrix(stored["embedding"].combine_chunks()))
                    yield from against(stored, m, part)

    return run


def search(listed: DataFrame, queries: DataFrame, model: Model, k: int, id_col: str = "vec_id", same_tenant: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, tenant_id, id_col, score, rank) as ``dense.topk`` gives them, from the probed lists alone.

    ``listed`` has ``id_col``, ``tenant_id``, ``embedding`` and ``list``; ``queries`` has
    ``query_id``, ``tenant_id`` and ``embedding``.  Ties go by id; queries without a vector get no rows.
    """
    spark = listed.sparkSession
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    blocks, first = {}, 0
    for i in sorted(sizes):
        blocks[i] = (first, -(-sizes[i] // block))
        first += blocks[i][1]
    deal = spark.createDataFrame([(i, a, n) for i, (a, n) in blocks.items()], "list int, first bigint, blocks bigint")
    kind, asked = listed.schema[id_col].dataType, queries.schema["query_id"].dataType
    own = listed.join(F.broadcast(deal), "list").select(
        (F.col("first") + F.pmod(F.xxhash64(id_col), F.col("blocks"))).alias("block"), F.lit(0).alias("asks"), F.lit(None).cast(asked).alias("query_id"), F.col(id_col).alias("id"), "tenant_id", "embedding",
    )
    wanted = queries.where("embedding is not null").select("query_id", F.col("tenant_id").cast("string").alias("tenant_id"), F.col("embedding").cast(listed.schema["embedding"].dataType).alias("embedding"))
    asks = _probed(wanted, model, sizes, block).select("block", F.lit(1).alias("asks"), "query_id", F.lit(None).cast(kind).alias("id"), "tenant_id", "embedding")
    dealt = own.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks")
    hits = dealt.mapInArrow(_score(k, same_tenant), f"query_id {asked.simpleString()}, tenant_id string, id {kind.simpleString()}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def calibrate(listed: DataFrame, model: Model, k: int, recall: float, id_col: str = "vec_id", same_tenant: bool = False) -> Model:
    """The model with the least number of probes whose mean recall of the ``k`` nearest, over ``MEASURED`` stored vectors, reaches ``recall``.

    A vector's own row is not counted among its neighbours.
    """
    asked = listed.orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(MEASURED).select(F.col(id_col).alias("query_id"), "tenant_id", "embedding")
    exact = dense.topk(listed, asked, k + 1, id_col, same_tenant=same_tenant).where(F.col("query_id") != F.col(id_col)).where(F.col("rank") <= k + 1)
    near = exact.join(listed.select(F.col(id_col), "list"), id_col).groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    order = {r.query_id: np.argsort(-(dense._unit(np.array([r.embedding], float)) @ model.centroids.T)[0], kind="stable").tolist() for r in asked.collect()}
    places = [[order[r.query_id].index(x) for x in r.lists] for r in near.collect()]  # MEASURED rows of k
    for probes in range(1, len(model.centroids) + 1):
        if not places or np.mean([np.mean([p < probes for p in row]) for row in places]) >= recall:
            return Model(model.centroids, probes)
    return Model(model.centroids, len(model.centroids))


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, hits, wanted, recall) of found against exact neighbours."""
    both = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return both.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))


class VectorIndex:
    """A stored index under ``base``: centroids, vectors by list, and marks of rows that are gone.

    Inserting an id again replaces its vector; reads of a list prune the others.  ``refit``
    makes a new index folder from what is live, with centroids for its present size.
    """

    VECTORS = "id string, tenant_id string, embedding array<float>, batch bigint, list int"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.model: Model | None = None

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        if not self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def create(self, vectors: DataFrame, k: int = 10, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
        """Fit, store and calibrate on ``vectors`` (id, tenant_id, embedding)."""
        rows = vectors.select(F.col("id").cast("string").alias("id"), "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"))
        self.model = fit(rows, lists)
        self._append(rows, 0)
        self.model = calibrate(self.live(), self.model, k, recall, "id")
        centre = [(i, [float(x) for x in c], self.model.probes) for i, c in enumerate(self.model.centroids)]
        self.spark.createDataFrame(centre, "list int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{self.base}/centroids")
        return self

    def open(self) -> VectorIndex:
        rows = self.spark.read.parquet(f"{self.base}/centroids").orderBy("list").collect()  # at most MAX_LISTS
        self.model = Model(np.array([r.centroid for r in rows]), rows[0].probes)
        return self

    def _append(self, rows: DataFrame, batch: int) -> None:
        listed = assign(rows.dropDuplicates(["id"]), self.model).withColumn("batch", F.lit(batch).cast("bigint"))
        listed.select("id", "tenant_id", "embedding", "batch", "list").repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.base}/vectors")

    def _all(self) -> DataFrame:
        return self._read("vectors", self.VECTORS)

    def live(self) -> DataFrame:
        return self._all().join(self._read("gone", "id string, batch bigint"), ["id", "batch"], "left_anti")

    def insert(self, vectors: DataFrame) -> None:
        """Add vectors (id, tenant_id, embedding); known ids get the new vector.  Old rows are marked before new ones are written."""
        rows = vectors.select(F.col("id").cast("string").alias("id"), "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"))
        batch = (self._all().agg(F.max("batch")).first()[0] or 0) + 1
        self._forget(rows)
        self._append(rows, batch)

    def delete(self, ids: DataFrame) -> None:
        self._forget(ids.select(F.col("id").cast("string").alias("id")))

    def _forget(self, ids: DataFrame) -> None:
        self.live().join(ids.select("id").distinct(), "id", "left_semi").select("id", "batch").write.mode("append").parquet(f"{self.base}/gone")

    def search(self, queries: DataFrame, k: int, same_tenant: bool = False) -> DataFrame:
        """The ``k`` nearest live vectors of each query (query_id, tenant_id, embedding)."""
        return search(self.live(), queries, self.model, k, "id", same_tenant)
