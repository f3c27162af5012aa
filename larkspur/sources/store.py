"""A chunk store over Parquet in one base folder: chunks, with their vectors, and tombstones.

Reads see ``chunks`` without the tombstoned rows; writes append; ``compact`` rewrites the
chunks without deleted rows and few files a tenant, and clears the tombstones.  Files are
partitioned by tenant, so every read of one tenant prunes the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur import schemas
from larkspur.functions.text import check_k, check_range, check_tenant
from larkspur.operators import dense, ingest, lexquery, search, sparse

MAX_RECORDS = 10_000
CHUNKS = "chunk_id string, tenant_id string, project_id string, timestamp_created bigint, chunk_type string, status string, text string, tags array<string>, hash string, embedding array<float>"
TOMBSTONES = "tenant_id string, chunk_id string, deleted_at bigint"


class ChunkStore:
    """Add, get, list, search, delete, statistics and compaction of chunks under ``base``.

    ``embedder`` makes an ARRAY<FLOAT> column of a text column; with one, chunks keep their
    vectors and searches fuse the nearest vectors with the BM25 list.
    """

    def __init__(self, spark: SparkSession, base: str, embedder: Callable[[Column], Column] | None = None):
        self.spark, self.base, self.embedder = spark, base.rstrip("/"), embedder

    # --- folders ---

    def _path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name)))

    def _folders(self) -> list[str]:
        """Names of the whole chunk folders, oldest first."""
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        names = [f.getPath().getName() for f in self._fs().listStatus(base)] if self._fs().exists(base) else []
        return sorted((n for n in names if n.startswith("chunks-") and self._exists(f"{n}/_SUCCESS")), key=lambda n: int(n.split("-")[1]))

    def _current(self) -> str:
        """Name of the folder that writers append to: the newest whole one; compaction moves on to a new one."""
        return (self._folders() or ["chunks-0"])[-1]

    def _files(self, folder: str) -> list[str]:
        """Data files below a folder."""
        jvm = self.spark.sparkContext._jvm
        found, it = [], self._fs().listFiles(jvm.org.apache.hadoop.fs.Path(self._path(folder)), True)
        while it.hasNext():
            path = it.next().getPath()
            if not path.getName().startswith(("_", ".")):
                found.append(path.toString())
        return found

    def _read(self, folder: str, files: list[str] | None = None) -> DataFrame:
        """All chunks of a folder, or those of some of its files."""
        reader = self.spark.read.schema(CHUNKS)
        return reader.parquet(self._path(folder)) if files is None else reader.option("basePath", self._path(folder)).parquet(*files)

    def chunks(self) -> DataFrame:
        """All stored chunks, deleted ones included; rows that were added to a folder while it was compacted stay there."""
        return reduce(DataFrame.unionByName, [self._read(n) for n in self._folders()], self.spark.createDataFrame([], CHUNKS))

    def tombstones(self) -> DataFrame:
        if not self._exists("tombstones"):
            return self.spark.createDataFrame([], TOMBSTONES)
        return self.spark.read.schema(TOMBSTONES).parquet(self._path("tombstones")).dropDuplicates(["tenant_id", "chunk_id"])

    def live(self, tenant: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
        rows = search.live(self.chunks() if chunks is None else chunks, self.tombstones()).dropDuplicates(["tenant_id", "chunk_id"])
        return rows if tenant is None else rows.where(F.col("tenant_id") == check_tenant(tenant))

    # --- writes ---

    def add_batch(self, rows: DataFrame) -> DataFrame:
        """Append raw rows (see ``ingest.prepare``); returns (tenant_id, row ids in ``chunk_id``) of the new chunks.

        Nothing is written if any row is invalid (ValueError).
        """
        bad = ingest.invalid(rows).groupBy("reason").count().collect()  # at most one row a reason
        if bad:
            raise ValueError("invalid rows: " + ", ".join(f"{r['count']} by {r['reason']}" for r in sorted(bad)))
        ready = ingest.prepare(rows)
        vector = self.embedder(F.col("text")) if self.embedder else F.lit(None)
        ready = ready.withColumn("embedding", vector.cast("array<float>"))
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        ready.select(columns).write.mode("append").partitionBy("tenant_id").option("maxRecordsPerFile", MAX_RECORDS).parquet(self._path(self._current()))
        return ready.select("tenant_id", "chunk_id")

    def add(self, tenant: str, text: str, chunk_type: str = "other", project: str | None = None, episode: str | None = None, tags: tuple[str, ...] = (), timestamp_ms: int = 0) -> str:
        """Add one text; the id of its first piece."""
        check_tenant(tenant)
        row = self.spark.createDataFrame([(tenant, project, chunk_type, episode, list(tags), text, timestamp_ms)], "tenant_id string, project_id string, chunk_type string, episode_id string, tags array<string>, text string, timestamp_created bigint")
        self.add_batch(row)
        first = ingest.prepare(row).orderBy(F.expr("coalesce(cast(regexp_extract(array_join(tags, ' '), 'chunk_index:(\\\\d+)', 1) as int), 0)")).first()
        return first.chunk_id

    def delete(self, tenant: str, chunk_id: str, now_ms: int = 0) -> bool:
        """Tombstone a chunk; False where it is absent or deleted already."""
        if self.get(tenant, chunk_id).isEmpty():
            return False
        self.delete_batch(self.spark.createDataFrame([(tenant, chunk_id)], "tenant_id string, chunk_id string"), now_ms)
        return True

    def delete_batch(self, keys: DataFrame, now_ms: int = 0) -> None:
        keys.select("tenant_id", "chunk_id", F.lit(now_ms).cast("bigint").alias("deleted_at")).write.mode("append").parquet(self._path("tombstones"))

    # --- reads ---

    def get(self, tenant: str, chunk_id: str) -> DataFrame:
        return self.live(tenant).where(F.col("chunk_id") == chunk_id)

    def list_chunks(self, tenant: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return self.live(tenant).orderBy(F.desc("timestamp_created"), "chunk_id").offset(offset).limit(limit)

    def search(self, tenant: str, text: str, k: int = 20, project: str | None = None, types: tuple[str, ...] = (), episode: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """The tenant's live chunks that pass the filters, with citations; repaired and tried again if empty.

        ``text`` is in the query language of ``lexquery.parse``.  Ranked by BM25 over sentences,
        with an embedder fused by rank with the nearest vectors.
        """
        check_k(k)
        check_range(start, end)
        pool = self.live(tenant)

        def run(queries: DataFrame, rows: DataFrame) -> DataFrame:
            scored = lexquery.score(lexquery.positional(sparse.sentences(rows)), queries)
            best = scored.groupBy("query_id", "tenant_id", "chunk_id").agg(F.max("score").alias("score"))
            lexical = sparse.top(best, search.CHANNEL_K, tie=("chunk_id",))
            if self.embedder is None:
                return lexical
            vectors = rows.where("embedding is not null").select("tenant_id", "chunk_id", "embedding")
            asked = queries.select("query_id", F.lit(tenant).alias("tenant_id"), self.embedder(F.col("query")).cast("array<float>").alias("embedding"))
            near = dense.topk(vectors, asked, search.CHANNEL_K, "chunk_id", same_tenant=True)
            return search.hybrid(near, lexical, search.CHANNEL_K).select(lexical.columns)

        asked = self.spark.createDataFrame([(0, text)], "query_id int, query string")
        found = search.search(asked, pool, run, k, project=project, types=types, episode=episode, start=start, end=end)
        return search.cite(found.join(pool, ["tenant_id", "chunk_id"])).orderBy("rank")

    def stats(self, tenant: str | None = None) -> DataFrame:
        gone = self.tombstones().select("tenant_id", "chunk_id", F.lit(True).alias("gone"))
        rows = self.chunks().dropDuplicates(["tenant_id", "chunk_id"]).join(gone, ["tenant_id", "chunk_id"], "left").withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status")))
        return search.stats(rows if tenant is None else rows.where(F.col("tenant_id") == check_tenant(tenant)))

    def tenants(self) -> DataFrame:
        return self.chunks().select("tenant_id").distinct()

    def disk_stats(self) -> DataFrame:
        """(tenant_id, bytes, files) of the chunk files."""
        files = self.spark.createDataFrame([], "tenant_id string, file_path string, file_size bigint")
        for name in self._folders():
            files = files.unionByName(self._read(name).select("tenant_id", "_metadata.file_path", "_metadata.file_size").distinct())
        return files.groupBy("tenant_id").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("files"))

    # --- maintenance ---

    def compact(self, files_a_tenant: int = 1) -> bool:
        """Rewrite without deleted rows and clear the tombstones; False where there is nothing to do.

        Only the files and tombstones that are there at the start are rewritten and then removed,
        so what is added or deleted meanwhile stays.  The new folder is whole before readers see
        it; until the old files are gone a row may be read twice, which ``live`` drops.
        """
        old = {name: files for name in self._folders() if (files := self._files(name))}
        if not old:
            return False
        jvm = self.spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(self._path("tombstones"))
        seen = [f.getPath() for f in self._fs().listStatus(marks)] if self._exists("tombstones") else []
        name = f"chunks-{int(self._current().split('-')[1]) + 1}"
        rows = reduce(DataFrame.unionByName, [self._read(n, files) for n, files in old.items()])
        self.live(None, rows).repartition("tenant_id", (F.pmod(F.xxhash64("chunk_id"), F.lit(files_a_tenant)))).write.mode("overwrite").partitionBy("tenant_id").option("maxRecordsPerFile", MAX_RECORDS).parquet(self._path(name))
        for path in [*(jvm.org.apache.hadoop.fs.Path(f) for files in old.values() for f in files), *seen]:
            self._fs().delete(path, True)
        return True


def read_eval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, documents, qrels) of an evaluation JSON file; document types are canonical, ``content`` stands for ``text``."""
    raw = spark.read.option("multiLine", True).json(path)
    fields = {f.name for f in raw.schema["documents"].dataType.elementType.fields}
    docs = raw.select(F.explode("documents").alias("d")).select(
        F.col("d.id").alias("id"), (F.col("d.text") if "text" in fields else F.col("d.content")).alias("text"),
        (F.col("d.type") if "type" in fields else F.lit(None).cast("string")).alias("type"),
    )
    kind = F.col("type")
    for alias, to in schemas.EVAL_TYPE_ALIASES.items():
        kind = F.when(F.col("type") == alias, to).otherwise(kind)
    queries = raw.select(F.explode("queries").alias("q")).select("q.*")
    name = "relevant" if "relevant" in queries.columns else "relevant_docs"
    qrels = queries.select(F.col("id").alias("query_id"), F.explode(name).alias("doc_id"))
    return queries, docs.withColumn("type", kind), qrels
