"""The tool surface over one base folder: memory, code and debug calls with plain parameters.

Each method checks its arguments on the driver (ValueError) and returns a DataFrame or a plain
value.  Code and trace tables live next to the chunk store, partitioned by tenant.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.text import check_k, check_range, check_tenant
from larkspur.operators import maintenance, search, structural, traces
from larkspur.sources.store import ChunkStore

SYMBOLS = "tenant_id string, project_id string, file string, symbol_id string, name string, kind string, line_start int, line_end int, parent string, signature string, docstring string, visibility string, language string, version bigint"
CALLS = "tenant_id string, project_id string, call_file string, call_line int, call_col int, callee_name string, call_type string, caller_symbol_id string, version bigint"
IMPORTS = "tenant_id string, project_id string, source_file string, imported_module string, import_line int, is_relative boolean, version bigint"
TOOL_TRACES = "tenant_id string, trace_id string, project_id string, session_id string, tool_name string, timestamp_ms bigint, input_json string, output_json string, error_json string, context_tags array<string>, duration_ms bigint"
STACK_TRACES = "tenant_id string, trace_id string, project_id string, session_id string, timestamp_ms bigint, error_signature string, error_message string, full_trace string"
STACK_FRAMES = "tenant_id string, trace_id string, frame_idx int, file string, function string, line int, col int"
QUERY_METRICS = "tenant_id string, query_id string, timestamp_ms bigint, total_ms double, cache_hit boolean, hot_hit boolean"


class Memory:
    """Memory, code and debug calls of one base folder."""

    def __init__(self, spark: SparkSession, base: str, embedder: Callable[[Column], Column] | None = None):
        self.spark, self.store = spark, ChunkStore(spark, base, embedder)

    def _table(self, name: str, schema: str, tenant: str) -> DataFrame:
        check_tenant(tenant)
        if not self.store._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.store._path(name)).where(F.col("tenant_id") == tenant)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("tenant_id").parquet(self.store._path(name))

    # --- memory ---

    def memory_add(self, tenant: str, text: str, type: str = "other", project: str | None = None, episode: str | None = None, tags: tuple[str, ...] = (), timestamp_ms: int = 0) -> str:  # noqa: A002
        return self.store.add(tenant, text, type, project, episode, tags, timestamp_ms)

    def memory_add_batch(self, rows: DataFrame) -> DataFrame:
        return self.store.add_batch(rows)

    def memory_search(self, tenant: str, query: str, k: int = 20, **wanted) -> DataFrame:
        return self.store.search(tenant, query, k, **wanted)

    def memory_get(self, tenant: str, chunk_id: str) -> DataFrame:
        return self.store.get(tenant, chunk_id)

    def memory_delete(self, tenant: str, chunk_id: str) -> bool:
        return self.store.delete(tenant, chunk_id)

    def memory_stats(self, tenant: str | None = None) -> DataFrame:
        return self.store.stats(tenant)

    def memory_metrics(self, tenant: str, include_recent: bool = False) -> DataFrame:
        """Latency percentiles of the tenant's recorded queries; with ``include_recent`` a row for each of the ten newest of them beside these figures."""
        rows = self._table("query_metrics", QUERY_METRICS, tenant)
        figures = maintenance.latency_stats(rows, 1000, "tenant_id", "total_ms", ("timestamp_ms", "query_id"))
        if not include_recent:
            return figures
        return maintenance.recent(rows, 10, "tenant_id", ("timestamp_ms", "query_id")).join(figures, "tenant_id")

    def record_query(self, rows: DataFrame) -> None:
        """Append rows of query metrics."""
        self._append("query_metrics", rows.select([c.split()[0] for c in QUERY_METRICS.split(", ")]))

    def memory_compact(self, tenant: str | None = None, force: bool = False) -> str:
        """``completed``, or ``skipped`` where no tenant (or not this one) is due."""
        rows = self.store.stats(tenant).withColumn("due", F.col("deleted") / F.col("total") > 0.20)
        segments = self.store.disk_stats()
        if tenant is not None:
            segments = segments.where(F.col("tenant_id") == check_tenant(tenant))
        if not force and rows.where("due").isEmpty() and segments.where("files > 10").isEmpty():
            return "skipped"
        return "completed" if self.store.compact() else "skipped"

    def memory_consolidate_episode(self, tenant: str, episode: str, max_chunks: int = 50, delete_sources: bool = False, timestamp_ms: int = 0) -> str:
        """Id of a new summary chunk of an episode; ValueError where the episode has no chunks."""
        own = search.filters(self.store.live(tenant), episode=episode)
        summary = search.consolidate(own, max_chunks).first()
        if summary is None:
            raise ValueError(f"episode {episode!r} has no chunks")
        made = self.store.add(tenant, summary.text, "summary", episode=episode, tags=tuple(summary.tags[1:]), timestamp_ms=timestamp_ms)
        if delete_sources:
            newest = own.where(F.col("chunk_type") != "summary").orderBy(F.desc("timestamp_created"), "chunk_id").limit(max_chunks)
            self.store.delete_batch(newest.select("tenant_id", "chunk_id"), timestamp_ms)
        return made

    # --- code ---

    def index_files(self, tenant: str, files: DataFrame, project: str | None = None, version: int = 0) -> None:
        """Extract and store symbols, calls and imports of files (path, content); a later version of a file replaces earlier ones."""
        check_tenant(tenant)
        stamp = [F.lit(tenant).alias("tenant_id"), F.lit(project).cast("string").alias("project_id")]
        sym = structural.extract(files, "symbols").withColumn("symbol_id", F.left(F.sha2(F.concat_ws(":", F.lit(tenant), "path", "name", F.col("line_start").cast("string"), F.lit(str(version))), 256), F.lit(32)))
        sym = sym.select(*stamp, F.col("path").alias("file"), "symbol_id", "name", "kind", "line_start", "line_end", "parent", "signature", "docstring", "visibility", "language", F.lit(version).cast("bigint").alias("version"))
        calls = structural.extract(files, "calls").select(F.col("path").alias("call_file"), "call_line", "call_col", "callee_name", "call_type")
        owned = structural.attribute_calls(calls, sym)
        calls = calls.join(owned, ["call_file", "call_line", "callee_name"]).select(*stamp, "call_file", "call_line", "call_col", "callee_name", "call_type", "caller_symbol_id", F.lit(version).cast("bigint").alias("version"))
        imports = structural.extract(files, "imports").select(*stamp, F.col("path").alias("source_file"), "imported_module", "import_line", "is_relative", F.lit(version).cast("bigint").alias("version"))
        for name, rows in (("symbols", sym), ("call_edges", calls), ("imports", imports)):
            self._append(name, rows)
        self._append("indexed_files", files.select(F.lit(tenant).alias("tenant_id"), "path", F.lit(version).cast("bigint").alias("version")))

    def _newest(self, name: str, schema: str, tenant: str, file: str) -> DataFrame:
        last = self._table("indexed_files", "tenant_id string, path string, version bigint", tenant).groupBy(F.col("path").alias(file)).agg(F.max("version").alias("version"))
        return self._table(name, schema, tenant).join(last, [file, "version"])

    def _names(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "name string")

    def code_find_definition(self, tenant: str, name: str, project: str | None = None) -> DataFrame:
        return structural.find_definition(self._newest("symbols", SYMBOLS, tenant, "file"), self._names(name), project).orderBy("position")

    def code_find_references(self, tenant: str, name: str) -> DataFrame:
        return structural.find_references(self._newest("symbols", SYMBOLS, tenant, "file"), self._newest("call_edges", CALLS, tenant, "call_file"), self._names(name)).orderBy("file", "line")

    def code_find_callers(self, tenant: str, name: str, depth: int = 1) -> DataFrame:
        return structural.find_callers(self._newest("symbols", SYMBOLS, tenant, "file"), self._newest("call_edges", CALLS, tenant, "call_file"), self._names(name), max(1, min(depth, 3))).orderBy("depth", "caller")

    def code_find_imports(self, tenant: str, module: str) -> DataFrame:
        return structural.find_imports(self._newest("imports", IMPORTS, tenant, "source_file"), module)

    # --- debug ---

    def capture_tool_call(self, tenant: str, tool: str, timestamp_ms: int, input: dict | None = None, output: dict | None = None, error: dict | None = None, project: str | None = None, session: str | None = None, tags: tuple[str, ...] = (), duration_ms: int | None = None) -> str:  # noqa: A002
        check_tenant(tenant)
        key = uuid.uuid4().hex
        dump = lambda x: None if x is None else json.dumps(x, sort_keys=True)
        self._append("tool_traces", self.spark.createDataFrame([(tenant, key, project, session, tool, timestamp_ms, dump(input), dump(output), dump(error), list(tags), duration_ms)], TOOL_TRACES))
        return key

    def index_stack_traces(self, rows: DataFrame) -> None:
        """Parse and store raw traces (tenant_id, trace_id, project_id, session_id, timestamp_ms, full_trace) and their frames."""
        parsed = traces.parse(rows)
        self._append("stack_traces", parsed.select([c.split()[0] for c in STACK_TRACES.split(", ")]))
        self._append("stack_frames", traces.frame_rows(parsed).join(rows.select("tenant_id", "trace_id"), "trace_id").select([c.split()[0] for c in STACK_FRAMES.split(", ")]))

    def debug_find_tool_calls(self, tenant: str, tool: str | None = None, session: str | None = None, start: int | None = None, end: int | None = None, errors_only: bool = False, limit: int = 20) -> DataFrame:
        check_k(limit)
        check_range(start, end)
        return traces.tool_calls(self._table("tool_traces", TOOL_TRACES, tenant), tool, session, start, end, errors_only, limit)

    def debug_find_errors(self, tenant: str, signature: str | None = None, function: str | None = None, file: str | None = None, start: int | None = None, end: int | None = None, limit: int = 20, include_frames: bool = True) -> DataFrame:
        check_k(limit)
        check_range(start, end)
        frames = self._table("stack_frames", STACK_FRAMES, tenant)
        found = traces.find_errors(self._table("stack_traces", STACK_TRACES, tenant), frames, signature, function, file, start, end, limit)
        return found.join(traces.frames_of(frames), "trace_id", "left") if include_frames else found
