"""The driver's tables as the engine's entities, and the same in DuckDB SQL for the oracles.

``sql(*names)`` gives a WITH clause that defines the named entities; each is the plain
relational reading of the DataFrame function of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.text import content_hash, normalize_signature

EPOCH = 1704067200000
HOUR = 3600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: tenant = source, project = language, every seventh deleted."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("tenant_id"), F.col("lang").alias("project_id"), none.alias("agent_id"),
        (F.lit(EPOCH) + F.col("doc_id") * HOUR).alias("timestamp_created"), F.lit(None).cast("bigint").alias("timestamp_observed"), F.lit("doc").alias("chunk_type"),
        F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("final").alias("status"),
        F.struct(none.alias("uri"), none.alias("repo"), none.alias("commit"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"), none.alias("tool_name"), none.alias("tool_call_id")).alias("source"),
        "text", F.array(F.concat(F.lit("lang:"), F.col("lang"))).alias("tags"), content_hash(F.col("text")).alias("hash"),
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("status <> 'deleted'")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks of one tenant, an episode for each conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).alias("chunk_id"), F.lit("conv").alias("tenant_id"), F.col("role").alias("project_id"),
        (F.lit(EPOCH) + F.col("conv_id") * HOUR + F.col("turn") * 1000).alias("timestamp_created"), F.lit("message").alias("chunk_type"), "text",
        F.array(F.concat(F.lit("episode:"), F.col("conv_id")), F.concat(F.lit("role:"), F.col("role"))).alias("tags"), content_hash(F.col("text")).alias("hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("tenant_id"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tool_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("trace_id"), F.lit("ops").alias("tenant_id"), F.col("event_type").alias("tool_name"), F.col("user_id").cast("string").alias("session_id"), ms.alias("timestamp_ms"),
        F.col("props").alias("input_json"), F.when(F.col("event_type") == "error", F.concat(F.lit('{"message": "err '), F.col("value").cast("int"), F.lit('"}'))).alias("error_json"), F.col("value").alias("duration_ms"),
    )


def stack_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as stack traces with one message each; ids in hex stand for what normalization removes."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    raw = F.concat(F.lit("err "), F.col("props"), F.lit(" at 0x"), F.lower(F.hex("event_id")))
    return e.select(F.col("event_id").alias("trace_id"), F.lit("ops").alias("tenant_id"), F.col("user_id").cast("string").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), raw.alias("error_message"), normalize_signature(raw).alias("error_signature"))


def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames for each stack trace, named by the event's user and value."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    frame = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return e.select(F.col("event_id").alias("trace_id"), "user_id", "value", frame.alias("frame_idx")).select(
        "trace_id", "frame_idx", F.concat(F.lit("f"), (F.col("user_id") + F.col("frame_idx")) % 10, F.lit(".py")).alias("file"),
        F.concat(F.lit("fn_"), (F.col("user_id") * 3 + F.col("frame_idx")) % 40).alias("function"), (F.col("value").cast("int") % 500 + 1 + F.col("frame_idx")).alias("line"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("chunk_id"), F.col("event_type").alias("project_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"))


KINDS = ("function", "method", "class", "interface", "type", "enum", "variable", "constant", "module")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    start = (F.floor(F.col("p_partkey") / 100) * 10 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 9 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("sym_"), F.col("p_partkey")).alias("name"), kind.alias("kind"), F.col("p_brand").alias("project_id"),
        F.concat(F.lit("f"), F.col("p_partkey") % 100, F.lit(".py")).alias("file"), start.alias("line_start"), (start + 9).alias("line_end"),
    )


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    start = (F.floor(F.col("l_partkey") / 100) * 10 + 1).cast("int")
    once = li.select("l_partkey", "l_suppkey", (start + F.col("l_linenumber")).alias("call_line")).repartition("l_partkey").distinct()  # numbers that give the row; a caller's calls meet once
    return once.select(
        F.col("l_partkey").alias("caller_symbol_id"), F.concat(F.lit("sym_"), F.col("l_suppkey")).alias("callee_name"), F.concat(F.lit("f"), F.col("l_partkey") % 100, F.lit(".py")).alias("call_file"), "call_line",
    )


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("f"), F.col("l_partkey") % 100, F.lit(".py")).alias("source_file"), F.concat(F.lit("m"), F.col("l_suppkey") % 20).alias("imported_module")).distinct()


_HEX = "regexp_replace(regexp_replace(regexp_replace({0}, '0x[0-9a-fA-F]+', '0x...', 'g'), '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}', '<timestamp>', 'g'), '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '<uuid>', 'g')"


def sql_signature(text: str) -> str:
    return _HEX.format(text)


_SQL = {
    "chunks": f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS tenant_id, lang AS project_id, {EPOCH} + doc_id * {HOUR} AS timestamp_created, 'doc' AS chunk_type, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'final' END AS status, source || '/' || doc_id AS path, text, ['lang:' || lang] AS tags, sha256(coalesce(text, '')) AS hash FROM documents",
    "live": "SELECT * FROM chunks WHERE status <> 'deleted'",
    "messages": f"SELECT conv_id || ':' || turn AS chunk_id, 'conv' AS tenant_id, role AS project_id, {EPOCH} + conv_id * {HOUR} + turn * 1000 AS timestamp_created, 'message' AS chunk_type, text, ['episode:' || conv_id, 'role:' || role] AS tags, sha256(coalesce(text, '')) AS hash FROM conversations",
    "vectors": "SELECT vec_id, CAST(label AS VARCHAR) AS tenant_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "tool_traces": "SELECT event_id AS trace_id, 'ops' AS tenant_id, event_type AS tool_name, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS timestamp_ms, props AS input_json, CASE WHEN event_type = 'error' THEN '{\"message\": \"err ' || CAST(trunc(value) AS INTEGER) || '\"}' END AS error_json, value AS duration_ms FROM events",
    "stack_traces": "SELECT event_id AS trace_id, 'ops' AS tenant_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS timestamp_ms, 'err ' || props || ' at 0x' || lower(hex(event_id)) AS error_message, " + sql_signature("'err ' || props || ' at 0x' || lower(hex(event_id))") + " AS error_signature FROM events WHERE event_type = 'error'",
    "stack_frames": "SELECT event_id AS trace_id, CAST(i AS INTEGER) AS frame_idx, 'f' || ((user_id + i) % 10) || '.py' AS file, 'fn_' || ((user_id * 3 + i) % 40) AS function, CAST(CAST(trunc(value) AS INTEGER) % 500 + 1 + i AS INTEGER) AS line FROM events, range(3) AS r(i) WHERE event_type = 'error'",
    "access_log": "SELECT CAST(user_id AS VARCHAR) AS chunk_id, event_type AS project_id, epoch_us(ts) // 1000 AS timestamp_ms FROM events",
    "symbols": f"SELECT p_partkey AS symbol_id, 'sym_' || p_partkey AS name, ({list(KINDS)!r})[p_size % 9 + 1] AS kind, p_brand AS project_id, 'f' || (p_partkey % 100) || '.py' AS file, CAST((p_partkey // 100) * 10 + 1 AS INTEGER) AS line_start, CAST((p_partkey // 100) * 10 + 10 AS INTEGER) AS line_end FROM part",
    "call_edges": "SELECT DISTINCT l_partkey AS caller_symbol_id, 'sym_' || l_suppkey AS callee_name, 'f' || (l_partkey % 100) || '.py' AS call_file, CAST((l_partkey // 100) * 10 + 1 + l_linenumber AS INTEGER) AS call_line FROM lineitem",
    "imports": "SELECT DISTINCT 'f' || (l_partkey % 100) || '.py' AS source_file, 'm' || (l_suppkey % 20) AS imported_module FROM lineitem",
}
_NEEDS = {"live": ("chunks",)}


def sql(*names: str, recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for the named entities and what they need."""
    every = list(dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, ()), name)))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({_SQL[n]})" for n in every)
