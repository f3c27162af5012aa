"""Tool calls and stack traces: parsing, signatures, search and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.text import normalize_signature

FRAME = "array<struct<file: string, function: string, line: int, col: int>>"


def capture(rows: DataFrame) -> DataFrame:
    """Tool calls with their ``input``, ``output`` and ``error`` structs as JSON text (null stays null)."""
    for c in ("input", "output", "error"):
        rows = rows.withColumn(f"{c}_json", F.when(F.col(c).isNotNull(), F.to_json(c))).drop(c)
    return rows


def decode(text: Column, path: str, kind: str = "string") -> Column:
    """Value at a JSON path, or null where the text is no JSON or lacks it."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def _frames(text: Column, pattern: str, order: dict[str, int | None]) -> Column:
    """Frames of all matches; ``order`` gives the group of each field, or None."""
    groups = {f: F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for f, g in order.items() if g}
    zipped = F.arrays_zip(*(c.alias(f) for f, c in groups.items()))

    def field(x: Column, name: str, kind: str) -> Column:
        return (F.nullif(x[name], F.lit("")).try_cast(kind) if order[name] else F.lit(None).cast(kind)).alias(name)

    return F.transform(zipped, lambda x: F.struct(field(x, "file", "string"), field(x, "function", "string"), field(x, "line", "int"), field(x, "col", "int")))


def rust_frames(text: Column) -> Column:
    return _frames(text, r"(?m)^\s*\d+:\s+(\S[^\n]*?)\s*\n\s+at\s+([^\s:]+(?::(?=[\\/])[^\s:]+)?):(\d+)(?::(\d+))?", {"function": 1, "file": 2, "line": 3, "col": 4})


def python_frames(text: Column) -> Column:
    """Innermost frame first."""
    return F.reverse(_frames(text, r'(?m)^\s*File "([^"]+)", line (\d+), in ([^\n]+)', {"file": 1, "line": 2, "function": 3, "col": None}))


def javascript_frames(text: Column) -> Column:
    return _frames(text, r"(?m)^\s*at\s+(?:(?:async\s+)?([^\s(]+)\s+\()?([^\s()]+):(\d+):(\d+)\)?", {"function": 1, "file": 2, "line": 3, "col": 4})


def generic_frames(text: Column) -> Column:
    return _frames(text, r"([\w./\\-]+\.[A-Za-z]+):(\d+)(?::(\d+))?", {"file": 1, "line": 2, "col": 3, "function": None})


def dialect(text: Column) -> Column:
    """python, rust, javascript or generic; Rust's marks are tried before JavaScript's ``at`` lines."""
    python = F.contains(text, F.lit("Traceback (most recent call last)")) | text.rlike(r'(?m)^\s*File "[^"]+", line \d+')
    rust = F.contains(text, F.lit("panicked at")) | text.rlike(r"(?m)^\s*\d+:\s+\S[^\n]*\n\s+at\s+\S+:\d+")
    return F.when(python, "python").when(rust, "rust").when(text.rlike(r"(?m)^\s*at\s+"), "javascript").otherwise("generic")


def parse(traces: DataFrame, text_col: str = "full_trace") -> DataFrame:
    """Add ``dialect``, ``error_message``, ``error_signature`` and ``frames`` to raw traces."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    first = F.trim(F.element_at(F.split(t, "\n"), 1))
    panic = F.regexp_extract(t, r"panicked at '([^']*)'", 1)
    modern = F.regexp_extract(t, r"panicked at [^\n]*:\n([^\n]+)", 1)
    last = F.element_at(F.regexp_extract_all(t, F.lit(r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|Exit|[A-Z]\w*)?(?::[^\n]*)?)$"), F.lit(1)), -1)
    d = F.col("dialect")
    message = F.when(d == "python", F.coalesce(last, first)).when(d == "rust", F.coalesce(F.nullif(panic, F.lit("")), F.nullif(modern, F.lit("")), first)).otherwise(first)
    frames = F.when(d == "python", python_frames(t)).when(d == "rust", rust_frames(t)).when(d == "javascript", javascript_frames(t)).otherwise(generic_frames(t))
    return traces.withColumn("dialect", dialect(t)).withColumn("error_message", message).withColumn("error_signature", normalize_signature(F.col("error_message"))).withColumn("frames", frames)


def frame_rows(parsed: DataFrame) -> DataFrame:
    """Child rows (trace_id, frame_idx from 0 at the top, file, function, line, col)."""
    return parsed.select("trace_id", F.posexplode("frames").alias("frame_idx", "f")).select("trace_id", "frame_idx", "f.*")


def within(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("timestamp_ms") >= start)
    return df if end is None else df.where(F.col("timestamp_ms") <= end)


def tool_calls(traces: DataFrame, tool: str | None = None, session: str | None = None, start: int | None = None, end: int | None = None, errors_only: bool = False, limit: int = 100) -> DataFrame:
    """Newest tool calls that satisfy every filter, at most ``limit`` (100 at most)."""
    df = within(traces, start, end)
    if tool is not None:
        df = df.where(F.col("tool_name") == tool)
    if session is not None:
        df = df.where(F.col("session_id") == session)
    if errors_only:
        df = df.where("error_json is not null")
    return df.orderBy(F.desc("timestamp_ms"), "trace_id").limit(min(limit, 100))


def find_errors(traces: DataFrame, frames: DataFrame, signature: str | None = None, function: str | None = None, file: str | None = None, start: int | None = None, end: int | None = None, limit: int = 100) -> DataFrame:
    """Newest error traces by part of the signature, a frame's function or file, and time; filters come before the limit."""
    df = within(traces, start, end)
    if signature is not None:
        df = df.where(F.contains("error_signature", F.lit(signature)))
    if function is not None:
        df = df.join(frames.where(F.col("function") == function).select("trace_id"), "trace_id", "left_semi")
    if file is not None:
        df = df.join(frames.where(F.col("file") == file).select("trace_id"), "trace_id", "left_semi")
    return df.orderBy(F.desc("timestamp_ms"), "trace_id").limit(min(limit, 100))


def errors_by_function(traces: DataFrame, frames: DataFrame, functions: DataFrame) -> DataFrame:
    """(function, trace_id, timestamp_ms) of the traces with a frame in each wanted function."""
    hits = frames.join(functions, "function", "left_semi").select("function", "trace_id").distinct()
    return hits.join(traces.select("trace_id", "timestamp_ms", "error_signature"), "trace_id")


def frames_of(frames: DataFrame) -> DataFrame:
    """(trace_id, frames): the frames of each trace in order."""
    return frames.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "file", "function", "line"))).alias("frames"))


def error_summary(traces: DataFrame) -> DataFrame:
    """(error_signature, n, first_seen, last_seen)."""
    return traces.groupBy("error_signature").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_seen"), F.max("timestamp_ms").alias("last_seen"))
