"""Routed search: every query goes to the operator of its intent, all queries of an intent at once.

``structural`` answers symbol, import and file questions from the code tables and error and
tool questions from the traces.  ``search`` adds the semantic list where the intent asks for
it, where context is blended in, or where a code question found nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.operators import router, structural as C

TRACES = ("errors", "tool_calls")


@dataclass
class Tables:
    """What routed queries are answered from."""

    symbols: DataFrame
    edges: DataFrame
    imports: DataFrame
    stack_traces: DataFrame
    tool_traces: DataFrame


def _ranked(hits: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """(target, result_id, rank): the ``k`` first of each target."""
    w = Window.partitionBy("target").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "result_id", "rank")


def _newest(traces: DataFrame, k: int) -> DataFrame:
    """One row (all): the ``k`` newest traces in order."""
    first = traces.orderBy(F.desc("timestamp_ms"), "trace_id").limit(k)
    return first.agg(F.array_sort(F.collect_list(F.struct((-F.col("timestamp_ms")).alias("at"), "trace_id"))).alias("all"))


GRAM = 3


def signatures_with(traces: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, error_signature): the signatures that contain a target, by joining their grams with the target's first one.

    Targets shorter than a gram meet the grams of their own length; the empty target is in all.
    """
    signs = traces.select("error_signature").where("error_signature is not null").distinct()
    asked = targets.select("target").where("target is not null").distinct().withColumn("gram", F.substring("target", 1, GRAM))
    size = F.explode(F.sequence(F.lit(0), F.lit(GRAM))).alias("size")
    sized = signs.select("error_signature", size)
    place = F.sequence(F.lit(1), F.greatest(F.length("error_signature") - F.col("size") + 1, F.lit(1)))
    grams = sized.select("error_signature", F.explode(F.array_distinct(F.transform(place, lambda i: F.substring(F.col("error_signature"), i, F.col("size"))))).alias("gram")).distinct()
    return grams.join(asked, "gram").where(F.contains("error_signature", "target")).select("target", "error_signature")


def structural(routed: DataFrame, tables: Tables, k: int) -> DataFrame:
    """(query_id, result_id, rank) of routed queries (query_id, intent, target) from code and traces, ``k`` each at most.

    Results are symbol ids, ``caller:name``, ``file:line``, files, and trace ids.  A null
    target of errors and tool calls asks for the newest.
    """
    of = lambda intent: routed.where(F.col("intent") == intent).select("target").distinct()
    names = lambda intent: of(intent).where("target is not null").select(F.col("target").alias("name"))
    text = lambda c: F.col(c).cast("string").alias("result_id")
    parts: dict[str, DataFrame] = {}
    found = C.find_definition(tables.symbols, names("definition"))
    parts["definition"] = found.where(F.col("position") <= k).select(F.col("name").alias("target"), text("symbol_id"), F.col("position").alias("rank"))
    found = C.find_callers(tables.symbols, tables.edges, names("callers"), 1)
    parts["callers"] = _ranked(found.select(F.col("name").alias("target"), F.concat(F.lit("caller:"), "caller").alias("result_id")), k, "result_id")
    found = C.find_references(tables.symbols, tables.edges, names("references"))
    place = F.concat_ws(":", "file", F.col("line").cast("string")).alias("result_id")
    parts["references"] = _ranked(found.select(F.col("name").alias("target"), place, "role", "file", "line"), k, F.desc("role"), "file", "line")
    found = tables.imports.join(of("imports"), F.col("imported_module") == F.col("target")).select("target", F.col("source_file").alias("result_id")).distinct()
    parts["imports"] = _ranked(found, k, "result_id")
    found = tables.symbols.join(of("file"), F.col("file") == F.col("target")).select("target", text("symbol_id"), "line_start", "symbol_id")
    parts["file"] = _ranked(found, k, "line_start", "symbol_id")
    found = tables.stack_traces.join(signatures_with(tables.stack_traces, of("errors")), "error_signature").select("target", text("trace_id"), "timestamp_ms", "trace_id")
    parts["errors"] = _ranked(found, k, F.desc("timestamp_ms"), "trace_id")
    found = tables.tool_traces.join(of("tool_calls"), F.col("tool_name") == F.col("target")).select("target", text("trace_id"), "timestamp_ms", "trace_id")
    parts["tool_calls"] = _ranked(found, k, F.desc("timestamp_ms"), "trace_id")
    named = reduce(DataFrame.unionByName, [p.withColumn("intent", F.lit(intent)) for intent, p in parts.items()])
    out = routed.select("query_id", "intent", "target").join(named, ["intent", "target"]).select("query_id", "result_id", "rank")
    for intent, traces in (("errors", tables.stack_traces), ("tool_calls", tables.tool_traces)):
        asks = routed.where((F.col("intent") == intent) & F.col("target").isNull()).select("query_id")
        newest = asks.join(F.broadcast(_newest(traces, k)), F.lit(True)).select("query_id", F.posexplode("all").alias("i", "t"))  # one row of k traces
        out = out.unionByName(newest.select("query_id", F.col("t.trace_id").cast("string").alias("result_id"), (F.col("i") + 1).alias("rank")))
    return out


def search(routed: DataFrame, tables: Tables, semantic: Callable[[DataFrame, int], DataFrame], k: int) -> DataFrame:
    """(query_id, intent, result_id, rank, source, fell_back) of routed queries.

    Trace questions have their own results only.  Code questions that are not certain take
    max(k / 2, 3) semantic results as context, and those without any result fall back to ``k``
    of them; so do semantic questions.  ``semantic(queries, k)`` gives (query_id, result_id,
    rank) for the queries (query_id, query) that need it, searching for the target.
    """
    own = structural(routed, tables, k)
    flagged = router.flags(routed).join(own.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    take = F.when(F.col("intent").isin(*TRACES), 0).when(F.col("found") & F.col("blend"), max(k // 2, 3)).when(F.col("found"), 0).otherwise(k)
    plan = flagged.withColumn("take", take).withColumn("fell_back", F.col("fallback") & F.col("found").isNull()).select("query_id", "intent", "target", "take", "fell_back")
    listed = semantic(plan.where("take > 0").select("query_id", F.col("target").alias("query")), k)
    rows = own.withColumn("source", F.lit("structural")).unionByName(listed.select("query_id", "result_id", "rank").withColumn("source", F.lit("semantic")))
    joined = rows.join(plan, "query_id").where((F.col("source") == "structural") | (F.col("rank") <= F.col("take")))
    return joined.select("query_id", "intent", "result_id", "rank", "source", "fell_back")
