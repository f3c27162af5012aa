"""Query routing: the intent of a query from prefixes and question shapes, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Explicit prefixes, then question shapes (pattern, group of the target or 0) by intent in order of precedence.
PREFIXES = {"def:": "definition", "callers:": "callers", "refs:": "references", "imports:": "imports", "errors:": "errors", "tools:": "tool_calls", "file:": "file"}
SHAPES = {
    "definition": [(r"where is (\w+) defined", 1), (r"definition of (\w+)", 1), (r"find (?:class|function|type|struct|enum) (\w+)", 1), (r"what is (\w+)", 1), (r"show (?:me )?(\w+) (?:definition|source)", 1), (r"where is (\w+)\?", 1), (r"go to (\w+)", 1)],
    "callers": [(r"who calls (\w+)", 1), (r"callers of (\w+)", 1), (r"what calls (\w+)", 1), (r"(\w+) is called by", 1), (r"find callers (?:of )?(\w+)", 1), (r"who uses (\w+)", 1)],
    "references": [(r"references to (\w+)", 1), (r"usages of (\w+)", 1), (r"where is (\w+) used", 1), (r"find all (?:uses|usages|references) (?:of )?(\w+)", 1), (r"find (\w+) references", 1)],
    "imports": [(r"who imports (\w+)", 1), (r"files (?:that )?import (\w+)", 1), (r"(\w+) importers", 1), (r"where is (\w+) imported", 1)],
    "file": [(r"symbols in (.+\.(?:rs|py|ts|js|go|java|cpp|c|h))", 1), (r"what's in (.+\.(?:rs|py|ts|js|go|java|cpp|c|h))", 1), (r"outline of (.+\.(?:rs|py|ts|js|go|java|cpp|c|h))", 1)],
    "errors": [(r"errors? (?:in|from|about) (\w+)", 1), (r"stack traces? (?:for|with) (\w+)", 1), (r"exceptions? (?:in|from) (\w+)", 1), (r"what went wrong", 0), (r"recent errors", 0), (r"show errors", 0)],
    "tool_calls": [(r"(?:tool )?calls to (\w+)", 1), (r"when did (?:we|I) (?:call|use) (\w+)", 1), (r"history of (\w+) calls", 1), (r"recent tool calls", 0), (r"tool history", 0)],
}
STRUCTURAL = ("definition", "callers", "references", "imports", "file")


def route(query: Column) -> Column:
    """Struct (intent, target, confidence): the first prefix or shape that fits, else semantic search of the whole query.

    A prefix is certain (1.0), a shape with a target 0.9, one without 0.8; errors and tool calls
    may have a null target.
    """
    q = F.trim(query)

    def routed(intent: str, target: Column, confidence: float) -> Column:
        return F.struct(F.lit(intent).alias("intent"), target.alias("target"), F.lit(confidence).alias("confidence"))

    out = routed("semantic", q, 1.0)
    for intent, pattern, group in reversed([(i, f"(?iU){p}", g) for i, shapes in SHAPES.items() for p, g in shapes]):
        target = F.trim(F.regexp_extract(q, pattern, group)) if group else F.lit(None).cast("string")
        out = F.when(q.rlike(pattern), routed(intent, target, 0.9 if group else 0.8)).otherwise(out)
    for prefix, intent in PREFIXES.items():
        rest = F.trim(F.substring(q, len(prefix) + 1, 1 << 20))
        out = F.when(F.startswith(q, F.lit(prefix)), routed(intent, F.nullif(rest, F.lit("")) if intent in ("errors", "tool_calls") else rest, 1.0)).otherwise(out)
    return out


def flags(routed: DataFrame) -> DataFrame:
    """Add ``blend`` and ``fallback``: structural intents mix with, or give way to, semantic search."""
    structural = F.col("intent").isin(*STRUCTURAL)
    return routed.withColumn("blend", structural & (F.col("confidence") < 1.0)).withColumn("fallback", structural)
