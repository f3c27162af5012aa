"""Registered query: routed search of all intents over code, traces and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.functions.text import words
from larkspur.operators import dispatch, router, search
from larkspur.plans import retrieval as R, structure as P
from larkspur.plans.registry import query
from larkspur.sources import bindings as S
from larkspur.tables import written

#: Questions with the intent, target and confidence that are right for them. {0}: item, {1}: a module, {2}: words of the item.
SHAPES = [
    ("Where is sym_{0} defined?", "definition", "sym_{0}", 0.9), ("who calls sym_{0}", "callers", "sym_{0}", 0.9), ("find all usages of sym_{0}", "references", "sym_{0}", 0.9), ("m{1} importers", "imports", "m{1}", 0.9),
    ("outline of f{0}.py please", "file", "f{0}.py", 0.9), ("any errors in err today", "errors", "err", 0.9), ("recent errors near {0}", "errors", None, 0.8), ("when did we use click", "tool_calls", "click", 0.9), ("tool history {0}", "tool_calls", None, 0.8),
    ("explain configuration {2}", "semantic", "explain configuration {2}", 1.0), ("def: sym_{0}", "definition", "sym_{0}", 1.0), ("callers: nosuch_{0}", "callers", "nosuch_{0}", 1.0), ("where is nosuch_{0} used", "references", "nosuch_{0}", 0.9),
]
K = 10


def _sql_of(i: int) -> str:
    texts = ", ".join("NULL" if s[i] is None else "'" + s[i] + "'" for s in SHAPES)
    return f"replace(replace(replace([{texts}][item_id % {len(SHAPES)} + 1], '{{0}}', CAST(item_id AS VARCHAR)), '{{1}}', CAST(item_id % 20 AS VARCHAR)), '{{2}}', array_to_string({R.WORDS.format('text')}[1:3], ' '))"


def _first(name: str, result: str, source: str, on: str, order: str) -> str:
    return f"{name} AS (SELECT query_id, {result} AS result_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM routed JOIN {source} ON {on})"


_CODE = f"""routed AS (
        SELECT item_id AS query_id, 'src' || (item_id % 20) AS tenant, {_sql_of(1)} AS intent, {_sql_of(2)} AS target, [{', '.join(str(s[3]) for s in SHAPES)}][item_id % {len(SHAPES)} + 1]::DOUBLE AS confidence FROM benchmark
    ),
    queries AS (SELECT query_id, target AS query FROM routed),
    calls AS (SELECT DISTINCT callee_name, name AS caller FROM call_edges JOIN symbols ON symbol_id = caller_symbol_id),
    places AS (SELECT name, file, line, max(role) AS role FROM (SELECT name, file, line_start AS line, 'definition' AS role FROM symbols UNION ALL SELECT callee_name, call_file, call_line, 'call' FROM call_edges) GROUP BY ALL),
    {_first('r1', 'CAST(symbol_id AS VARCHAR)', 'symbols s', "intent = 'definition' AND s.name = target", f'{P._RANK}, file, line_start, symbol_id')},
    {_first('r2', "'caller:' || caller", 'calls', "intent = 'callers' AND callee_name = target", "'caller:' || caller")},
    {_first('r3', "file || ':' || line", 'places', "intent = 'references' AND name = target", 'role DESC, file, line')},
    {_first('r4', 'source_file', 'imports', "intent = 'imports' AND imported_module = target", 'source_file')},
    {_first('r5', 'CAST(symbol_id AS VARCHAR)', 'symbols s', "intent = 'file' AND file = target", 'line_start, symbol_id')},
    {_first('r6', 'CAST(trace_id AS VARCHAR)', 'stack_traces', "intent = 'errors' AND (target IS NULL OR contains(error_signature, target))", 'timestamp_ms DESC, trace_id')},
    {_first('r7', 'CAST(trace_id AS VARCHAR)', 'tool_traces', "intent = 'tool_calls' AND (target IS NULL OR tool_name = target)", 'timestamp_ms DESC, trace_id')},
    own AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM r{i}' for i in range(1, 8))}) WHERE rank <= {K}),
    plan AS (
        SELECT query_id, tenant, intent, NOT found AND intent IN ('definition', 'callers', 'references', 'imports', 'file') AS fell_back,
            CASE WHEN intent IN ('errors', 'tool_calls') THEN 0 WHEN found AND intent <> 'semantic' THEN CASE WHEN confidence < 1 THEN {K // 2} ELSE 0 END ELSE {K} END AS take
        FROM (SELECT *, query_id IN (SELECT query_id FROM own) AS found FROM routed)
    )"""
_SQL = f"""{S.sql('live', 'symbols', 'call_edges', 'imports', 'stack_traces', 'tool_traces')}, {_CODE}, {R._SENT}, {R._POST}, {R._COLL}, {R._SCORED}, {R._CHANNELS}, {R._FUSED},
    semantic AS (SELECT query_id, chunk_id AS result_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM fused JOIN plan USING (query_id) WHERE fused.tenant_id = plan.tenant AND take > 0)
    SELECT query_id, intent, result_id, rank, 'structural' AS source, fell_back FROM own JOIN plan USING (query_id)
    UNION ALL SELECT query_id, intent, result_id, rank, 'semantic', fell_back FROM semantic JOIN plan USING (query_id) WHERE rank <= take"""


@query("search_with_routing", _SQL)
def search_with_routing(spark: SparkSession, d: str) -> DataFrame:
    """A question of each shape in turn for every item of ``benchmark``, in the tenant of its number; the semantic list is hybrid search."""
    items = S.table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(words(F.col("text")), 1, 3), " ").alias("w"))
    text = F.element_at(F.array(*(F.lit(s[0]) for s in SHAPES)), (F.col("item_id") % len(SHAPES) + 1).cast("int"))
    for mark, value in (("{0}", F.col("item_id").cast("string")), ("{1}", (F.col("item_id") % 20).cast("string")), ("{2}", F.col("w"))):
        text = F.replace(text, F.lit(mark), value)
    routed = written(items.select(F.col("item_id").alias("query_id"), router.route(text).alias("r")).select("query_id", "r.*"), "routed")
    tables = dispatch.Tables(S.symbols(spark, d), S.call_edges(spark, d), S.imports(spark, d), S.stack_traces(spark, d), S.tool_traces(spark, d))

    def semantic(asked: DataFrame, k: int) -> DataFrame:
        tenant = F.concat(F.lit("src"), F.col("query_id") % 20)
        fused = search.hybrid(*_in_tenant(R._lists(spark, d, 20, written(asked, "asked")), tenant), k=k)
        return fused.select("query_id", F.col("chunk_id").alias("result_id"), "rank")

    def _in_tenant(lists: tuple[DataFrame, DataFrame], tenant) -> tuple[DataFrame, ...]:
        return tuple(x.where(F.col("tenant_id") == tenant) for x in lists)

    return dispatch.search(routed, tables, semantic, K)
