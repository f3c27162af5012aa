"""Routed search: each intent's own results, context, fallback, and signatures by their grams."""

from pyspark.sql import functions as F

from larkspur.operators import dispatch as D, router


def tables(spark):
    return D.Tables(
        spark.createDataFrame([(1, "go", "class", "p", "a.py", 1, 9), (2, "go", "function", "p", "b.py", 3, 4), (3, "run", "function", "p", "a.py", 2, 3)], "symbol_id int, name string, kind string, project_id string, file string, line_start int, line_end int"),
        spark.createDataFrame([(3, "go", "a.py", 2), (2, "run", "b.py", 4)], "caller_symbol_id int, callee_name string, call_file string, call_line int"),
        spark.createDataFrame([("a.py", "os"), ("b.py", "os"), ("b.py", "re")], "source_file string, imported_module string"),
        spark.createDataFrame([(7, "bad x", 5), (8, "bad y", 6), (9, "é", 7), (10, None, 9)], "trace_id int, error_signature string, timestamp_ms long"),
        spark.createDataFrame([(1, "click", 5), (2, "view", 6), (3, "click", 7)], "trace_id int, tool_name string, timestamp_ms long"),
    )


ASKED = ["where is go defined", "def:go", "who calls go", "usages of run", "who imports os", "symbols in a.py", "errors in bad", "recent errors", "calls to click", "tool history", "how are you", "def:gone", "errors in nothing", "errors: x"]


def run(spark, k=4):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string").select("query_id", router.route(F.col("query")).alias("r")).select("query_id", "r.*")
    wanted = []

    def semantic(queries, k):
        wanted.extend(sorted((r.query_id, r.query) for r in queries.collect()))
        return queries.sparkSession.createDataFrame([(i, f"d{n}", n) for i, _ in wanted for n in range(1, k + 1)], "query_id int, result_id string, rank int")

    rows = D.search(asked, tables(spark), semantic, k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.source == "semantic", r["rank"])):
        got.setdefault(r.query_id, []).append(r.result_id)
    return got, wanted, {r.query_id for r in rows if r.fell_back}


def test_every_intent(spark):
    got, wanted, fell = run(spark)
    context = ["d1", "d2", "d3"]
    assert got[0] == ["2", "1", *context] and got[1] == ["2", "1"]
    assert got[2] == ["caller:run", *context] and got[3] == ["a.py:2", "b.py:4", *context] and got[4] == ["a.py", "b.py", *context] and got[5] == ["1", "3", *context]
    assert got[6] == ["8", "7"] and got[7] == ["10", "9", "8", "7"] and got[8] == ["3", "1"] and got[9] == ["3", "2", "1"]
    assert got[10] == ["d1", "d2", "d3", "d4"] and got[11] == ["d1", "d2", "d3", "d4"] and fell == {11}
    assert 12 not in got and got[13] == ["7"]
    assert (10, "how are you") in wanted and (11, "gone") in wanted and not {6, 7, 8, 9, 12, 13, 1} & {i for i, _ in wanted}


def test_signatures_by_grams(spark):
    signs = ["bad x", "é", "", None, "aaaa", "ab", "xaab"]
    traces = spark.createDataFrame([(s,) for s in signs], "error_signature string")
    for target in ("bad", "a", "", "aa", "aaa", "aaab", "é", "aab", "zz"):
        found = D.signatures_with(traces, spark.createDataFrame([(target,), (None,)], "target string")).collect()
        assert sorted(r.error_signature for r in found) == sorted(s for s in signs if s is not None and target in s), target
