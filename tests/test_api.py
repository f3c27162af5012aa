import json

import pytest
from pyspark.sql import functions as F

from larkspur.__main__ import main
from larkspur.api import Memory


def test_memory_calls(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    ids = [m.memory_add("t", f"note {i} about parsers", "decision", episode="e", timestamp_ms=i) for i in range(3)]
    made = m.memory_consolidate_episode("t", "e", 2, delete_sources=True, timestamp_ms=9)
    assert "note 2" in m.memory_get("t", made).first().text and m.memory_get("t", ids[2]).isEmpty() and m.memory_get("t", ids[0]).count() == 1
    with pytest.raises(ValueError):
        m.memory_consolidate_episode("t", "none")
    assert m.memory_compact("t") == "completed" and m.memory_compact("t") == "skipped"
    m.record_query(spark.createDataFrame([("t", f"q{i}", i, float(i), False, False) for i in range(1, 12)], "tenant_id string, query_id string, timestamp_ms bigint, total_ms double, cache_hit boolean, hot_hit boolean"))
    r = m.memory_metrics("t").first()
    assert (r.n, r.p50, r.p99) == (11, 6.0, 10.0) and m.memory_metrics("t", include_recent=True).count() == 10
    assert {(x.n, x.p50) for x in m.memory_metrics("t", include_recent=True).collect()} == {(11, 6.0)}


def test_code_calls(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    m.index_files("t", files(("a.py", "import os\n\ndef low():\n    pass\n\ndef mid():\n    low()\n"), ("b.py", "from a import mid\n\ndef top():\n    mid()\n")), "p", 1)
    assert [(r.caller, r.depth) for r in m.code_find_callers("t", "low", 9).collect()] == [("mid", 1), ("top", 2)]
    assert [(r.file, r.line, r.role) for r in m.code_find_references("t", "mid").collect()] == [("a.py", 6, "definition"), ("b.py", 4, "call")]
    assert m.code_find_imports("t", "a").first().source_file == "b.py" and m.code_find_definition("t", "low", "p").first().line_start == 3
    m.index_files("t", files(("a.py", "def other():\n    pass\n")), "p", 2)
    assert m.code_find_definition("t", "low").isEmpty() and m.code_find_definition("u", "top").isEmpty() and m.code_find_definition("t", "top").count() == 1


def test_debug_calls(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    for i in range(4):
        m.capture_tool_call("t", "grep" if i % 2 else "cat", i, {"a": i}, error={"e": 1} if i == 3 else None, session="s")
    assert [r.timestamp_ms for r in m.debug_find_tool_calls("t", "grep").collect()] == [3, 1]
    assert m.debug_find_tool_calls("t", errors_only=True, start=3, end=3).first().error_json == '{"e": 1}'
    m.index_stack_traces(spark.createDataFrame([("t", "x", None, None, 5, 'Traceback (most recent call last):\n  File "a.py", line 1, in f\n    g()\nValueError: 0xff')], "tenant_id string, trace_id string, project_id string, session_id string, timestamp_ms bigint, full_trace string"))
    r = m.debug_find_errors("t", "ValueError", function="f").first()
    assert r.error_signature == "ValueError: 0x..." and r.frames[0].line == 1
    with pytest.raises(ValueError):
        m.debug_find_errors("t", start=5, end=4)
    with pytest.raises(ValueError):
        m.debug_find_tool_calls("t", limit=101)


def test_command_line(spark, tmp_path, capsys):
    base = ["--base", str(tmp_path / "c"), "--tenant", "t"]
    main([*base, "add", "hello there", "--type", "doc"])
    key = json.loads(capsys.readouterr().out)["chunk_id"]
    main([*base, "search", "hello"])
    assert json.loads(capsys.readouterr().out)["chunk_id"] == key
    main([*base, "delete", key])
    main([*base, "get", key])
    main([*base, "stats"])
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0]) == {"deleted": True} and json.loads(out[1])["deleted"] == 1
