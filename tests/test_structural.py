from larkspur.operators import structural as C

RUST = "use std::fs::{self, File};\n\n/// Loads it.\npub fn load(path: &str) -> String {\n    let s = fs::read(path);\n    parse(s)\n}\n\nstruct Conf {\n    a: u8,\n}\n\nimpl Conf {\n    fn new() -> Self {\n        load(\"x(y)\");\n        Conf { a: 1 }\n    }\n}\n"
TS = "import { a } from './util';\nexport class Box {\n  open(n: number): void {\n    this.log(n);\n  }\n}\nexport const twice = (x: number) => x * 2;\nexport interface Shape { area(): number }\n"
PY = "import os\nfrom . import util\n\nMAX = 3\n\nclass A:\n    \"\"\"Doc.\"\"\"\n    def go(self):\n        return util.run(MAX)\n\ndef main():\n    A().go()\n"


def rows(found, *keys):
    return [tuple(r[k] for k in keys) for r in found]


def test_rust():
    s, c, i = C.parse(RUST, "rust")
    assert rows(s, "name", "kind", "line_start", "line_end", "parent") == [("load", "function", 4, 7, None), ("Conf", "class", 9, 11, None), ("new", "method", 14, 17, "Conf")]
    assert s[0]["docstring"] == "Loads it." and s[0]["visibility"] == "public" and s[2]["visibility"] == "private"
    assert rows(c, "callee_name", "call_line", "call_type") == [("read", 5, "qualified"), ("parse", 6, "direct"), ("load", 15, "direct")]
    assert rows(i, "imported_module", "import_line") == [("std::fs", 1)]


def test_typescript():
    s, c, i = C.parse(TS, "typescript")
    assert rows(s, "name", "kind") == [("Box", "class"), ("open", "method"), ("twice", "function"), ("Shape", "interface")]
    assert ("log", 4, "method") in rows(c, "callee_name", "call_line", "call_type")
    assert rows(i, "imported_module", "is_relative") == [("./util", True)]


def test_python():
    s, c, i = C.parse(PY, "python")
    assert {(x["name"], x["kind"], x["line_start"], x["parent"]) for x in s} == {("MAX", "constant", 4, None), ("A", "class", 6, None), ("go", "method", 8, "A"), ("main", "function", 11, None)}
    assert sorted(rows(c, "callee_name", "call_line")) == [("A", 12), ("go", 12), ("run", 9)]
    assert rows(i, "imported_module", "is_relative") == [("os", False), (".", True)]


def test_go_java_cpp():
    s, _, i = C.parse('package a\nimport (\n\t"fmt"\n)\nfunc (b *Box) Open(x int) {\n\tfmt.Println(x)\n}\ntype Box struct {\n}\n', "go")
    assert rows(s, "name", "kind") == [("Open", "method"), ("Box", "class")] and rows(i, "imported_module") == [("fmt",)]
    s, _, i = C.parse("import java.util.List;\npublic class A {\n  public static int go(int x) {\n    return x;\n  }\n}\n", "java")
    assert rows(s, "name", "kind") == [("A", "class"), ("go", "method")] and rows(i, "imported_module") == [("java.util.List",)]
    s, _, i = C.parse("#include <vector>\nclass B {\n};\nint run(int x) {\n  return x;\n}\n", "cpp")
    assert rows(s, "name", "kind") == [("B", "class"), ("run", "function")] and rows(i, "imported_module") == [("vector",)]


def test_bad_sources():
    assert C.parse("def (", "python") == ([], [], []) and C.parse(None, "rust") == ([], [], []) and C.parse("x", None) == ([], [], [])


def test_queries_over_tables(spark):
    sym = spark.createDataFrame([(1, "a", "class", "f.py", 1, 20, None), (2, "a", "function", "f.py", 3, 9, 1), (3, "b", "function", "g.py", 1, 5, None), (4, "c", "function", "g.py", 7, 9, None)], "symbol_id int, name string, kind string, file string, line_start int, line_end int, parent_symbol_id string")
    calls = spark.createDataFrame([("f.py", 4, "b"), ("g.py", 2, "c"), ("g.py", 6, "a")], "call_file string, call_line int, callee_name string")
    got = C.attribute_calls(calls, sym)
    assert sorted((r.callee_name, r.caller_symbol_id) for r in got.collect()) == [("b", 2), ("c", 3)]
    name = spark.createDataFrame([("c",)], "name string")
    assert sorted((r.caller, r.depth) for r in C.find_callers(sym, got, name, 3).collect()) == [("a", 2), ("b", 1)]
    assert [r.kind for r in C.find_definition(sym, spark.createDataFrame([("a",)], "name string")).orderBy("position").collect()] == ["function", "class"]
    assert [r.symbol_id for r in C.children(sym, "1").collect()] == [2] and C.by_name(sym, "a").count() == 2
    linked = {r.callee_name: r.callee_symbol_id for r in C.link_callees(sym, calls).collect()}
    assert linked == {"b": 3, "c": 4, "a": None}


def test_callers_of_many_names_at_once(spark):
    """More names than one row of bits holds, in a random graph, against a walk of each name."""
    import random

    rng = random.Random(2)
    sym = [(i, f"n{i}", "function", "f.py", 1, 2) for i in range(1500)]
    edges = [(rng.randrange(1500), f"n{rng.randrange(1400)}", "f.py", 1) for _ in range(1700)] + [(3, "n3", "f.py", 1), (None, "n1", "f.py", 1), (5, None, "f.py", 1)]
    s = spark.createDataFrame(sym, "symbol_id int, name string, kind string, file string, line_start int, line_end int")
    e = spark.createDataFrame(edges, "caller_symbol_id int, callee_name string, call_file string, call_line int")
    names = spark.createDataFrame([(f"n{i}",) for i in range(1450)] + [("n7",), ("nobody",), (None,)], "name string")
    into: dict[str, set[str]] = {}
    for caller, callee, *_ in edges:
        if caller is not None:
            into.setdefault(callee, set()).add(f"n{caller}")
    want = set()
    for name in {f"n{i}" for i in range(1450)}:
        seen, at = {}, {name}
        for depth in (1, 2, 3):
            at = {c for x in at for c in into.get(x, ())} - set(seen)
            seen |= dict.fromkeys(at, depth)
        want |= {(name, c, d) for c, d in seen.items()}
    for depth in (1, 2, 3):
        got = [tuple(r) for r in C.find_callers(s, e, names, depth).select("name", "caller", "depth").collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in want if x[2] <= depth}
    assert C.find_callers(s, e, names.limit(0), 2).isEmpty()


def _graph(rng, n):
    """Symbols of which some share a name, and calls among them."""
    sym = [(i, f"n{i % (n * 2 // 3)}") for i in range(n)]
    return sym, [(rng.randrange(n), f"n{rng.randrange(n)}") for _ in range(2 * n)]


def test_only_called_callers_are_written_and_names_are_shared(spark, monkeypatch):
    """A level is written for the callers that are called themselves, not for all; symbols of one name are one caller."""
    import random

    from pyspark.sql import functions as F

    sym, edges = _graph(random.Random(5), 300)
    s, e = spark.createDataFrame(sym, "symbol_id int, name string"), spark.createDataFrame(edges + [(i, "n0") for i in range(300)], "caller_symbol_id int, callee_name string")
    into: dict[str, set[str]] = {}
    for caller, callee in edges + [(i, "n0") for i in range(300)]:
        into.setdefault(callee, set()).add(f"n{caller % 200}")
    rows, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: (out := write(df, name), rows.append((name, out)))[0])
    got = C.find_callers(s, e, s.select("name").limit(300).unionByName(e.select(F.col("callee_name").alias("name"))), 3).collect()
    want = set()
    for name in into:
        seen, at = {}, {name}
        for depth in (1, 2, 3):
            at = {c for x in at for c in into.get(x, ())} - set(seen)
            seen |= dict.fromkeys(at, depth)
        want |= {(name, c, d) for c, d in seen.items()}
    assert len(got) == len(want) and set(map(tuple, got)) == want
    levels = [df for name, df in rows if name == "callers"]
    assert len(levels) == 2 and all({r["at"] for r in df.select("at").collect()} <= set(into) for df in levels)


def test_pieces_hold_whole_callers_and_slices_give_the_same_rows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(C, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 3)}))}))
    lists = [(0, 0, "a", ["x", "y"]), (0, 0, "a", ["y", "z"]), (0, 1, "b", ["x"]), (0, 2, "c", ["z", "w", "v"]), (1, 9, "d", ["x"])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["run", "k", "caller", "callees"]) for part in (lists[:1], lists[1:3], lists[3:])]
    monkeypatch.setattr(C, "PIECE_CALLS", 2)
    pieces = [b.to_pylist() for b in C._deal(iter(batches))]
    assert [[r["caller"] for r in p if r["caller"]] for p in pieces] == [["a"], ["b", "c"], ["d"]]
    assert len({r["piece"] for p in pieces for r in p}) == 3
    names = {r["local"]: r["callee"] for r in pieces[0] if r["callee"]}
    assert sorted(names[i] for i in np.frombuffer(pieces[0][0]["calls"], "<i4")) == ["x", "y", "y", "z"]
    assert [(r["callee"], r["first"]) for r in pieces[1] if r["callee"]] == [("x", 1), ("z", 2), ("w", 2), ("v", 2)]

    rng = np.random.default_rng(1)
    calls = [rng.integers(0, 20, rng.integers(0, 9)).astype("<i4") for _ in range(40)]
    row = dict.fromkeys(("local", "num", "caller", "data", "names"))
    made = [row | {"piece": 1, "block": -1, "kind": 0, "caller": f"c{i}", "data": x.tobytes()} for i, x in enumerate(calls)]
    made += [row | {"piece": 1, "block": 0, "kind": 1, "local": i, "num": 1000 + i} for i in range(20)] + [row | {"piece": 1, "block": 0, "kind": 2, "names": [f"m{i}" for i in range(1024)]}]
    stream = pa.Table.from_pylist(made, pa.schema([("piece", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("local", pa.int32()), ("num", pa.int32()), ("caller", pa.string()), ("data", pa.binary()), ("names", pa.list_(pa.string()))]))
    want = {(f"m{1000 + x}", f"c{i}", 1) for i, at in enumerate(calls) for x in at.tolist()}
    for size in (7, 64):
        for most in (1, 3, 1 << 16):
            monkeypatch.setattr(C, "SLICE", 3)
            monkeypatch.setattr(C, "SLICE_CALLS", most)
            got = [tuple(r.values()) for b in C._walk(1, True, iter(stream.to_batches(size))) for r in b.to_pylist()]
            assert len(got) == len(want) and set(got) == want
