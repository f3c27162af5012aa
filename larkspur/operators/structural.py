"""Code structure: extraction of symbols, calls and imports, and queries over their tables.

Extraction reads one file at a time in Arrow batches (``functions.source``).  Lines are
1-based everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.source import parse
from larkspur.tables import numbered as in_order, written

#: Languages by file extension, and kinds in order of preference for definitions.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp"}
KIND_ORDER = ("function", "method", "class", "interface", "type", "enum", "variable", "constant", "module")

def language(path: Column) -> Column:
    """Language of a file by its extension, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


_TABLES = {
    "symbols": (0, "name string, kind string, line_start int, col_start int, line_end int, col_end int, parent string, signature string, docstring string, visibility string"),
    "calls": (1, "callee_name string, call_line int, call_col int, call_type string"),
    "imports": (2, "imported_module string, import_line int, is_relative boolean"),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def extract(files: DataFrame, what: str) -> DataFrame:
    """``symbols``, ``calls`` or ``imports`` of files (path, content): path, language and the columns of the table."""
    index, ddl = _TABLES[what]
    cols = [c.split() for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (content, lang) in enumerate(zip(batch.column("content").to_pylist(), batch.column("language").to_pylist(), strict=True)):
                found = parse(content, lang)[index]
                if what == "imports":  # one row for each line and module
                    found = list({(x["import_line"], x["imported_module"]): x for x in found}.values())
                rows += found
                at += [i] * len(found)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("path").take(take), batch.column("language").take(take), *(pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in cols)], ["path", "language", *(n for n, _ in cols)])

    return files.select("path", language(F.col("path")).alias("language"), "content").mapInArrow(run, f"path string, language string, {ddl}")


# --- queries over the tables ---------------------------------------------------------------


def attribute_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with the innermost symbol of its file that encloses its line; calls outside any are dropped.

    Symbols are classed by length: 2**size lines or more, below twice that.  One spans at most
    three blocks of 2**size lines, so a line meets, for each size there is (at most 32), only
    the symbols of that size about its own block, however many its file has.
    """
    s = symbols.where("line_end >= line_start").select(F.col("symbol_id").alias("caller_symbol_id"), F.col("file").alias("call_file"), "line_start", "line_end")
    s = s.withColumn("size", F.length(F.bin((F.col("line_end") - F.col("line_start") + 1).cast("bigint"))) - 1)
    sizes = s.agg(F.collect_set("size").alias("sizes"))  # one row
    spans = F.sequence(F.expr("shiftright(line_start, size)"), F.expr("shiftright(line_end, size)"))
    blocks = s.withColumn("block", F.explode(spans))
    lines = calls.select("call_file", "call_line").distinct().join(F.broadcast(sizes), F.lit(True)).select("call_file", "call_line", F.explode("sizes").alias("size"))
    inside = lines.withColumn("block", F.expr("shiftright(call_line, size)")).join(blocks, ["call_file", "size", "block"]).where("call_line between line_start and line_end")
    w = Window.partitionBy("call_file", "call_line").orderBy(F.col("line_end") - F.col("line_start"), "caller_symbol_id")
    owner = inside.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("call_file", "call_line", "caller_symbol_id")
    distinct = calls.select("call_file", "call_line", "callee_name").distinct()
    return distinct.join(owner, ["call_file", "call_line"]).select("call_file", "call_line", "callee_name", "caller_symbol_id")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def by_prefix(symbols: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` symbols by name whose name starts with ``prefix``: the completion list."""
    return symbols.where(F.col("name").startswith(prefix)).orderBy("name", "symbol_id").limit(limit)


def by_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file).orderBy("line_start", "symbol_id")


def children(symbols: DataFrame, parent: str) -> DataFrame:
    return symbols.where(F.col("parent_symbol_id") == parent)


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind), F.lit(0).cast("bigint")), F.lit(len(KIND_ORDER) + 1).cast("bigint"))


def find_definition(symbols: DataFrame, names: DataFrame, project: str | None = None) -> DataFrame:
    """Definitions of the given names (column ``name``), in order of kind (column ``position``)."""
    found = symbols.join(names, "name", "left_semi")
    if project is not None:
        found = found.where(F.col("project_id") == project)
    w = Window.partitionBy("name").orderBy(kind_rank(F.col("kind")), "file", "line_start", "symbol_id")
    return found.withColumn("position", F.row_number().over(w))


def find_references(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Places (name, file, line) where a name is defined or called, once each, a definition before a call."""
    defs = symbols.join(names, "name", "left_semi").select("name", "file", F.col("line_start").alias("line"), F.lit("definition").alias("role"))
    calls = edges.withColumnRenamed("callee_name", "name").join(names, "name", "left_semi").select("name", F.col("call_file").alias("file"), F.col("call_line").alias("line"), F.lit("call").alias("role"))
    return defs.unionByName(calls).groupBy("name", "file", "line").agg(F.max("role").alias("role"))  # 'definition' sorts after 'call'


#: Numbers of 64 bits in a row of names; callers of a piece, and calls from which on a piece takes no other caller; callers and calls walked at once.
SLOTS = 16
PIECE, PIECE_CALLS = 1 << 13, 1 << 20
SLICE, SLICE_CALLS = 1 << 8, 1 << 16
_BITS = SLOTS * 64
_CALLS = "piece bigint, caller string, calls binary, callee string, local int, first bigint"
_ROWS = ("piece bigint", "block bigint", "kind int", "local int", "num int", "caller string", "data binary", "names array<string>")


def find_callers(symbols: DataFrame, edges: DataFrame, names: DataFrame, depth: int = 1) -> DataFrame:
    """Functions that reach a name by at most ``depth`` (1 to 3) calls: (name, caller, depth), the least depth of each.

    Breadth first for all names at once.  The calls are written once, by pieces of whole callers
    (``_deal``).  The names are numbered in the order of the first caller of each, so that names
    called from one place share a block, and what a caller has reached is a row of bits for each
    block (``SLOTS`` numbers of 64 bits).  Only callers that are called themselves carry names on:
    a level is written for these alone and goes to the pieces that call them.  A piece unites the
    rows of its callees without another shuffle and walks its levels again where its rows of names
    and callers are made.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be from 1 to 3")
    asked = names.select("name").where("name is not null").distinct()
    named = symbols.where("symbol_id is not null and name is not null").select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"))
    own = edges.select("caller_symbol_id", "callee_name").where("callee_name is not null")
    if depth == 1:
        calls = own.join(named, "caller_symbol_id").select(F.col("callee_name").alias("name"), "caller").distinct()
        return asked.join(calls, "name").select("name", "caller", F.lit(1).alias("depth"))
    width = max(1, int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    callers = in_order(named.groupBy("caller").agg(F.min("caller_symbol_id").alias("id")), "id", "caller", name="k").select("caller", "k")
    lists = own.join(named.join(callers, "caller"), "caller_symbol_id").groupBy("caller_symbol_id", "caller", "k").agg(F.collect_set("callee_name").alias("callees"))
    runs = lists.select(F.expr(f"k div {PIECE}").alias("run"), "k", "caller", "callees").repartition(width, "run").sortWithinPartitions("run", "k")
    dealt = written(runs.mapInArrow(_deal, _CALLS), "calls")
    calls, heads = dealt.where("caller is not null").select("piece", "caller", "calls"), dealt.where("callee is not null").select("piece", "callee", "local", "first")
    placed = in_order(asked.join(heads.groupBy(F.col("callee").alias("name")).agg(F.min("first").alias("first")), "name"), "first", "name", name="n")
    placed = placed.select("name", F.expr(f"n div {_BITS}").alias("block"), F.expr(f"cast(n % {_BITS} as int)").alias("num"))
    levels = [placed.select(F.col("name").alias("at"), "block", "num", F.lit(None).cast("binary").alias("data"))]
    carrying = calls.join(heads.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")
    for _ in range(1, depth):
        met = _met(carrying, heads.join(carrying.select("piece").distinct(), "piece", "left_semi"), levels)
        found = _by_piece(met, width).mapInArrow(partial(_walk, len(levels), False), "at string, block bigint, data binary")
        levels.append(written(found, "callers").select("at", "block", F.lit(None).cast("int").alias("num"), "data"))
    met = _met(calls, heads, levels)
    members = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("num", "name"))).alias("m")).select("block", F.col("m.name").alias("names"))  # a block's names
    kept = met.where("block >= 0").select("piece", "block").distinct().join(members, "block").select(*_columns(kind=F.lit(len(levels) + 1), have=("piece", "block", "names")))
    return _by_piece(met.unionByName(kept), width).mapInArrow(partial(_walk, len(levels), True), "name string, caller string, depth int")


def _columns(have: tuple[str, ...], **made: Column) -> list[Column]:
    """The columns of a row that goes to a piece: those at hand, those made, and nulls."""
    fields = [x.split() for x in _ROWS]
    return [made[n].cast(t).alias(n) if n in made else F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields]


def _met(calls: DataFrame, heads: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """What goes to each piece: its callers with their calls (block -1), and the rows of each level (kind 1, 2, ...) of its callees."""
    rows = [calls.select(*_columns(("piece", "caller"), block=F.lit(-1), kind=F.lit(0), data=F.col("calls")))]
    for i, level in enumerate(levels, 1):
        rows.append(heads.join(level, F.col("callee") == F.col("at")).select(*_columns(("piece", "block", "local", "num", "data"), kind=F.lit(i))))
    return reduce(DataFrame.unionByName, rows)


def _by_piece(rows: DataFrame, width: int) -> DataFrame:
    return rows.repartition(width, "piece").sortWithinPartitions("piece", "block", "kind")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each value of ``keys``, which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows (run, k, caller, callees) in order, by pieces: one run, and no further caller once ``PIECE_CALLS`` calls are held."""
    held: list[pa.RecordBatch] = []
    size, last = 0, (None, None)
    for batch in batches:
        run, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "k"))
        counts = pc.list_value_length(batch.column("callees")).to_numpy(zero_copy_only=False)
        start = 0
        for i in range(batch.num_rows):
            if last[0] is not None and (run[i] != last[0] or size >= PIECE_CALLS and k[i] != last[1]):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held
                held, size, start = [], 0, i
            size += int(counts[i])
            last = run[i], k[i]
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield held


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces: a row for each caller with its calls (numbers of callees within the piece, four bytes each), and one for each callee with its number and first caller."""
    part = TaskContext.get().partitionId()
    for i, held in enumerate(_pieces(batches)):
        rows = pa.Table.from_batches(held).combine_chunks()
        k = rows["k"].to_numpy()
        counts = pc.list_value_length(rows["callees"]).to_numpy().astype(np.int64)
        names = pa.concat_arrays([c.flatten() for c in rows["callees"].chunks]).dictionary_encode()
        local = names.indices.to_numpy().astype("<i4")
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))  # symbols of one name are one caller
        ends = np.append(0, np.cumsum(counts))
        at = np.append(ends[starts], ends[-1]) * 4
        calls = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(local)]).cast(pa.binary())
        first = np.repeat(k, counts)[np.unique(local, return_index=True)[1]]
        n, m = len(starts), len(names.dictionary)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n + m, (part << 33) + i)), pa.concat_arrays([rows["caller"].combine_chunks().take(pa.array(starts)).cast(pa.string()), pa.nulls(m, pa.string())]), pa.concat_arrays([calls, pa.nulls(m, pa.binary())]),
            pa.concat_arrays([pa.nulls(n, pa.string()), names.dictionary.cast(pa.string())]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(first)]),
        ], [c.split()[0] for c in _CALLS.split(", ")])


def _bytes_of(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each ends."""
    col = col.cast(pa.large_binary()).combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def _walk(depth: int, expand: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of each piece and block: the last one's rows of bits, or (``expand``) names, callers and depths of all."""
    callers, calls, ends = pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)
    for rows in _runs(batches, "piece", "block"):
        block = rows["block"][0].as_py()
        if block < 0:
            callers = pa.concat_arrays([c.cast(pa.string()) for c in rows["caller"].chunks])
            raw, ends = _bytes_of(rows["data"])
            calls, ends = raw.view("<i4"), ends // 4
            locals_ = int(calls.max(initial=-1)) + 1
            continue
        kind = rows["kind"].to_numpy()
        names = pa.array([], pa.string())
        tables = []
        for level in range(1, depth + 1):
            own = rows.filter(pa.array(kind == level))
            n = own.num_rows
            at = own["local"].to_numpy()
            place = np.full(locals_, -1, np.int32)
            if not n:
                tables.append(None)
                continue
            if level == 1:
                bits, num = np.zeros((n, SLOTS), np.uint64), own["num"].to_numpy().astype(np.uint64)
                bits[np.arange(n), num >> np.uint64(6)] = np.uint64(1) << (num & np.uint64(63))
            else:
                bits = _bytes_of(own["data"])[0].view("<u8").reshape(n, SLOTS)
            place[at[at < locals_]] = np.flatnonzero(at < locals_)  # a callee may be called only by callers left out
            tables.append((place, bits))
        if expand:
            names = rows.filter(pa.array(kind == depth + 1))["names"].combine_chunks().flatten().cast(pa.string())
            names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        a = 0
        while a < len(callers):
            b = max(a + 1, min(a + SLICE, int(np.searchsorted(ends, ends[a] + SLICE_CALLS, "right")) - 1))
            b = min(b, len(callers))
            called = calls[ends[a] : ends[b]]
            owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            seen = np.zeros((b - a, SLOTS), np.uint64)
            for level, table in enumerate(tables, 1):
                new = np.zeros((b - a, SLOTS), np.uint64)
                if table is not None:
                    to = table[0][called]
                    have = np.flatnonzero(to >= 0)
                    if len(have):
                        of = owner[have]
                        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        new[of[starts]] = np.bitwise_or.reduceat(table[1][to[have]], starts, axis=0)
                new &= ~seen
                seen |= new
                if not expand and level < depth:
                    continue
                some = np.flatnonzero(new.any(axis=1))
                if not len(some):
                    continue
                if expand:
                    found = np.flatnonzero(np.unpackbits(np.ascontiguousarray(new[some]).view(np.uint8), axis=1, bitorder="little"))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(found % _BITS)), callers.take(pa.array(some[found // _BITS] + a)), pa.array(np.full(len(found), level, np.int32))], ["name", "caller", "depth"])
                else:
                    data = np.ascontiguousarray(new[some])
                    yield pa.RecordBatch.from_arrays([callers.take(pa.array(some + a)), pa.array(np.full(len(some), block)), pa.array([x.tobytes() for x in data], pa.binary())], ["at", "block", "data"])
            a = b


def callers_of_symbol(linked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (callee_symbol_id, caller_symbol_id, call_file, call_line) of the given symbols (``symbol_id``), by the edges' resolved callee (see ``link_callees``)."""
    wanted = symbols.select(F.col("symbol_id").alias("callee_symbol_id")).distinct()
    return linked.join(wanted, "callee_symbol_id", "left_semi").select("callee_symbol_id", "caller_symbol_id", "call_file", "call_line")


def callees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller_symbol_id, callee_name, n_calls) of every symbol with calls."""
    return edges.join(symbols.select(F.col("symbol_id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi").groupBy("caller_symbol_id", "callee_name").agg(F.count("*").alias("n_calls"))


def find_imports(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.col("imported_module") == module).select("source_file")


def imports_of_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, imported_module) of the given files (``file``)."""
    return imports.join(files.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi").select("source_file", "imported_module")


def link_callees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``callee_symbol_id``: the symbol of the called name where only one bears it, else null."""
    one = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("callee_symbol_id")).where("n = 1").select(F.col("name").alias("callee_name"), "callee_symbol_id")
    return edges.join(one, "callee_name", "left")
