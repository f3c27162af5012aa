"""Reciprocal-rank fusion of whole lists: every matching sentence and every chunk with a vector has its rank.

Scores are made where the rows stand.  What is shuffled is some six bytes a score, packed by query,
tenant and stretch of rows; a group sorts its scores once, sums the shares of each chunk and passes
on its ``k`` best.  No list is cut before the sums are whole.

Tenants with more than ``SPLIT`` rows are dealt by score as well: their scores are counted in
cells first, a part of a list knows how many scores stand before it, and shares meet by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.operators import dense, sparse
from larkspur.operators.ranking import RRF_K
from larkspur.tables import numbered, written

_PACKED = "query_id bigint, tenant_id string, part int, dense boolean, base bigint, before bigint, low binary, high binary, step binary"
_CELLS = "query_id bigint, tenant_id string, cell binary, n binary"
#: Cosines are ranked as whole numbers; vectors without a direction come first and missing ones last, as in SQL.
MISSING, ZERO, NO_DIRECTION = 0, 1 + sparse.UNITS, 3 + 2 * sparse.UNITS
#: Scores of a stretch that a task holds at once.
CELLS = 1 << 22
#: Rows of a tenant, and about the scores of a part, from which a list is dealt by score.
SPLIT = 1 << 23
#: A tenant that is not dealt by score.
WHOLE = -1
#: Sums closer than this are told apart after rounding.
CLOSE = 1e-9


def _blob(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``data``."""
    offs = (np.append(0, ends) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def _packed(ids: list, tenant: str | None, is_dense: bool, query: np.ndarray, key: np.ndarray, i: np.ndarray, part: int = WHOLE, before: np.ndarray | None = None) -> pa.RecordBatch:
    """Scores of a stretch of rows, a row for each query that has some: ``query`` ascends, ``i`` ascends within it; ``before`` by query."""
    counts = np.bincount(query, minlength=len(ids))
    held = np.flatnonzero(counts)
    ends, base = np.cumsum(counts[held]), int(i.min())
    step = np.diff(i, prepend=base)
    starts = ends - counts[held]
    step[starts] = i[starts] - base
    high = key >> 32
    planes = [(key & 0xFFFFFFFF).astype(np.uint32), high.astype(np.min_scalar_type(int(high.max()))), step.astype(np.min_scalar_type(int(step.max())))]
    same = [pa.array([x], t).take(pa.array(np.zeros(len(held), np.int64))) for x, t in ((tenant, pa.string()), (part, pa.int32()), (is_dense, pa.bool_()), (base, pa.int64()))]
    first = pa.array(np.zeros(len(held), np.int64) if before is None else before[held])
    columns = [pa.array(ids, pa.int64()).take(pa.array(held)), *same, first, *(_blob(p, ends) for p in planes)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "tenant_id", "part", "dense", "base", "before", "low", "high", "step"])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of packed rows."""
    keys, places = [], []
    for base, low, high, step in zip(*(rows[c].to_pylist() for c in ("base", "low", "high", "step")), strict=True):
        n = len(low) // 4
        keys.append(np.frombuffer(low, np.uint32).astype(np.int64) | (np.frombuffer(high, f"u{len(high) // n}").astype(np.int64) << 32))
        places.append(base + np.cumsum(np.frombuffer(step, f"u{len(step) // n}").astype(np.int64)))
    return np.concatenate(keys), np.concatenate(places)


def _in_order(key: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``i`` in the order of the list: the best score first, ties by place."""
    low, best = int(i.min()), int(key.max())
    bits = int(i.max() - low).bit_length()
    if best.bit_length() + bits > 63:
        return i[np.lexsort((i, -key))]
    return low + (np.sort(((best - key) << bits) | (i - low)) & ((1 << bits) - 1))


def _fuse(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """The ``k`` best chunks of a query and tenant, and those about as good as the last; all of a part, whose sums are not whole."""
        at, share = [], []
        for part in (rows.filter(rows["dense"]), rows.filter(pc.invert(rows["dense"]))):
            if part.num_rows:
                at.append(_in_order(*_unpacked(part)))
                share.append(1.0 / (RRF_K + part["before"][0].as_py() + np.arange(1, len(at[-1]) + 1)))
        at, share = np.concatenate(at), np.concatenate(share)
        low = at.min()
        total = np.bincount(at - low, share)
        there = np.flatnonzero(total)
        if rows["part"][0].as_py() == WHOLE and len(there) > k:
            there = there[total[there] >= np.partition(total[there], -k)[-k] - CLOSE]
        first = pa.array(np.zeros(len(there), np.int64))
        return pa.table([rows["query_id"].take(first), rows["tenant_id"].take(first), pa.array(there + low), pa.array(total[there])], ["query_id", "tenant_id", "i", "score"])

    return run


def _tenants(names: pa.Array) -> Iterator[tuple[str | None, int, int]]:
    """Stretches of rows of one tenant."""
    code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(code)).tolist(), strict=True):
        yield names[a].as_py(), a, b


def _weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of rows whose parts hold both, and where each row begins."""
    parts = batch.column("parts")
    flat = parts.flatten()
    return flat.field("t").to_numpy(), flat.field("w").to_numpy().astype(np.float64), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def _scored(shared, weights: Callable[..., tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """BM25 scores, in units, of every row with a term of the query."""
        ids, asked, *stats = shared.value
        for rows in batches:
            parts = rows.column("parts")
            for start, end in sparse._pieces(parts.offsets.to_numpy(), 1, max(1, rows.num_rows)) if rows.num_rows else ():
                yield from stretches(rows.slice(start, end - start), ids, asked, *stats)

    def stretches(batch: pa.RecordBatch, ids: list, asked: tuple, *stats) -> Iterator[tuple]:
        begin, _, width = asked
        term, w, offs = weights(batch, *stats)
        i = batch.column("i").to_numpy()
        reach = np.append(0, np.cumsum(begin[term + 1] - begin[term]))[offs]
        for tenant, x, y in _tenants(batch.column("tenant_id")):
            for a, b in sparse._pieces(reach[x : y + 1], 1, max(1, CELLS // max(1, width))):
                a, b = x + a, x + b
                score = np.ascontiguousarray(sparse._sums(asked, term, w, offs[a : b + 1]).T)
                held = score > 0
                if (w[offs[a] : offs[b]] < 1).any():  # a share that rounds to nothing is one all the same
                    held = sparse._sums(asked, term, np.ones(len(w)), offs[a : b + 1]).T > 0
                query, row = np.nonzero(held)
                if len(query):
                    yield ids, tenant, query, score[query, row].astype(np.int64), i[a + row]

    return run


def _near(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Cosines of every query and vector, as whole numbers."""
        ids, q = shared.value
        for batch in batches:
            col, i = batch.column("embedding"), batch.column("i").to_numpy()
            known = col.is_valid().to_numpy(zero_copy_only=False)
            m = dense._matrix(col.filter(pa.array(known)))
            if q is not None and len(m) and m.shape[1] != q.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} dimensions, queries {q.shape[1]}")
            at = np.cumsum(known) - 1
            for tenant, x, y in _tenants(batch.column("tenant_id")):
                step = max(1, CELLS // len(ids))
                for a in range(x, y, step):
                    b = min(y, a + step)
                    key = np.full((len(ids), b - a), MISSING, np.int64)
                    has = np.flatnonzero(known[a:b])
                    if q is not None and len(has):
                        v = m[at[a + has]]
                        cosine = np.rint(dense._unit(q) @ dense._unit(v).T * sparse.UNITS)
                        lost = ~(q.any(axis=1)[:, None] & v.any(axis=1)) | np.isnan(cosine)
                        key[:, has] = np.where(lost, NO_DIRECTION, ZERO + np.where(lost, 0, cosine).astype(np.int64))
                    yield ids, tenant, np.repeat(np.arange(len(ids)), b - a), key.ravel(), np.tile(i[a:b], len(ids))

    return run


def _cell(key: np.ndarray) -> np.ndarray:
    """The cell of a score below 2**63: its power of two and the next seven bits."""
    return np.maximum((key.astype(np.float64).view(np.int64) >> 45) - (1023 << 7), 0)


def _cells(scores: Callable[..., Iterator[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many scores of a stretch stand in each cell, a row for each query."""
        for ids, tenant, query, key, _ in scores(batches):
            code, n = np.unique((query << 13) + _cell(key), return_counts=True)
            counts = np.bincount(code >> 13, minlength=len(ids))
            held = np.flatnonzero(counts)
            ends = np.cumsum(counts[held])
            columns = [pa.array(ids, pa.int64()).take(pa.array(held)), pa.array([tenant], pa.string()).take(pa.array(np.zeros(len(held), np.int64)))]
            yield pa.RecordBatch.from_arrays([*columns, _blob((code & 8191).astype(np.uint16), ends), _blob(n.astype(np.uint32), ends)], ["query_id", "tenant_id", "cell", "n"])

    return run


def _cut(most: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """The parts of a list, the best first: the lowest cell of each but the last, and how many scores stand before each."""
        total = np.zeros(8192, np.int64)
        for cell, n in zip(rows["cell"].to_pylist(), rows["n"].to_pylist(), strict=True):
            total[np.frombuffer(cell, np.uint16)] += np.frombuffer(n, np.uint32)
        lowest, before, seen = [], [0], 0
        cells = np.flatnonzero(total)[::-1].tolist()
        for c, last in zip(cells, [None, *cells], strict=False):
            if seen > before[-1] and seen - before[-1] + int(total[c]) > most:
                lowest.append(last)
                before.append(seen)
            seen += int(total[c])
        return pa.table([rows["query_id"][:1], rows["tenant_id"][:1], pa.array([lowest], pa.list_(pa.int32())), pa.array([before], pa.list_(pa.int64()))], ["query_id", "tenant_id", "lowest", "before"])

    return run


def _packing(scores: Callable[..., Iterator[tuple]], is_dense: bool, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed scores; those of tenants with ``cuts`` by their parts."""
        cuts, tables = shared.value, {}
        for ids, tenant, query, key, i in scores(batches):
            if tenant not in cuts:
                yield _packed(ids, tenant, is_dense, query, key, i)
                continue
            if tenant not in tables:
                own = [cuts[tenant].get(q, ([], [0])) for q in ids]
                n = max(len(b) for _, b in own)
                tables[tenant] = np.array([c + [-1] * (n - 1 - len(c)) for c, _ in own], np.int64).reshape(len(ids), n - 1), np.array([b + [0] * (n - len(b)) for _, b in own], np.int64)
            lowest, before = tables[tenant]
            part, cell = np.zeros(len(key), np.int64), _cell(key)
            for p in range(lowest.shape[1]):
                part += cell < lowest[query, p]
            for p in np.unique(part).tolist():
                at = part == p
                yield _packed(ids, tenant, is_dense, query[at], key[at], i[at], 2 * p + is_dense, before[:, p])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in stretches of the order of their chunks, so that a stretch has few tenants."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return rows.repartitionByRange(n, "i").sortWithinPartitions("i")


def _placed(rows: DataFrame, place: DataFrame) -> DataFrame:
    p = place.select(F.col("tenant_id").alias("_tenant"), F.col("chunk_id").alias("_chunk"), "i")
    return rows.join(p, F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("chunk_id").eqNullSafe(F.col("_chunk"))).drop("_tenant", "_chunk")


def _sentence_blocks(docs: DataFrame, queries: DataFrame) -> Iterator[tuple[DataFrame, Callable]]:
    """Rows with terms of a block of queries, and what makes their scores."""
    spark = docs.sparkSession
    for ids, vocab, rows in sparse._blocks(queries, sparse.MAX_QUERY_TERMS):
        asked = sparse._asked(rows, max(1, len(vocab)))
        counted = written(sparse._counted(docs, vocab), "counted")
        stats = sparse.statistics_of(counted, len(vocab))
        if stats is None:  # repeated rows add up, and so many weights stay in a table
            terms = spark.createDataFrame(list(vocab.items()) or [("", 0)], "term string, t int")
            hits = sparse.weighted(sparse.index(docs)).join(F.broadcast(terms), "term").groupBy("tenant_id", "chunk_id", "sentence_idx")
            yield written(hits.agg(F.collect_list(F.struct("t", "w")).alias("parts")), "hits"), _scored(spark.sparkContext.broadcast((ids, asked)), _weights)
        else:
            yield counted.where(F.size("parts") > 0), _scored(spark.sparkContext.broadcast((ids, asked, *stats)), sparse.counted_weights)


def _question_blocks(questions: DataFrame) -> Iterator[Callable]:
    """What makes the cosines of a block of questions (query_id, embedding)."""
    context = questions.sparkSession.sparkContext
    known = questions.where("embedding is not null").withColumn("tenant_id", F.lit(None).cast("string"))
    for ids, q, _ in dense._query_blocks(known):
        yield _near(context.broadcast((ids, q)))
    missing = [r.query_id for r in questions.where("embedding is null").select("query_id").collect()]
    if missing:
        yield _near(context.broadcast((missing, None)))


def _scores(lists: list[tuple[DataFrame, Callable, bool]], large: set) -> DataFrame | None:
    """Packed scores of all lists (rows, what makes their scores, whether dense); those of ``large`` tenants by parts."""
    out = None
    for rows, scores, is_dense in lists:
        rows, cuts = _dealt(rows), {}
        if large:
            rows = written(rows, "dealt").sortWithinPartitions("i")
            own = F.col("tenant_id").isin([t for t in large if t is not None])
            cells = rows.where(own | F.col("tenant_id").isNull() if None in large else own).mapInArrow(_cells(scores), _CELLS)
            cuts = {t: {} for t in large}
            for r in cells.groupBy("query_id", "tenant_id").applyInArrow(_cut(SPLIT), "query_id bigint, tenant_id string, lowest array<int>, before array<bigint>").toLocalIterator():
                cuts[r.tenant_id][r.query_id] = (list(r.lowest), list(r.before))
        part = rows.mapInArrow(_packing(scores, is_dense, rows.sparkSession.sparkContext.broadcast(cuts)), _PACKED)
        out = part if out is None else out.unionByName(part)
    return out


def whole(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, tenant_id, chunk_id, score, rank): the ``k`` best chunks of each query and tenant by the fusion of its whole lists.

    The sparse list has every sentence of ``chunks`` with a word of the query, the dense one every row of
    ``vectors`` (tenant_id, chunk_id, embedding); each is ranked by tenant, ties by chunk.
    """
    # chunks are numbered in their order, a missing id last
    names = chunks.select("tenant_id", "chunk_id", F.col("chunk_id").isNull().alias("_none")).distinct()
    place = numbered(names, "tenant_id", "_none", "chunk_id").drop("_none")
    asked = queries.groupBy("query_id").agg(F.concat_ws("\n", F.collect_list("query")).alias("query"))
    blocks = list(_sentence_blocks(sparse.sentences(chunks), asked))
    large = {r.tenant_id for rows in (*(b[0] for b in blocks), vectors) for r in rows.groupBy("tenant_id").count().where(F.col("count") > SPLIT).collect()}
    lists = [(_placed(rows, place).drop("chunk_id", "sentence_idx"), scores, False) for rows, scores in blocks]
    near = _placed(vectors.select("tenant_id", "chunk_id", "embedding"), place).drop("chunk_id")
    rows = _scores(lists + [(near, scores, True) for scores in _question_blocks(questions)], large)
    if rows is None:
        rows = chunks.sparkSession.createDataFrame([], _PACKED)
    best = rows.groupBy("query_id", "tenant_id", "part").applyInArrow(_fuse(k), "query_id bigint, tenant_id string, i bigint, score double")
    if large:
        best = best.groupBy("query_id", "tenant_id", "i").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("query_id", "tenant_id").orderBy(F.round("score", 12).desc(), "i")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(place.select("i", "chunk_id"), "i").select("query_id", "tenant_id", "chunk_id", "score", "rank")
