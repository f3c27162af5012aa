"""Best-fit packing of token pieces by the sum-of-squares rule.

Every document becomes its token ids and an end mark; one longer than a sequence is cut
into whole sequences and one shorter first piece.  A piece goes where the sum over all
residual gaps of (open bins with that gap) squared becomes smallest, among the open bins
it fits into; ties take the tightest gap, and a new bin opens only where it fits into none.
Pieces come longest first, so that bins are filled up by the many short ones.

Only (id, piece, length) rows are packed.  They are dealt to shards of about
``shard_pieces`` by hash, and each shard packs by itself: a shard leaves at most a few
sequences unfilled, memory per task is bounded, and the number of shards grows with the
input.  Pieces that fill a sequence need no packing and skip this step.

Defined results: null and empty texts are the end mark alone; repeated rows are packed one
by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C
from larkspur.llm.tokens import encoder

SEQUENCE = 2048
SHARD_PIECES = 1 << 16


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``size``."""
    first = (length - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, length, size))]


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, t in enumerate(batch.column("text")):
                ids = np.append(enc.ids(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for i, (s, n) in enumerate(cut(len(ids), size)):
                    rows.append(r)
                    piece.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the given order."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    nowhere = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        own = count[s:size]
        # moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g] + 1)
        change = np.where(own > 0, 2 * (count[: size - s] - own + 1), nowhere)
        if len(change) and own[0] > 0:
            change[0] = 1 - 2 * own[0]  # a full bin is no longer open
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < nowhere:
            g = best + s
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = size, made, made + 1
        bins[i], offset[i] = b, size - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offset


def pack(rows: DataFrame, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of (id, piece, start, length, ids_crc32)."""
    rows = C.materialize(rows, "pieces")
    short = rows.where(F.col("length") < size)
    shards = max(1, -(-short.count() // shard_pieces))
    kind = dict(rows.dtypes)["id"]

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offset = sum_of_squares(table["length"].to_numpy(), size)
        shard = table["shard"].to_numpy()
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array((shard << 32) | bins)).append_column("offset", pa.array(offset))

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = short.withColumn("shard", F.expr(f"pmod(xxhash64(id, piece, ids_crc32), {shards})"))
    packed = dealt.groupBy("shard").applyInArrow(place, schema)
    # whole sequences: numbered below zero, apart from those of the shards
    whole = rows.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of every document with their place: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, size, end_id, id_col, text_col), size, shard_pieces).withColumnRenamed("id", id_col)
