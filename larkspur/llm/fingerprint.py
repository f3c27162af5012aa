"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases again and again.  At each level runs of one symbol
become one symbol; deterministic coin tossing reduces each symbol to a label from its lowest
bit that differs from its left neighbour, three times over; phrases begin at local maxima of
the labels; and a phrase's name is the hash of what it stands for.  Cuts depend on a few symbols
around them only, so equal substrings get equal names inside, whatever stands before them.

The fingerprint is the bottom-k sketch of the names from level ``FLOOR`` up, with the name of
the whole text; a name that stands there n times counts n times.  Likeness of two
fingerprints is the share of names in common (Dice) that the sketches estimate.

Defined results: null and empty texts have the fingerprint ``EMPTY``; two empty texts are
alike (1.0), an empty and a non-empty one are not (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C

K = 48
FLOOR = 2
EMPTY = "-"
_LOWEST = np.array([8, *((i & -i).bit_length() - 1 for i in range(1, 256))], np.uint8)


def _labels(lab: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Coin tossing on small labels: 2 k + bit k, with k the lowest bit that differs from the left neighbour's."""
    for _ in range(rounds):
        left = np.empty_like(lab)
        left[1:] = lab[:-1]
        left[first] = lab[first] ^ 1
        k = _LOWEST[lab ^ left]
        lab = (k << 1) | ((lab >> k) & 1)
    return lab


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels of symbols that differ from their left neighbours; ``first`` flags the first symbol of a text."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    low = x ^ left
    low &= np.uint64(0) - low
    k = np.bitwise_count(low - np.uint64(1))
    return _labels((k << 1) | ((x & low) != 0), first, 3)


def _cuts(symbols: np.ndarray, first: np.ndarray, bottom: bool) -> np.ndarray:
    """Where phrases begin: each text's first symbol, and local maxima of the labels but for its last symbol."""
    lab = _labels(symbols, first, 4) if bottom else _tossed(symbols, first)
    cut = first.copy()
    cut[1:-1] |= (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:]) & ~first[2:]
    return np.flatnonzero(cut)


def parse(symbols: np.ndarray, starts: np.ndarray | None, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the byte offsets where phrases begin, and the flags of each text's first phrase.

    ``symbols`` are bytes at the bottom (``starts`` None), names above; runs of one symbol
    are one symbol, at the bottom marked by a flipped top bit.
    """
    new = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[1:] |= first[1:]
    at = np.flatnonzero(new)
    bottom = starts is None
    if len(at) < len(symbols):
        length = np.diff(np.append(at, len(symbols)))
        symbols, first = symbols[at], first[at]
        many = np.flatnonzero(length > 1)
        if bottom:
            symbols[many] ^= np.uint8(0x80)
        else:
            symbols[many] = C.mix(symbols[many] ^ (length[many].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        starts = at if bottom else starts[at]
    elif bottom:
        starts = at
    cut = _cuts(symbols, first, bottom)
    return starts[cut], first[cut]


def sketches(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each row as sorted 32-bit values (empty for an empty row).

    A phrase is named by the hash of the bytes it stands for, which its symbols' names
    determine and which prefix sums give for any phrase in one step.
    """
    n = len(offs) - 1
    full = np.flatnonzero(np.diff(offs) > 0)
    out = [np.zeros(0, np.uint32)] * n
    if not len(full):
        return out
    row = full  # of each text that still has more than one symbol
    first = np.zeros(len(data), bool)
    first[offs[full]] = True
    sums = C.prefix_hash(data)
    x, starts, level, keys = data.copy(), None, 0, []

    def keep(rows: np.ndarray, values: np.ndarray) -> None:
        keys.append((rows.astype(np.uint64) << np.uint64(32)) | (C.mix(values) >> np.uint64(32)))

    while len(row):
        starts, first = parse(x, starts, first)
        level += 1
        at = np.flatnonzero(first)
        ends = np.append(starts[1:], 0)
        ends[np.append(at[1:], len(starts)) - 1] = offs[row + 1]
        x = C.span_hash(sums, starts, ends)
        count = np.diff(np.append(at, len(x)))
        done = count == 1
        keep(row[done], x[at[done]])  # the name of a whole text, once
        live = np.repeat(~done, count)
        x, starts, first, row, count = x[live], starts[live], first[live], row[~done], count[~done]
        if level >= FLOOR:
            keep(np.repeat(row, count), x + np.uint64(level))
    key = np.sort(np.concatenate(keys))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(key):  # a name that repeats counts as often as it stands there
        nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        again = np.flatnonzero(nth)
        mixed = C.mix((key[again] & np.uint64(0xFFFFFFFF)) * np.uint64(0x9FB21C651E98DF25) + nth[again].astype(np.uint64)) >> np.uint64(32)
        key[again] = (key[again] & np.uint64(0xFFFFFFFF00000000)) | mixed
        key = C.distinct(key)
    cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    for r in full:
        out[r] = key[cut[r] : min(cut[r + 1], cut[r] + K)].astype(np.uint32)
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex() or EMPTY


def likeness(a: np.ndarray | str, b: np.ndarray | str) -> float:
    """Estimated share of common phrase names of two fingerprints (texts or values), 0 to 1."""
    a, b = (np.frombuffer(bytes.fromhex(x.strip("-")), ">u4") if isinstance(x, str) else x for x in (a, b))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)
    if max(len(a), len(b)) >= K:
        union = union[:K]
        both = both[both <= union[-1]]
    j = len(both) / len(union)
    return 2 * j / (1 + j)


def _chain(rows: list[tuple], follower: str) -> Iterator[tuple]:
    """Results of consecutive rows (id, text); ``follower`` is the text after the last."""
    texts = [t for _, t in rows] + [follower]
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:], strict=False)]
    raw = [t.encode() for t in texts + edited]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    found = sketches(np.frombuffer(b"".join(raw), np.uint8), offs)
    own, other = found[: len(texts)], found[len(texts) :]
    for i, (key, t) in enumerate(rows):
        yield key, len(t), hashlib.sha256(raw[len(texts) + i]).hexdigest(), text_of(own[i]), text_of(other[i]), likeness(own[i], other[i]), likeness(own[i], own[i + 1])


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket in descending id, the row that follows the bucket (role 1) last."""
    bucket, head, rows, size = None, "", [], 0
    kind = None

    def out(results: Iterator[tuple]) -> pa.RecordBatch:
        cols = list(zip(*results, strict=True)) or [[]] * 7
        types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", *COLUMNS])

    for batch in batches:
        kind = batch.column("id").type
        for key, b, role, text in zip(batch.column("id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("role").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            if b != bucket:
                if rows:
                    yield out(_chain(rows, head))
                bucket, head, rows, size = b, text, [], 0
            if rows and (role or size > C.CHUNK_BYTES):
                yield out(_chain(rows, text))
                rows, size = [], 0
            if not role:
                rows.append((key, text))
                size += 2 * len(text)
    if rows:
        yield out(_chain(rows, head))


def _bucket(bounds: list[int]) -> str:
    """SQL text for the number of bounds below id, looked up in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1 :: step]
    fine = f"array({','.join(f'{b}L' for b in bounds)})" if bounds else "array(0L)"
    if not bounds:
        return "0"
    return f"(size(filter(array({','.join(f'{b}L' for b in coarse)}), b -> b < id)) * {step} + size(filter(slice({fine}, size(filter(array({','.join(f'{b}L' for b in coarse)}), b -> b < id)) * {step} + 1, {step}), b -> b < id)))"


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, with their likeness to each other and to the next row.

    The next row is the one with the next smaller id (null ids last, equal ids by the hash of
    their text); after the last comes the first.  The edited text has its last third replaced
    by as many first characters of the next row.  Rows are dealt once, into ranges of ids; the
    first row of a range is also sent to the range above it, so ranges need no other exchange.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    ranges = 4 * C.width(spark)
    cuts = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = sorted({int(c) for c in cuts})
    bucket = F.expr(_bucket(bounds))
    heads = sorted((r.b, r.h) for r in ids.groupBy(bucket.alias("b")).agg(F.max("id").alias("h")).collect() if r.h is not None)
    after = {h: heads[(i + 1) % len(heads)][0] for i, (_, h) in enumerate(heads)}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("bucket", bucket)
    if after:
        given = spark.createDataFrame(list(after.items()), "id long, above int")  # one row a range
        rows = rows.join(F.broadcast(given), "id", "left")
    else:
        rows = rows.withColumn("above", F.lit(None).cast("int"))
    rows = rows.select("id", "text", F.explode(F.expr("filter(array(struct(bucket as bucket, 0 as role), if(above is null, null, struct(above as bucket, 1 as role))), x -> x is not null)")).alias("to"))
    rows = rows.select("id", "text", "to.bucket", "to.role", F.xxhash64("text").alias("h"))
    dealt = rows.repartition(2 * C.width(spark), "bucket").sortWithinPartitions("bucket", "role", F.desc_nulls_last("id"), "h")
    out = dealt.select("id", "bucket", "role", "text").mapInArrow(_walk, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)
