"""Importance resampling of documents towards a target, on hashed runs of words.

Every document and every target text is a bag of runs of 1 to 3 consecutive words, joined by
one space, each counted in the bucket crc32(run) modulo ``BUCKETS``.  A bucket's gain is the
log ratio of its smoothed shares in target and corpus; a document's weight is the sum of the
gains of its runs, and adding Gumbel noise to weights before taking the highest draws without
replacement in proportion to the weights.

The runs come from a byte automaton over the Arrow buffers of whole batches: a lookup table
classifies bytes, differences of the classes give word boundaries, and the table-driven
CRCs of all words of a batch advance one byte at a time, longest words first, so each step is
a few numpy passes over the words still open.  The state after one word goes on, through a
space, over the next word: the runs of 2 and 3 words are never written out.

Two passes over the texts: one counts buckets (each task sends ``BUCKETS`` sums at most), one
weighs.  The ranks of the drawn come from a sorted range partitioning and its counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C

BUCKETS = 10_000
ORDERS = 3
#: Words beyond this many bytes advance by zlib, one by one.
LONG_WORD = 128


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, from the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC register of each start after the ``sizes`` bytes that follow it in ``data``."""
    short = np.minimum(sizes, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]  # longest first: the open ones are a prefix
    s, at = state[order], starts[order]
    open_ = len(s) - np.cumsum(np.bincount(short, minlength=LONG_WORD + 2))  # with more than j bytes
    s_long = s[: open_[LONG_WORD]].copy()
    for j in range(int(short.max(initial=0))):
        n = open_[j]
        s[:n] = CRC[(s[:n] ^ data[at[:n] + j]).astype(np.uint8)] ^ (s[:n] >> np.uint32(8))
    for i, place in enumerate(order[: len(s_long)]):
        word = data[starts[place] : starts[place] + sizes[place]]
        s[i] = ~np.uint32(zlib.crc32(word.tobytes(), int(~s_long[i])))
    out = np.empty_like(s)
    out[order] = s
    return out


def runs(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the runs of 1, 2 and 3 words that end at each word (-1: no such run), and each row's first word."""
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.ALNUM)
    sizes, n = ends - starts, len(starts)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at = np.arange(n)  # the words at which the runs begun so far have ended
    state = advance(np.full(n, 0xFFFFFFFF, np.uint32), low, starts, sizes)
    out = []
    for order in range(ORDERS):
        bucket = np.full(n, -1, np.int64)
        bucket[at] = ~state % np.uint32(buckets)
        out.append(bucket)
        if order + 1 < ORDERS:
            goes = np.flatnonzero(at + 1 < n)
            goes = goes[row[at[goes] + 1] == row[at[goes]]]
            at, state = at[goes] + 1, state[goes]
            state = CRC[(state ^ np.uint32(32)).astype(np.uint8)] ^ (state >> np.uint32(8))
            state = advance(state, low, starts[at], sizes[at])
    return out, first


def _segments(batch: pa.RecordBatch, name: str, limit: int = C.CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, lead): whole rows, or parts of one long row behind its ``lead`` last words so far."""
    for row, _, data, offs in C.chunks(batch, name, limit):
        if len(offs) > 2 or len(data) <= 2 * limit:
            yield row, data, offs, 0
            continue
        at, carry, lead = 0, np.zeros(0, np.uint8), 0
        while at < len(data):
            end = min(len(data), at + limit)
            while end < len(data) and C.ALNUM[C.LOWER[data[end]]]:  # on to the end of the word
                step = C.ALNUM[C.LOWER[data[end : end + limit]]]
                end += len(step) if step.all() else int(step.argmin())
            part = np.concatenate([carry, data[at:end]])
            yield row, part, np.array([0, len(part)]), lead
            starts, ends, _ = C.word_spans(C.LOWER[part], np.array([0, len(part)]), C.ALNUM)
            lead = min(ORDERS - 1, len(starts))
            carry = np.concatenate([x for a, b in zip(starts[len(starts) - lead :], ends[len(starts) - lead :], strict=True) for x in (part[a:b], np.array([32], np.uint8))] or [carry[:0]])
            at = end


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Runs of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offs, lead in _segments(batch, "text"):
                for found in runs(data, offs, buckets)[0]:
                    total += np.bincount(found[lead:][found[lead:] >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    part = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint")
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + k) / ((x + 1.0) * (t + k)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight) of every row; a text without words weighs 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, data, offs, lead in _segments(batch, "text"):
                found, first = runs(data, offs, len(gain))
                first = np.maximum(first, lead) if lead else first
                part = slice(row, row + len(offs) - 1)
                words[part] += np.diff(first)
                for bucket in found:
                    some = bucket >= 0
                    for into, value in ((features, some), (weight, np.where(some, gain[bucket], 0))):
                        into[part] += np.diff(np.concatenate([[0], np.cumsum(value)])[first])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(features), pa.array(weight)], [id_col, "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for those not drawn.

    Of the N rows with at least ``min_words`` words the floor(percent * N / 100) highest scores
    are drawn, ties to the smaller id, then null ids.  score = weight + floor(-1000 ln(-ln u)),
    where u comes from sha256 of "seed:id" (a null id: of "seed:").  Null and empty texts have
    no words; they count in nothing and get weight 0.  Repeated rows are rows of their own with equal scores.
    Empty tables on either side are allowed.  ``docs`` may have any other columns.
    """
    spark = docs.sparkSession
    run = C.Tables(spark, "importance")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise)
    scored = run.write(scored.withColumn("eligible", F.col("n_words") >= min_words).withColumn("row", F.monotonically_increasing_id()), "scored")

    order = [F.desc("eligible"), F.desc("score"), F.col(id_col).asc_nulls_last(), F.col("row")]
    dealt = scored.repartitionByRange(C.width(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits, the place in it below
    dealt = run.write(dealt.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    run.drop("scored")
    sizes = sorted((r.part, r.n, r.some) for r in dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("bigint")).alias("some")).collect())  # one row a partition
    drawn = percent * sum(some for _, _, some in sizes) // 100
    before, at = [], 0
    for part, n, _ in sizes:
        before.append((part, at))
        at += n
    rank = F.col("before") + F.col("place") + 1
    ranked = dealt.join(F.broadcast(spark.createDataFrame(before, "part bigint, before bigint")), "part")
    return ranked.select(id_col, "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (rank <= drawn), rank).alias("rank"))
