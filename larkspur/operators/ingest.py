"""Ingestion: sentence splitting, chunking, and turning raw rows into chunk rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from re import Pattern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.functions.sentence import bounds
from larkspur.functions.text import CODE_MARKERS, CODE_STARTS, chunk_type, content_hash, valid_episode, valid_tenant

MAX_BYTES, OVERLAP_BYTES, MIN_BYTES = 1200, 200, 400
SPLIT_FROM = 1000

def _is_code(line: str) -> bool:
    s = line.strip()
    if not s:
        return False
    if any(m in s for m in CODE_MARKERS) or s.startswith(CODE_STARTS):
        return True
    if line.startswith(("    ", "\t")) and any(ch in s for ch in "=(."):
        return True
    return s[-1] in "{};)," and (" " not in s or "(" in s and ")" in s)


def sentences(text: str, abbreviations: Pattern | None = None) -> list[tuple[str, int, bool]]:
    """(sentence, byte offset, is code): a run of code lines is one, prose lines are split by ``functions.sentence``."""
    out: list[tuple[str, int, bool]] = []
    code: list[str] = []
    code_at = at = 0

    def close() -> None:
        body = "\n".join(code).rstrip()
        if body:
            out.append((body, code_at, True))
        code.clear()

    for line in text.split("\n"):
        if _is_code(line):
            if not code:
                code_at = at
            code.append(line)
        elif code and not line.strip():
            code.append(line)
        else:
            close()
            before, so_far = 0, at  # characters of the line behind us, and their place in bytes
            for start, end in bounds(line, abbreviations):
                piece = line[start:end]
                if any(map(str.isalnum, piece)):  # marks alone are no sentence
                    lead = start + len(piece) - len(piece.lstrip())
                    so_far += len(line[before:lead].encode())
                    before = lead
                    out.append((piece.strip(), so_far, False))
        at += len(line.encode()) + 1
    close()
    return out


def _cut(raw: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes, cut at character borders."""
    out = []
    while len(raw) > size:
        end = size
        while end and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end])
        raw = raw[end:]
    return [*out, raw] if raw else out


def chunk_text(text: str | None, most: int = MAX_BYTES, overlap: int = OVERLAP_BYTES, least: int = MIN_BYTES) -> list[tuple[str, int, int, int]]:
    """(text, start, end, index) of the pieces of a text, in bytes of the source.

    A text of at most ``most`` bytes is one piece.  Else sentences are packed greedily and
    joined without a separator; on overflow the last sentences of at most ``overlap`` bytes are
    carried into the next piece; a sentence longer than a piece is cut by itself; and a last
    piece of fewer than ``least`` bytes is joined to the one before.
    """
    raw = (text or "").encode()
    if not raw:
        return []
    if len(raw) <= most:
        return [(raw.decode(), 0, len(raw), 0)]
    pieces: list[list[tuple[bytes, int]]] = []
    now: list[tuple[bytes, int]] = []
    size = fresh = 0
    for sentence, at, _ in sentences(text or ""):
        body = sentence.encode()
        if len(body) > most:
            if fresh:
                pieces.append(now)
            for part in _cut(body, most):
                pieces.append([(part, at)])
                at += len(part)
            now, size, fresh = [], 0, 0
            continue
        if size + len(body) > most and fresh:
            pieces.append(now)
            keep, kept = [], 0
            for s in reversed(now):
                if kept + len(s[0]) > overlap or kept + len(s[0]) + len(body) > most:
                    break
                keep.insert(0, s)
                kept += len(s[0])
            now, size, fresh = keep, kept, 0
        now = [*now, (body, at)]
        size += len(body)
        fresh += 1
    if fresh:
        pieces.append(now)
    if len(pieces) > 1 and sum(len(b) for b, _ in pieces[-1]) < least:
        last = pieces.pop()
        pieces[-1] = pieces[-1] + last
    return [(b"".join(b for b, _ in p).decode(), p[0][1], max(a + len(b) for b, a in p), i) for i, p in enumerate(pieces)]


#: Bytes of text whose pieces are held at once; an Arrow batch of any size is cut to slices of about this.
SLICE_BYTES = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``SLICE_BYTES`` of ``text`` (or one row), so that what a task holds does not grow with its input."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def split_sentences(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, sentence_idx, text, offset, is_code) of every sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, rows = [], []
            for i, t in enumerate(batch.column("text")):
                for j, s in enumerate(sentences(t.as_py() or "")):
                    at.append(i)
                    rows.append((j, *s))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True))], ["id", "sentence_idx", "text", "offset", "is_code"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, sentence_idx int, text string, offset int, is_code boolean").withColumnRenamed("id", id_col)


def split_chunks(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, chunk_index, text, start_char, end_char) of the pieces of every text."""
    return _split(docs, id_col, text_col).drop("total")


def _split(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The same with ``total``, the number of pieces of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, rows = [], []
            for i, t in enumerate(batch.column("text")):
                pieces = chunk_text(t.as_py())
                for text, start, end, index in pieces:
                    at.append(i)
                    rows.append((index, text, start, end, len(pieces)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True))], ["id", "chunk_index", "text", "start_char", "end_char", "total"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, chunk_index int, text string, start_char int, end_char int, total int").withColumnRenamed("id", id_col)


_WORD_BYTES = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


@cache
def _is_word(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def word_bits(text: str) -> bytes:
    """A bit for each byte of a text, the lowest first: set where the byte is one of a letter's or number's."""
    raw = np.frombuffer(text.encode(), np.uint8)
    bits = _WORD_BYTES[raw]
    if len(raw) > len(text):
        at = np.flatnonzero(raw >= 0xC0)  # first bytes of longer characters
        word = np.fromiter(map(_is_word, (c for c in text if c > "\x7f")), bool, len(at))
        size = 2 + (raw[at] >= 0xE0) + (raw[at] >= 0xF0).astype(int)
        for k in range(4):
            bits[at[word & (size > k)] + k] = True
    return np.packbits(bits, bitorder="little").tobytes()


def word_places(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, bits): ``word_bits`` of every text, an eighth of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([word_bits(t.as_py() or "") for t in batch.column("text")], pa.binary())], ["id", "bits"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, bits binary").withColumnRenamed("id", id_col)


def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tenant_id, a, b): stretches of bytes with words that no piece covers.

    Rows come in order of key: a text (kind 0: tenant_id, its size in ``b`` and ``bits``; equal
    texts may come again), then its pieces (kind 1: bytes ``a`` to ``b``) in order of their index.
    """
    key = tenant = bits = None
    end = size = 0
    out: list[tuple] = []

    def meet(a: int, b: int) -> None:
        if b > a and np.unpackbits(bits[a // 8 : b // 8 + 1], bitorder="little")[a % 8 : a % 8 + b - a].any():
            out.append((key, tenant, a, b))

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.int32(), pa.int32()))], ["key", "tenant_id", "a", "b"])
        out.clear()
        return done

    for batch in batches:
        kinds, a, b = (batch.column(c).to_pylist() for c in ("kind", "a", "b"))
        for i, now in enumerate(batch.column("key").to_pylist()):
            if now != key:
                if key is not None:
                    meet(end, size)
                key, tenant, size, end = now, batch.column("tenant_id")[i].as_py(), b[i], 0
                bits = np.frombuffer(batch.column("bits")[i].as_py(), np.uint8)
            if kinds[i]:
                meet(end, min(a[i], size))
                end = max(end, b[i])
        yield flush()
    if key is not None:
        meet(end, size)
        yield flush()


def invalid(rows: DataFrame) -> DataFrame:
    """Rows whose tenant, type or episode is not valid, with the ``reason``."""
    reason = F.when(~valid_tenant(F.col("tenant_id")), "tenant").when(chunk_type(F.col("chunk_type")).isNull(), "type").when(F.col("episode_id").isNotNull() & ~valid_episode(F.col("episode_id")), "episode")
    return rows.withColumn("reason", reason).where("reason is not null")


def prepare(rows: DataFrame) -> DataFrame:
    """Chunk rows from raw ones (tenant_id, project_id, chunk_type, episode_id, tags, text, timestamp_created).

    Texts over 1,000 bytes are split; every piece has its own hash and id (a hash of tenant,
    content and index, so that a rerun makes the same rows) and, if the text was split, tags
    with its place.  The episode tag comes first.  Callers check ``invalid`` before.  A row
    becomes its pieces where it stands; nothing is shuffled.
    """
    row_key = F.sha2(F.concat_ws("\x1f", "tenant_id", F.coalesce("episode_id", F.lit("")), F.coalesce(F.col("timestamp_created").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    keyed = rows.select(F.struct(row_key.alias("row_key"), "tenant_id", "project_id", "chunk_type", "episode_id", "tags", "timestamp_created").alias("row"), "text")
    long = F.octet_length("text") > SPLIT_FROM
    whole = keyed.where(~long).select("row", F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), F.lit(1).alias("total"))
    out = whole.unionByName(_split(keyed.where(long), "row")).select("row.*", F.col("text").alias("piece"), "chunk_index", "start_char", "end_char", "total")
    place = F.when(F.col("total") > 1, F.array(*(F.concat(F.lit(f"{n}:"), F.col(c).cast("string")) for n, c in (("chunk_index", "chunk_index"), ("total_chunks", "total"), ("char_start", "start_char"), ("char_end", "end_char"))))).otherwise(F.array().cast("array<string>"))
    episode = F.when(F.col("episode_id").isNotNull(), F.array(F.concat(F.lit("episode:"), "episode_id"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        F.left(F.sha2(F.concat_ws(":", "row_key", F.col("chunk_index").cast("string")), 256), F.lit(32)).alias("chunk_id"), "tenant_id", "project_id", "timestamp_created",
        chunk_type(F.col("chunk_type")).alias("chunk_type"), F.lit("final").alias("status"), F.col("piece").alias("text"), F.concat(episode, F.coalesce("tags", F.array().cast("array<string>")), place).alias("tags"), content_hash(F.col("piece")).alias("hash"),
    )
