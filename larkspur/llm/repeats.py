"""Repeated byte strings found by suffix sorting, and their removal.

A byte goes when a string of ``size`` bytes that covers it also starts anywhere else, in the
same text or another.  Finding them needs only the order of suffixes that can have an equal,
so the corpus is dealt into shards by content and each shard is suffix-sorted by itself:

1. Every window of ``size`` bytes names an anchor inside it (``larkspur.llm.anchors``), the
   windows of one anchor make a fragment.  Equal windows have equal anchors.  Anchors seen
   once are done: none of their windows repeats.
2. Fragments that occur twice or more repeat as a whole; they are told by two 64-bit hashes, of
   the anchor and of the whole fragment.
3. What is left are different fragments around one anchor.  They are dealt to shards by the
   bytes around the anchor that all windows of a half share; shards of one member are done.
   A shard of more than ``CROWD`` members is split again by more of those bytes until they are
   the window itself, so a passage that stands in very many texts is spread by what stands
   next to it, and the members of a shard that still is a crowd hold one and the same window.
4. The fragments of each shard are written to a file, of each that repeats two copies, and
   sorted by external induced suffix sorting (``larkspur.llm.induced``).  Neighbours that share
   ``size`` bytes are the repeats.

Counting, joining and dealing carry numbers and the fragments of step 3 only; whole texts are
shuffled twice, to cut out those fragments and to remove the spans.

Texts are UTF-8 bytes.  Defined results: null is the empty text; texts shorter than ``size``
stay whole; repeated rows are each other's copies; rows with equal ids but different texts
are told apart by a 64-bit hash of the text; null ids are allowed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm import common as C
from larkspur.llm.anchors import GRAM, anchors
from larkspur.llm.induced import MEMORY, sort_suffixes

SIZE = 200
SHARD_BYTES = 2 << 20
CROWD = 8192


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def fragments(rows: DataFrame, size: int) -> DataFrame:
    """(id, h, g, f, lo, a, n): hashes of anchor and fragment, first window, anchor after it, number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, offs in C.chunks(batch, "text"):
                at, lo, hi, sums = anchors(data, offs, size)
                if not len(at):
                    continue
                row = np.searchsorted(offs, lo, "right") - 1
                take = pa.array(row + r0)
                g, f = C.span_hash(sums, at, at + GRAM), C.span_hash(sums, lo, hi + size)
                cols = [pa.array(g.view(np.int64)), pa.array(f.view(np.int64)), pa.array((lo - offs[row]).astype(np.int32)), pa.array((at - lo).astype(np.int16)), pa.array((hi - lo + 1).astype(np.int16))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("h").take(take), *cols], ["id", "h", "g", "f", "lo", "a", "n"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, h long, g long, f long, lo int, a short, n short")


def halves(content: bytes, n: int, u: int, v: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Split the ``n`` windows of a fragment by which side of the shared bytes [u, v) they have more of.

    Yields (key, first window, windows, new u, new v), the last two relative to the first window.
    """
    half = (size - (v - u) + 1) // 2
    left = min(n, u - half + 1)
    if left > 0:
        yield _key(content[u - half : v], half), 0, left, u - half, v
    first = max(0, left)
    if first < n:
        end = v + (size - (v - u)) - half + 1
        yield _key(content[u:end], -half), first, n - first, u - first, end - first


def _key(shared: bytes, tag: int) -> int:
    return int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=str(tag).encode()).digest(), "little", signed=True)


SHARD = "key long, id {kind}, h long, start int, n short, u short, v short, content binary"
_SHARD_TYPES = (pa.int64(), None, pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.binary())


def _shard_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(cols, _SHARD_TYPES, strict=True)], ["key", "id", "h", "start", "n", "u", "v", "content"])


def _cut_out(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, h, text, need): the wanted fragments of a text, in halves."""
        for batch in batches:
            kind, out, held = batch.column("id").type, [], 0
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                key, h = batch.column("id")[i].as_py(), batch.column("h")[i].as_py()
                for x in batch.column("need")[i].as_py():
                    lo, a, n = x["lo"], x["a"], x["n"]
                    content = raw[lo : lo + n - 1 + size]
                    for k, s, m, u, v in halves(content, n, a, a + GRAM, size):
                        out.append((k, key, h, lo + s, m, u, v, content[s : s + m - 1 + size]))
                        held += m + size
                if held > C.CHUNK_BYTES:
                    yield _shard_batch(out, kind)
                    out, held = [], 0
            yield _shard_batch(out, kind)

    return run


def _split_again(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, out = batch.column("id").type, []
            for r in batch.to_pylist():
                for k, s, m, u, v in halves(r["content"], r["n"], r["u"], r["v"], size):
                    out.append((k, r["id"], r["h"], r["start"] + s, m, u, v, r["content"][s : s + m - 1 + size]))
            yield _shard_batch(out, kind)

    return run


class Shard:
    """Fragments of whole keys: their places, and their bytes in a file."""

    def __init__(self, size: int):
        self.size, self.folder = size, tempfile.TemporaryDirectory(prefix="shard-", ignore_cleanup_errors=True)  # goes with the shard, however its task ends
        self.file = open(os.path.join(self.folder.name, "text"), "wb")  # noqa: SIM115
        self.members: list[tuple] = []  # id, h, first window, body
        self.bodies: dict[bytes, int] = {}
        self.times: list[int] = []
        self.at: list[int] = []  # of each body, its place and its windows
        self.windows: list[int] = []
        self.held = self.written = 0

    def add(self, key: int, id_: object, h: int, start: int, content: bytes) -> None:
        name = hashlib.blake2b(content, digest_size=16, key=key.to_bytes(8, "little", signed=True)).digest()
        body = self.bodies.setdefault(name, len(self.bodies))
        if body == len(self.times):
            self.times.append(0)
            self.at.append(self.written)
            self.windows.append(len(content) - self.size + 1)
        self.times[body] += 1
        if self.times[body] <= 2:  # a second copy, so that the sort meets the repeat
            symbols = np.zeros(len(content) + 1, np.uint16)
            symbols[:-1] = np.frombuffer(content, np.uint8)
            symbols[:-1] += np.uint16(1)
            symbols.tofile(self.file)
            self.written += len(symbols)
        self.members.append((id_, h, start, body))
        self.held += len(content)

    def repeats(self, memory: int) -> list[tuple]:
        """Runs (id, h, first window, windows) of windows of these fragments that occur twice."""
        self.file.close()
        out: list[tuple] = []
        if self.written > self.windows[0] + self.size:  # else one window, once
            out = self._found(np.asarray(np.memmap(self.file.name, np.uint16, "r")), memory)
        self.folder.cleanup()
        return out

    def _found(self, t: np.ndarray, memory: int) -> list[tuple]:
        twice = np.zeros(len(t), bool)
        ends = np.append(np.flatnonzero(t == 0), len(t))  # a window starts where ``size`` bytes fit before the fragment's end
        for pos, lcp in sort_suffixes(t, self.size, memory):
            new = lcp < self.size
            new[0] = True
            group = np.cumsum(new) - 1
            whole = ends[np.searchsorted(ends, pos)] - pos >= self.size
            count = np.bincount(group[whole], minlength=group[-1] + 1)
            twice[pos[whole & (count[group] > 1)]] = True
        out = []
        for id_, h, start, body in self.members:
            a, n = self.at[body], self.windows[body]
            hit = np.flatnonzero(np.diff(np.concatenate([[False], twice[a : a + n], [False]]).astype(np.int8)))
            out += [(id_, h, start + int(s), int(e - s)) for s, e in zip(hit[::2], hit[1::2], strict=True)]
        return out


def _sorted_shards(size: int, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole keys are gathered to shards."""
        shard, last, kind = None, None, None

        def done(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "h", "lo", "n"])

        for batch in batches:
            kind = batch.column("id").type
            for key, id_, h, start, content in zip(*(batch.column(x).to_pylist() for x in ("key", "id", "h", "start", "content")), strict=True):
                if shard and shard.held > SHARD_BYTES and key != last:
                    yield done(shard.repeats(memory))
                    shard = None
                shard, last = shard or Shard(size), key
                shard.add(key, id_, h, start, content)
        if shard:
            yield done(shard.repeats(memory))

    return run


def repeat_windows(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, h, lo, n): runs of windows that start at least twice in the corpus."""
    kind = dict(rows.dtypes)["id"]
    t = C.Tables(rows.sparkSession, "repeats")
    every = t.write(fragments(rows, size), "fragments")
    # the counted side of each join is written first: a join of two plain exchanges can be split where one anchor is very common
    shared = t.write(every.groupBy("g").agg(F.count("*").alias("t")).where("t > 1").select("g"), "shared-anchors")
    every = t.write(every.join(shared, "g"), "shared-fragments")
    t.drop("fragments", "shared-anchors")
    bodies = every.groupBy("g", "f").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "lo")).alias("one"))
    bodies = t.write(bodies, "bodies")
    several = t.write(bodies.groupBy("g").agg(F.count("*").alias("bodies")).where("bodies > 1"), "several-bodies")
    bodies = bodies.join(several, "g", "left").withColumn("bodies", F.coalesce("bodies", F.lit(1))).where("c > 1 or bodies > 1")
    marked = every.join(bodies, ["g", "f"]).select("id", "h", "lo", "a", "n", (F.col("c") > 1).alias("twice"), F.expr("bodies > 1 and (c = 1 or one = struct(id, h, lo))").alias("need"))
    marked = t.write(marked, "marked")
    t.drop("shared-fragments", "bodies", "several-bodies")

    need = marked.where("need").groupBy("id", "h").agg(F.collect_list(F.struct("lo", "a", "n")).alias("need")).withColumnsRenamed({"id": "nid", "h": "nh"})
    texts = rows.join(need, F.expr("id <=> nid and h = nh")).select("id", "h", "text", "need")
    shards = t.write(texts.mapInArrow(_cut_out(size), SHARD.format(kind=kind)), "shards")
    ready = None
    while True:
        keys = t.write(shards.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.col("v") - F.col("u")).alias("shared")).where("rows > 1"), "keys")
        crowd = f"rows > {CROWD} and shared < {size}"
        part = shards.join(keys.where(f"not ({crowd})").select("key"), "key").select("key", "id", "h", "start", "content")
        ready = part if ready is None else ready.unionByName(part)
        crowded = keys.where(crowd).select("key")
        if crowded.isEmpty():
            break
        shards = t.write(shards.join(crowded, "key").select("key", "id", "h", "start", "n", "u", "v", "content").mapInArrow(_split_again(size), SHARD.format(kind=kind)), "shards")
    dealt = ready.repartition(4 * C.width(rows.sparkSession), "key").sortWithinPartitions("key")
    found = t.write(dealt.mapInArrow(_sorted_shards(size, MEMORY), f"id {kind}, h long, lo int, n int"), "found")
    t.drop("shards", "keys")
    return marked.where("twice").select("id", "h", "lo", F.col("n").cast("int").alias("n")).unionByName(found)


def _spans(starts: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the windows cover."""
    out: list[list[int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in starts):
        end = lo + n - 1 + size
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def _with_spans(rows: DataFrame, size: int, marks: DataFrame) -> DataFrame:
    found = marks.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "n")).alias("spans")).withColumnsRenamed({"id": "sid", "h": "sh"})
    return rows.join(found, F.expr("id <=> sid and h = sh"), "left")


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, sha = [], [], [], []
            for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = t.as_py().encode()
                spans = _spans(s.as_py() or [], size)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                n.append(len(raw))
                gone.append(sum(b - a for a, b in spans))
                runs.append(len(spans))
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(rows.dtypes)["id"]
    joined = _with_spans(rows, size, repeat_windows(rows, size)).select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, text_col): every text without its repeated bytes; a character cut apart becomes U+FFFD."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, at, parts = t.as_py().encode(), 0, []
                for a, b in _spans(s.as_py() or [], size):
                    parts.append(raw[at:a])
                    at = b
                out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    kind = dict(rows.dtypes)["id"]
    joined = _with_spans(rows, size, repeat_windows(rows, size)).select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})
