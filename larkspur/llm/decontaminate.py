"""Benchmark decontamination by suffix arrays over the training text.

Every shard of training text (a piece of a scan task) becomes an array of word numbers;
its suffixes are sorted by their leading words and every benchmark suffix is looked up by
binary search, which gives the places where a whole benchmark window stands verbatim.
Equal benchmark windows are looked up once, and what a window covers is counted by intervals
of the sorted array, so texts of few distinct words cost no more than others.  The longest
verbatim match of a document is found by halving its length: a hash of every stretch of that
length in the document against those of the benchmark.  Suffixes that cannot match, because their first
two words stand nowhere in the benchmark, are left out of the array before sorting.

The benchmark is sent to the tasks in blocks of at most ``block_bytes`` of text, one scan of
the documents a block, so what is broadcast stays bounded however long the benchmark.  What
the blocks find is united by id and hash of the text, so rows and results do not depend on
their number.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  An item of fewer words
than the window is one window by itself.  Defined results: null, empty and wordless texts
have no words and no hits; items with null id or no words are left out; an empty benchmark
hits nothing; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm import common as C

WINDOW = 10
BLOCK_BYTES = 16 << 20


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.ALNUM)
    return C.span_hash(C.prefix_hash(low), starts, ends), first


class Suffixes:
    """Benchmark suffixes of one block: word numbers, search bounds and the item of each."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        words, first = _words(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.ids, self.window = np.array(ids, dtype=object), window
        self.vocab, number = np.unique(words, return_inverse=True)
        number = number.astype(np.int64) + 1
        lens = np.diff(first)
        size = np.minimum(lens, window)
        count = np.where(size > 0, lens - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), count)
        length = size[item]
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        two = start[length > 1]
        self.pairs, self.single = np.unique((number[two] << 32) | number[two + 1]), np.unique(number[start[length == 1]])
        low, high = np.zeros((len(start), window), ">u4"), np.full((len(start), window), 0xFFFFFFFF, ">u4")
        for j in range(window):
            ok = length > j
            low[ok, j] = high[ok, j] = number[start[ok] + j]
        # distinct windows, and the items of each: of[bounds[w]:bounds[w + 1]]
        self.low, one, of = np.unique(self._fixed(low), return_index=True, return_inverse=True)
        self.high, self.length = self._fixed(high)[one], length[one]
        pairs = np.unique(of.astype(np.int64) * max(1, len(ids)) + item)
        self.of, self.bounds = pairs % max(1, len(ids)), np.searchsorted(pairs // max(1, len(ids)), np.arange(len(one) + 1))
        self.words, self.first, self.longest_item = words, first, int(lens.max(initial=0))
        self.stretches: dict[int, np.ndarray] = {}

    def _fixed(self, rows: np.ndarray) -> np.ndarray:
        """Rows of big-endian word numbers as byte strings, which compare as the word sequences do."""
        return np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel()

    @staticmethod
    def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return table[at] == values

    def _hashes(self, size: int) -> np.ndarray:
        """Sorted hashes of all stretches of ``size`` words within one item."""
        if size not in self.stretches:
            if len(self.stretches) >= 32:
                self.stretches.clear()
            start = np.arange(max(0, len(self.words) - size + 1))
            start = start[start + size <= self.first[np.searchsorted(self.first, start, "right")]]
            self.stretches[size] = np.unique(stretch_hash(word_sums(self.words), start, size))
        return self.stretches[size]

    def longest(self, words: np.ndarray, places: np.ndarray) -> tuple[int, int]:
        """Length and first place of the longest verbatim match in the words of one row whose whole windows stand at ``places`` (in order, not empty)."""
        ahead = np.append(np.flatnonzero(np.diff(places) != 1), len(places) - 1)
        ahead = places[ahead[np.searchsorted(ahead, np.arange(len(places)))]] - places + self.window  # no match from here is longer
        sums = word_sums(words)
        least, most, at = self.window, min(int(ahead.max()), self.longest_item), int(places[0])
        while least < most:
            size = (least + most + 1) // 2
            able = places[ahead >= size]
            found = able[self._among(stretch_hash(sums, able, size), self._hashes(size))]
            if len(found):
                least, at = size, int(found[0])
            else:
                most = size - 1
        return least, at

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, lo, hi): training word positions in suffix order, and where each distinct window stands in it."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.vocab):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        number = np.where(self.vocab[at] == words, at + 1, 0)
        last = np.zeros(len(words), bool)
        ends = first[1:][first[1:] > first[:-1]] - 1
        last[ends] = True
        nxt = np.append(number[1:], 0)
        nxt[last] = 0
        can = (number > 0) & ((nxt > 0) & self._among((number << 32) | nxt, self.pairs) | self._among(number, self.single))
        places = np.flatnonzero(can)
        if not len(places):
            return none, none, none
        end_of = np.repeat(first[1:], np.diff(first))[places]
        rows = np.zeros((len(places), self.window), ">u4")
        for j in range(self.window):
            ok = places + j < end_of
            rows[ok, j] = number[places[ok] + j]
        keys = self._fixed(rows)
        order = np.argsort(keys, kind="stable")  # the suffix array of this shard
        keys, places = keys[order], places[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        return places, lo, np.maximum(hi, lo)


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some interval [lo, hi)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change[:-1]) > 0


def word_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums of word * base**position, for ``stretch_hash``."""
    p, _ = C.powers(len(words) + 1)
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each start."""
    _, q = C.powers(len(sums))
    return C.mix((sums[start + size] - sums[start]) * q[start])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Suffixes]:
    ids, texts, size, any_block = [], [], 0, False
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.encode())
        if size >= block_bytes:
            yield Suffixes(ids, texts, window)
            ids, texts, size, any_block = [], [], 0, True
    if ids or not any_block:
        yield Suffixes(ids, texts, window)


HITS = "n_words long, starts array<long>, ends array<long>, items array<string>, longest long, longest_at long"


def _hits(rows: DataFrame, block: Suffixes, every: bool) -> DataFrame:
    """(id, h, HITS) of all rows, or of those with hits: hit word ranges (joined, in order), items found, length and place of the longest match."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            longest, longest_at = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1, np.int64)
            starts: list[list[int]] = [[] for _ in range(batch.num_rows)]
            ends: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for a, b, data, offs in C.chunks(batch, "text"):
                words, first = _words(data, offs)
                n[a:b] = np.diff(first)
                places, lo, hi = find.search(words, first)
                if not (hi > lo).any():
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                for size in np.unique(find.length[hi > lo]):
                    own = find.length == size
                    place = np.sort(places[covered(lo[own], hi[own], len(places))])
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + size, -1)
                    row = np.searchsorted(first, place, "right") - 1
                    begin = np.flatnonzero(np.diff(row, prepend=-1))
                    for r, x, y in zip(row[begin], begin, np.append(begin[1:], len(row)), strict=True):  # longer windows come later
                        if size < find.window:
                            longest[a + r], longest_at[a + r] = size, place[x] - first[r]
                        else:
                            longest[a + r], longest_at[a + r] = find.longest(words[first[r] : first[r + 1]], place[x:y] - first[r])
                hit = np.cumsum(cover)[:-1] > 0
                edge = np.zeros(len(words) + 1, bool)
                edge[first] = True
                run_start = np.flatnonzero(hit & (~np.append(False, hit[:-1]) | edge[:-1]))
                run_end = np.flatnonzero(hit & (~np.append(hit[1:], False) | edge[1:])) + 1
                for s, e in zip(run_start, run_end, strict=True):
                    r = int(np.searchsorted(first, s, "right") - 1)
                    starts[a + r].append(int(s - first[r]))
                    ends[a + r].append(int(e - first[r]))
                # intervals of distinct windows of one length are apart, so this is one entry a place and length
                count = hi - lo
                window = np.repeat(np.arange(len(lo)), count)
                row = np.searchsorted(first, places[np.repeat(lo, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)], "right") - 1
                both = np.unique(window * len(first) + row)
                window, row = both // len(first), both % len(first)
                many = find.bounds[window + 1] - find.bounds[window]
                item = find.of[np.repeat(find.bounds[window], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                for pair in np.unique(np.repeat(row, many) * len(find.ids) + item).tolist():
                    items[a + pair // len(find.ids)].append(find.ids[pair % len(find.ids)])
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest), pa.array(longest_at)],
                ["id", "h", "n_words", "starts", "ends", "items", "longest", "longest_at"],
            )
            yield out if every else out.filter(pa.array(longest > 0))

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, h long, {HITS}")


#: Runs [starts, ends) of an array, in order, to maximal ones.
_JOINED = """aggregate(array_sort(runs), cast(array() as array<struct<starts: bigint, ends: bigint>>), (x, r) ->
    if(size(x) > 0 and r.starts <= element_at(x, -1).ends,
       concat(slice(x, 1, size(x) - 1), array(struct(element_at(x, -1).starts as starts, greatest(element_at(x, -1).ends, r.ends) as ends))),
       concat(x, array(r))))"""


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, runs, longest, longest_at, contaminated) for every row of ``docs``.

    ``items`` holds the ids, as strings in order, of the items with a window in the row,
    ``runs`` the hit word ranges, ``longest`` the words of the longest verbatim match of at
    least a window and ``longest_at`` where the first such match starts (-1 without one).
    """
    rows = _rows(docs, id_col, text_col)
    parts = [_hits(rows, b, every=i == 0).withColumn("block", F.lit(i)) for i, b in enumerate(_blocks(benchmark, item_col, item_text, window, block_bytes))]
    out = parts[0].withColumn("runs", F.arrays_zip("starts", "ends"))
    if len(parts) > 1:
        more = parts[1]
        for p in parts[2:]:
            more = more.union(p)
        # one row for each block with hits in that text
        more = more.dropDuplicates(["id", "h", "block"]).groupBy("id", "h").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("more_runs"), F.flatten(F.collect_list("items")).alias("more_items"), F.max(F.struct("longest", -F.col("longest_at"))).alias("best"))
        more = more.withColumnsRenamed({"id": "more_id", "h": "more_h"})
        out = out.join(more, F.expr("id <=> more_id and h = more_h"), "left")
        out = out.withColumn("runs", F.expr("concat(runs, coalesce(more_runs, array()))")).withColumn("runs", F.expr(_JOINED)).withColumn("items", F.expr("concat(items, coalesce(more_items, array()))"))
        best = F.greatest(F.struct("longest", (-F.col("longest_at")).alias("place")), F.expr("struct(best.longest as longest, best.col2 as place)"))
        out = out.withColumn("best", F.when(F.col("best").isNull(), F.struct("longest", (-F.col("longest_at")).alias("place"))).otherwise(best))
        out = out.withColumn("longest", F.col("best.longest")).withColumn("longest_at", -F.col("best.place"))
    out = out.withColumn("items", F.expr("array_sort(array_distinct(items))")).withColumn("n_hit", F.expr("aggregate(runs, 0L, (x, r) -> x + r.ends - r.starts)"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "runs", "longest", "longest_at", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no benchmark window; repeated rows go or stay together."""
    text_col = params.get("text_col", "text")
    item_col, item_text = params.get("item_col", "item_id"), params.get("item_text", "text")
    blocks = _blocks(benchmark, item_col, item_text, params.get("window", WINDOW), params.get("block_bytes", BLOCK_BYTES))
    out = _clean(docs, next(blocks), text_col)
    gone = None
    for block in blocks:
        found = _hits(_rows(docs, id_col, text_col), block, every=False).select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h"))
        gone = found if gone is None else gone.union(found)
    if gone is None:
        return out
    return out.join(gone.distinct(), out[id_col].eqNullSafe(F.col("_gone_id")) & (_text_hash(out[text_col]) == F.col("_gone_h")), "left_anti")


def _clean(docs: DataFrame, block: Suffixes, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, data, offs in C.chunks(batch, text_col):
                words, first = _words(data, offs)
                places, lo, hi = find.search(words, first)
                keep[a + np.searchsorted(first, places[covered(lo, hi, len(places))], "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
