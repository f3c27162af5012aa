"""External induced suffix sorting of byte fragments, with common-prefix values.

``sort_suffixes`` yields the suffixes of a shard in order, bucket by bucket, each with the
length of the prefix it shares with the one before it (cut at ``depth``).  Suffixes that
start a descent (type S preceded by type L) are sorted first: one pass of induction sorts
their substrings, which gives each a name; the string of names is sorted by the same method
again, down to one that ``memory`` holds, whose order is found by doubling.  Then a pass
from the smallest bucket up induces the L suffixes and a pass from the largest down the S
suffixes.

The queues that carry suffixes to their bucket are priority queues by symbol and arrival: what
arrives for one bucket is in its final order already.  A queue takes in (position, common
prefix) tuples; beyond ``memory`` of them it writes them to disk as a run in order of bucket,
and a bucket is taken from the heads of all runs.  Text, types, prefix sums, names and star
suffixes of a shard beyond ``memory`` symbols lie in mapped files and are made block by block.
So memory holds ``memory`` tuples a queue, one block and the tuples of the largest bucket.
The common-prefix value of an induced neighbour pair is one more than the smallest value
between the two sources.

Order and values are exact up to ``depth`` symbols; what lies beyond does not matter here.
Names and first common prefixes compare 64-bit hashes.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from larkspur.llm import common as C

MEMORY = 1 << 20


class Scratch:
    """Arrays of one sort: in memory up to ``memory`` entries, else mapped files of a folder."""

    def __init__(self, memory: int, folder: str):
        self.memory, self.folder, self.made = memory, folder, 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, dtype)
        return np.asarray(np.memmap(self.path(), dtype, "w+", shape=n))

    def blocks(self, n: int) -> list[tuple[int, int]]:
        step = max(self.memory, 64)
        return [(a, min(n, a + step)) for a in range(0, n, step)]


_LOW = C.powers(1 << 16)
_HIGH = tuple(np.array([pow(int(base[1]), i << 16, 1 << 64) for i in range(1 << 10)], np.uint64) for base in _LOW)


def _power(at: np.ndarray, inverse: bool) -> np.ndarray:
    """base ** at (or its inverse) modulo 2**64, for at below 2**26."""
    at = np.asarray(at, np.int64)
    return _HIGH[inverse][at >> 16] * _LOW[inverse][: 1 << 16][at & 0xFFFF]


LONGEST = 1 << 26


def _sums(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Prefix sums of symbol * base ** place; a span's hash is their difference times base ** -start."""
    out, last = scratch.array(len(t) + 1, np.uint64), np.uint64(0)
    for a, b in scratch.blocks(len(t)):
        out[a + 1 : b + 1] = np.cumsum((t[a:b].astype(np.uint64) + np.uint64(1)) * _power(np.arange(a, b), False)) + last
        last = out[b]
    return out


class Run:
    """Tuples in order of bucket; whole buckets are taken from its front, or from its back."""

    def __init__(self, bucket: np.ndarray, pos: np.ndarray, lcp: np.ndarray, back: bool):
        self.bucket, self.pos, self.lcp, self.back = bucket, pos, lcp, back
        self.low, self.high = 0, len(bucket)

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, reach = self.low, self.high, 1024
        if low == high or self.bucket[high - 1 if self.back else low] != c:
            return self.pos[:0], self.lcp[:0]
        while reach < high - low and self.bucket[high - reach if self.back else low + reach - 1] == c:
            reach *= 2
        reach = min(reach, high - low)
        if self.back:
            a = high - reach + int(np.searchsorted(self.bucket[high - reach : high], c, "left"))
            self.high = a
            return np.array(self.pos[a:high]), np.array(self.lcp[a:high])
        b = low + int(np.searchsorted(self.bucket[low : low + reach], c, "right"))
        self.low = b
        return np.array(self.pos[low:b]), np.array(self.lcp[low:b])


class Queue:
    """Tuples waiting for their bucket, written to disk as a sorted run beyond ``memory`` of them."""

    def __init__(self, scratch: Scratch, back: bool):
        self.scratch, self.back = scratch, back
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held, self.runs = 0, []

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.waiting.setdefault(bucket, []).append((pos, lcp))
        self.held += len(pos)
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        parts = [(c, p, v) for c in sorted(self.waiting) for p, v in self.waiting[c]]
        files = []
        for dtype, column in ((np.int32, [np.full(len(p), c, np.int32) for c, p, _ in parts]), (np.int32, [p for _, p, _ in parts]), (np.uint8, [v for _, _, v in parts])):
            path = self.scratch.path()
            with open(path, "wb") as f:
                for x in column:
                    x.astype(dtype, copy=False).tofile(f)
            files.append(np.asarray(np.memmap(path, dtype, "r")))
        self.runs.append(Run(*files, self.back))
        self.waiting, self.held = {}, 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        late = self.waiting.pop(c, [])
        self.held -= sum(len(p) for p, _ in late)
        parts = [x for x in (r.pop(c) for r in self.runs) if len(x[0])] + late
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])


def _types(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where a suffix is of type S (smaller than the next one)."""
    n, later = len(t), True
    out = scratch.array(n, bool)
    for a, b in reversed(scratch.blocks(n)):
        now, after = t[a:b], t[a + 1 : b + 1]
        if b == n:
            after = np.append(after, now[-1] + 1)
        m = b - a
        settled = np.where(now == after, m, np.arange(m))
        settled = np.minimum.accumulate(settled[::-1])[::-1]  # the next place that differs from its successor
        out[a:b] = np.append(now < after, later)[settled]
        later = out[a]
    return out


def _between(lcp: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For sources at places ``at``: 1 + the smallest value after the previous one, up to ``depth``."""
    out = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
    return np.minimum(out.astype(np.int16) + 1, depth).astype(np.uint8)


def _common(t: np.ndarray, a: int, b: int, depth: int) -> int:
    """Common prefix of the suffixes at ``a`` and ``b``, up to ``depth``."""
    m = min(depth, len(t) - max(a, b))
    differ = np.flatnonzero(t[a : a + m] != t[b : b + m])
    return int(differ[0]) if len(differ) else m


def _send(queue: Queue, t: np.ndarray, src: np.ndarray, lcp: np.ndarray, want: Callable, depth: int, carry: bool) -> None:
    """Push the predecessors that ``want`` accepts to the bucket of their symbol, in source order."""
    at = np.flatnonzero(src > 0)
    pred = src[at] - 1
    ch = t[pred]
    use = want(ch)
    at, pred, ch = at[use], pred[use], ch[use]
    if not len(at):
        return
    order = np.argsort(ch, kind="stable")
    cuts = np.flatnonzero(np.diff(ch[order])) + 1
    for part in np.split(order, cuts):
        own = _between(lcp, at[part], depth) if carry else np.zeros(len(part), np.uint8)
        own[0] = 1 if carry else 0  # sources of other buckets differ in the first symbol
        queue.push(int(ch[part[0]]), pred[part], own)


def _waves(t: np.ndarray, pos: np.ndarray, lcp: np.ndarray, c: int, depth: int, carry: bool) -> tuple[np.ndarray, np.ndarray]:
    """Add the suffixes that the bucket induces into itself: one more leading ``c`` with each wave."""
    all_pos, all_lcp, k = [pos], [lcp], 1
    while len(pos):
        at = np.flatnonzero(pos > 0)
        pred = pos[at] - 1
        same = t[pred] == c
        at, pred = at[same], pred[same]
        if not len(at):
            break
        own = _between(lcp, at, depth) if carry else np.zeros(len(at), np.uint8)
        own[0] = min(k, depth)
        all_pos.append(pred)
        all_lcp.append(own)
        pos, lcp, k = pred, own, k + 1
    return np.concatenate(all_pos), np.concatenate(all_lcp)


def _induce(t: np.ndarray, seeds: Queue | Run, symbols: int, depth: int, scratch: Scratch, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both passes; yields the finished buckets from the largest symbol down, each in descending order."""
    up, down, done = Queue(scratch, False), Queue(scratch, True), Queue(scratch, True)
    for c in range(symbols):
        pos, lcp = up.pop(c)
        if len(lcp):
            lcp[0] = 0
        pos, lcp = _waves(t, pos, lcp, c, depth, carry)
        star, star_lcp = seeds.pop(c)
        if len(pos):
            done.push(c, pos, lcp)
        src, both = np.concatenate([pos, star]), np.concatenate([lcp, star_lcp])
        if len(pos) and len(star) and carry:
            both[len(pos)] = _common(t, int(pos[-1]), int(star[0]), depth)
        if len(src):
            _send(up, t, src, both, lambda ch, c=c: ch > c, depth, carry)
    for c in range(symbols - 1, -1, -1):
        pos, lcp = down.pop(c)
        if len(lcp):
            lcp[0] = 0
        pos, lcp = _waves(t, pos, lcp, c, depth, carry)
        low, low_lcp = done.pop(c)
        back = np.zeros(len(low), np.uint8)
        back[1:] = low_lcp[:0:-1]
        src, both = np.concatenate([pos, low[::-1]]), np.concatenate([lcp, back])
        if len(pos) and len(low) and carry:
            both[len(pos)] = _common(t, int(pos[-1]), int(low[-1]), depth)
        if len(src):
            _send(down, t, src, both, lambda ch, c=c: ch < c, depth, carry)
            yield src, both


def sort_suffixes(t: np.ndarray, depth: int, memory: int = MEMORY, symbols: int = 257) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``t`` and their common prefix with the one before, bucket by bucket, in descending order.

    ``t`` are symbols below ``symbols`` with 0 after each fragment (no two zeros in a row, the
    last symbol 0); the final 0 itself is left out.  ``depth`` is at most 255.
    """
    if len(t) >= LONGEST:
        raise ValueError(f"a shard of {len(t)} symbols; {LONGEST - 1} at most")
    folder = tempfile.mkdtemp(prefix="induced-")
    try:
        yield from _sorted(t, depth, Scratch(memory, folder), symbols, True)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _sorted(t: np.ndarray, depth: int, scratch: Scratch, symbols: int, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(t)
    kind = _types(t, scratch)
    is_star = scratch.array(n, bool)
    m = 0
    for a, b in scratch.blocks(n):
        is_star[a:b] = kind[a:b] & ~np.append(kind[a - 1] if a else True, kind[a : b - 1])
        m += int(np.count_nonzero(is_star[a:b]))
    star, at = scratch.array(m, np.int32), 0
    for a, b in scratch.blocks(n):
        found = np.flatnonzero(is_star[a:b]) + a
        star[at : at + len(found)] = found
        at += len(found)
    sums = _sums(t, scratch)
    ordered = _in_order(t, star, is_star, sums, depth, scratch, symbols)
    first, lcp = scratch.array(m, np.int32), scratch.array(m, np.uint8)
    for a, b in scratch.blocks(m):
        first[a:b] = t[ordered[a:b]]
        if carry:
            same = np.flatnonzero(first[a:b] == np.append(first[a - 1] if a else -1, first[a : b - 1])) + a
            lcp[same] = _prefixes(sums, ordered[same].astype(np.int64), ordered[same - 1].astype(np.int64), n, depth)
    yield from _induce(t, Run(first, ordered, lcp, False), symbols, depth, scratch, carry)


def _prefixes(sums: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at ``a`` and ``b`` by bisection over prefix sums."""
    low, high = np.zeros(len(a), np.int64), np.minimum(depth, n - np.maximum(a, b))
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low.astype(np.uint8)
        mid = (low[live] + high[live] + 1) >> 1
        x, y = a[live], b[live]
        equal = (sums[x + mid] - sums[x]) * _power(x, True) == (sums[y + mid] - sums[y]) * _power(y, True)
        low[live[equal]] = mid[equal]
        high[live[~equal]] = mid[~equal] - 1


def _in_order(t: np.ndarray, star: np.ndarray, is_star: np.ndarray, sums: np.ndarray, depth: int, scratch: Scratch, symbols: int) -> np.ndarray:
    """The star suffixes in order: their substrings by induction, then the string of their names."""
    m = len(star)
    if m < 2:
        return star
    seeds = Queue(scratch, False)
    for a, b in scratch.blocks(m):
        ch = t[star[a:b]]
        order = np.argsort(ch, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(ch[order])) + 1):
            seeds.push(int(ch[part[0]]), star[a:b][part], np.zeros(len(part), np.uint8))
    order, at = scratch.array(m, np.int32), m
    for src, _ in _induce(t, seeds, symbols, depth, scratch, False):
        found = src[is_star[src]][::-1]
        order[at - len(found) : at] = found
        at -= len(found)
    order[0] = star[-1]  # the last symbol is the smallest
    name, last = scratch.array(m, np.int32), -1
    before = (np.uint64(0), -1)
    for a, b in scratch.blocks(m):
        place = np.searchsorted(star, order[a:b])
        s = order[a:b].astype(np.int64)
        e = star[np.minimum(place + 1, m - 1)].astype(np.int64) + 1  # each substring ends with the first symbol of the next
        h = (sums[e] - sums[s]) * _power(s, True)
        new = (h != np.append(before[0], h[:-1])) | (e - s != np.append(before[1], (e - s)[:-1]))
        rank = last + np.cumsum(new)
        name[place] = rank
        last, before = int(rank[-1]), (h[-1], int((e - s)[-1]))
    if last + 1 == m:
        return order
    # each star substring spans two symbols at least, so depth / 2 names reach the depth
    out, at = scratch.array(m, np.int32), m
    if m <= scratch.memory:
        out[:] = star[_doubled(name, depth // 2 + 1)]
        return out
    for src, _ in _sorted(name, depth // 2 + 1, scratch, last + 1, False):
        out[at - len(src) : at] = star[src[::-1]]
        at -= len(src)
    out[0] = star[-1]
    return out


def _doubled(name: np.ndarray, depth: int) -> np.ndarray:
    """Places of a string of names in order of the first ``depth`` names from there."""
    m = len(name)
    rank, step = name.astype(np.int64) + 1, 1
    while step <= depth and rank.max() < m:
        nxt = np.zeros(m, np.int64)
        nxt[: m - step] = rank[step:]
        key = rank * (m + 1) + nxt
        by = np.argsort(key, kind="stable")
        new = np.ones(m, np.int64)
        new[1:] = key[by][1:] != key[by][:-1]
        rank[by] = np.cumsum(new)
        step *= 2
    return np.argsort(rank, kind="stable")
