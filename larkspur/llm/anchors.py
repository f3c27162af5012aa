"""Anchors of byte windows: every window of ``size`` bytes names one place inside it.

A window's anchor is the leftmost smallest hash among its grams of ``gram`` bytes, so equal
windows name the same place wherever they stand.  The windows that share an anchor follow
each other; together they make its fragment, text[lo : hi + size].
"""

from __future__ import annotations

import numpy as np

from larkspur.llm import common as C

GRAM = 32


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from running minima of blocks on both sides."""
    m = len(values)
    if m < w:
        return values[:0]
    pad = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:m] = values
    two = pad.reshape(-1, w)
    left = np.minimum.accumulate(two, axis=1).ravel()
    right = np.minimum.accumulate(two[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: m - w + 1], left[w - 1 : m])


def anchors(data: np.ndarray, offs: np.ndarray, size: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi, prefix sums): the places in ``data`` of each fragment's anchor, first and last window."""
    sums = C.prefix_hash(data)
    n = len(data)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none, sums
    _, q = C.powers(n + 1)
    h = C.mix((sums[gram:] - sums[: n - gram + 1]) * q[: n - gram + 1])
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    place = (sliding_min(h, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(n + 1, np.int8)
    long = np.diff(offs) >= size
    step[offs[:-1][long]] += 1
    step[offs[1:][long] - size + 1] -= 1
    start = np.flatnonzero(np.cumsum(step[: n - size + 1], dtype=np.int8))  # windows inside one row
    if not len(start):
        return start, start, start, sums
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    return place[at], start[at], start[np.append(at[1:], len(start)) - 1], sums
