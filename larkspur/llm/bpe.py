"""Byte-level BPE with a local rank file: ids of whole texts, and their bytes again.

The rank file and the split pattern make an encoding of the tiktoken library.  Each match of
the pattern is encoded on its own and there are no special tokens, so a text may be cut
between any two matches.  Texts longer than ``PIECE`` are cut only where the pattern always
parts them, whatever stands around:

* before a space or line end that follows no white space: no match goes on from a
  character that is no white space to one that is;
* before the last of several white spaces: it goes with the word that follows, or stands alone;
* after an ASCII letter before an ASCII digit or sign, and after a digit before a letter or
  sign: runs of letters and of digits end there, and contractions begin or have ended;
* after an ASCII sign other than ' before a letter or digit;
* between a letter of the large East Asian blocks and their full stops and commas.

Memory follows the piece; only one match longer than a piece is taken as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

PIECE = 1 << 16
#: Bytes of text that one batch of ids may come from.
BATCH_BYTES = 4 << 20
#: White space runs from this length are encoded without the pattern, which has no stack for them.
LONG_RUN = 1 << 14

_SIGN = r"!-&(-/:-@\[-`{-~"
_EAST = r"一-龥ぁ-ゖァ-ヺ가-힣"
_CUT = re.compile(
    r"(?<=\S)(?=[ \n])|(?<=[ \n])(?=[ \n]\S)"
    rf"|(?<=[A-Za-z])(?=[0-9'{_SIGN}])|(?<=[0-9])(?=[A-Za-z'{_SIGN}])|(?<=[{_SIGN}])(?=[A-Za-z0-9])"
    rf"|(?<=[{_EAST}])(?=[、。，！？])|(?<=[、。，！？])(?=[{_EAST}])"
)
#: Fixed value: the characters that the pattern's \s stands for.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = re.compile(rf"{_BLANK}{{{LONG_RUN},}}")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters that no match of the pattern crosses."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Ranks:
    """One rank file as an encoding."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return self._ids(text) if len(text) <= PIECE else np.concatenate([self._ids(p) for p in pieces(text)])

    def _ids(self, text: str) -> np.ndarray:
        """Of a long run of white space before a word, the last one goes with what follows; a run at the end is one match."""
        parts, at = [], 0
        for run in _BLANKS.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            parts += [self.encoding.encode_ordinary(text[at : run.start()]), self.encoding._encode_single_piece(text[run.start() : end])]
            at = end
        parts.append(self.encoding.encode_ordinary(text[at:]))
        return np.concatenate([np.array(p, np.int32) for p in parts])

    def bytes(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows, of about ``limit`` by their sizes."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), kind))


def _ddl(df: DataFrame, but: str) -> tuple[list[str], str]:
    kept = [c for c in df.columns if c != but]
    return kept, "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>): the token ids of the whole text, special tokens never.

    A null or empty text has no ids.  Bytes that are no UTF-8 are read as U+FFFD.  Rows are
    taken one by one, so repeated and null keys stay; a column named ``ids_col`` is replaced.
    """
    kept, ddl = _ddl(docs, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks(path, pattern)
        for batch in batches:
            raw = batch.column("__text")
            sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)
            for part in _parts(batch, sizes, BATCH_BYTES):
                ids = [enc.ids((t.as_py() or b"").decode("utf-8", "replace")) for t in part.column("__text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _lists(ids, pa.int32())], [*kept, ids_col])

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"{ddl}`{ids_col}` array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``bytes_col`` (binary): the raw bytes of the tokens, which need not be UTF-8.

    Null ids give no bytes; an id that the rank file does not have is an error.  A column named
    ``bytes_col`` is replaced.
    """
    kept, ddl = _ddl(encoded, bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for part in _parts(batch, sizes, BATCH_BYTES // 4):
                found = [enc.bytes(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.binary())], [*kept, bytes_col])

    return encoded.mapInArrow(run, f"{ddl}`{bytes_col}` binary")
