"""Byte-level BPE token ids and the exact length histogram.

``Encoder`` gives the ids that the ``tokenizers`` library gives for a byte-level BPE file.
That library makes about 3 MB of text a second and core, so plain texts take a second path
with the same ranks: the file's vocabulary loaded into a faster BPE.  Texts with an added
token of the file, with characters beyond Latin-1 (where Unicode tables of the two
libraries could differ) or with a run of white space that the faster one has no stack for,
go through ``tokenizers`` itself.  Tests compare both paths.

Long texts are encoded in pieces of about ``PIECE`` characters, cut where the split pattern
always parts words, so memory follows the piece and not the text; ids stay the same.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Fixed value: the split pattern of byte-level BPE files whose pre-tokenizer has use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = 1 << 16
LONG_RUN = 1 << 14
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")
#: No alternative of PATTERN reaches over these places: before white space, and between a full-width stop and a letter.
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[、。，！？])(?=[\u4e00-\u9fa5\u3041-\u3096\uac00-\ud7a3])")


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = not (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout"))
        self.cuts = plain and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in added)
        self.fast = self._fast(spec) if plain and not model.get("ignore_merges") else None

    def _fast(self, spec: dict):
        """The same BPE in the faster library, if the file is one that it can stand for."""
        model = spec["model"]
        try:
            import tiktoken
        except ImportError:
            return None
        byte = _byte_of()
        vocab = {w: i for w, i in model["vocab"].items() if w not in self.added}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):  # ids must grow with the order of merges to serve as ranks
            return None
        ranks = {bytes(byte[ch] for ch in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("larkspur", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Token ids without special tokens, as unsigned 32-bit numbers."""
        if len(text) <= PIECE or not self.cuts:
            return self._ids(text)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            parts.append(self._ids(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and _latin(text) and not any(a in text for a in self.added) and not (len(text) > LONG_RUN and _BLANKS.search(text)):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One column ``length``: the token count of every row (null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.ids(t.as_py() or "")) for t in batch.column("text")], pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums, one row for each length that occurs.

    Columns: length; n_docs (of that length); docs_at_least, tokens_at_least (suffix sums);
    docs_at_most; cumulative_share; tokens_cut_at (tokens left when every document is cut to
    this length: everything below plus length * docs_at_least); tokens_total.

    Documents are counted by length before anything is shuffled, so the histogram is as
    long as the number of different lengths, not as the corpus.  Suffix sums come from the
    sums of ranges of 1024 lengths, so no task sees the whole histogram of a huge corpus.
    Empty input gives no rows; null and empty texts have length 0.
    """
    hist = token_lengths(docs, path, text_col).groupBy("length").agg(F.count("*").alias("n_docs"))
    hist = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.expr("length div 1024"))
    parts = hist.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("tokens").alias("pt"))
    spans = parts.agg(F.collect_list(F.struct("part", "pd", "pt")).alias("all"), F.sum("pd").alias("docs_total"), F.sum("pt").alias("tokens_total"))
    above = hist.join(F.broadcast(spans), F.lit(True))  # one row: an entry for every 1024 lengths
    w = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    later = "aggregate(filter(all, x -> x.part > part), 0L, (a, x) -> a + x.{})"
    out = above.withColumn("docs_at_least", F.sum("n_docs").over(w) + F.expr(later.format("pd"))).withColumn("tokens_at_least", F.sum("tokens").over(w) + F.expr(later.format("pt")))
    return out.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("cumulative_share"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_cut_at"),
        "tokens_total",
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """Smallest length with at least ``share`` of the documents at or below it (column ``length``)."""
    return histogram.where(F.col("cumulative_share") >= share).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to ``limit`` (column ``tokens``), for any limit."""
    total = F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(F.coalesce(total, F.lit(0)).alias("tokens"))
