"""Helpers shared by the corpus operators: shared-folder tables and byte kernels.

The kernels work on Arrow string batches as flat ``uint8`` arrays plus row offsets, so
words, hashes and windows of a whole batch come from a few numpy passes and no text is
ever decoded to Python objects.  A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local, a temporary folder is made
    (and removed at exit); on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Tables:
    """The tables of one run, in a folder of its own below the shared root.

    Written tables cut lineage and outlive lost executors.  A run drops the tables that
    nothing reads any more; those its result still reads stay until ``drop_since`` or the end
    of the driver, which removes what is left.
    """

    runs: list[Tables] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        if not Tables.runs:
            atexit.register(drop_since, 0)
        Tables.runs.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; a name may be written again."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Remove the tables of these names but the last ``keep`` of each."""
        for name in names:
            held = self.paths.get(name, [])
            for path in held[: len(held) - keep]:
                _remove(self.spark, path)
            self.paths[name] = held[len(held) - keep :]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def drop_since(mark: int) -> None:
    """Remove everything that runs begun since ``mark = len(Tables.runs)`` have written; their results must have been read."""
    for run in Tables.runs[mark:]:
        try:
            _remove(run.spark, run.root)
        except (Py4JError, OSError):  # the driver's JVM is gone at exit
            return
    del Tables.runs[mark:]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write one table of its own run."""
    return Tables(df.sparkSession, name).write(df, name)


def width(spark: SparkSession) -> int:
    """Number of partitions that shuffles are dealt to in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --- byte kernels -------------------------------------------------------------------

_B1 = 0x9E3779B97F4A7C15
_B1_INV = pow(_B1, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _POW or len(_POW["p"]) < n:
        m = max(n, CHUNK_BYTES + 4096)
        for key, base in (("p", _B1), ("q", _B1_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (np.unique hashes first, which is slower on these)."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, row offsets); nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) in pieces of about ``limit`` bytes, whole rows only."""
    data, offs = flat(batch.column(name))
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters, every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(low: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and each row's first word (n + 1 entries)."""
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[low]
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(low: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**position; a span's hash is (P[end] - P[start]) * base**-start."""
    p, _ = powers(len(low) + 1)
    out = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(low)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive word hashes (len(words) - width + 1 entries)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = (acc + words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)
    return mix(acc)


def crc32_mod(doc_id: str, modulus: int) -> str:
    """SQL text of crc32(id as text) modulo ``modulus``."""
    return f"pmod(crc32(cast(cast({doc_id} as string) as binary)), {modulus})"
