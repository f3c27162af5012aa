"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed word and word-stem presence features.  Every training text
that names an identity group gets a counterfactual with the term swapped for another
group, and every training text one with a term put in; the squared change of the score is
added to the loss, so a neutral mention cannot push a score up, whether or not the labelled
texts name groups.  The loss is convex and the steps are searched, so it falls and the weights
stay finite at any strength of the penalty.

Fitting uses at most ``max_rows`` labelled texts of at most ``max_bytes`` together, first by
hash of the id; scoring reads every whole text and sends it through vectorised byte kernels.

Defined results: null and empty texts score the model's intercept; an empty label table
gives score 0 for all; rows with null id are scored and not held out; ids that repeat are
scored row by row; a labelled text that repeats under its id counts once in the fit.  Only the id and the text column are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm import common as C

BITS = 20
STEMS = (4, 5, 7)

#: Identity terms by group; terms of one group are exchanged for each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "transgender", "bisexual", "schwul", "hétéro", "homosexuel"),
    ("immigrants", "refugees", "foreigners", "citizens", "migrants", "ausländer", "flüchtlinge", "étrangers", "extranjeros", "inmigrantes"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
)


@dataclass(frozen=True)
class Model:
    """Sparse weights: feature bucket -> weight, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool
    losses: tuple[float, ...] = ()

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.keys] = self.weights
        return out


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (C.mix(h + np.uint64(kind * 0x51ED27)) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays, one pair for whole words and one for each stem length."""
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.ALNUM)
    if not len(starts):
        return
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    sums = C.prefix_hash(low)
    yield row, _bucket(C.span_hash(sums, starts, ends), 0)
    for k in STEMS:
        long = ends - starts > k
        yield row[long], _bucket(C.span_hash(sums, starts[long], starts[long] + k), k)


def term_buckets(term: str) -> np.ndarray:
    """Feature buckets of a single word."""
    raw = np.frombuffer(term.encode(), np.uint8)
    found = [b for _, b in _features(raw, np.array([0, len(raw)]))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in C.chunks(batch, "text"):
            parts = list(_features(data, offs))
            row = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            bucket = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            key = C.distinct((row << BITS) | bucket)
            cut = np.searchsorted(key, np.arange(len(offs)) << BITS)
            values = pa.array((key & ((1 << BITS) - 1)).astype(np.int32))
            kept = [batch.column(c).slice(a, b - a) for c in ("id", "h", "toxic")]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), values)], ["id", "h", "toxic", "keys"])


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, holdout: int) -> DataFrame:
    """(id, h, toxic, text) of the labelled texts to fit on, each text of an id once."""
    rows = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
        .where(F.expr(C.crc32_mod("id", holdout)) != 0)
        .distinct()
        .orderBy(F.xxhash64("id"), "toxic")
        .limit(max_rows)
    )
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    known = text.join(F.broadcast(rows), "id").groupBy("id", "h", "toxic").agg(F.max(F.octet_length("text")).alias("bytes"))
    order = Window.orderBy(F.xxhash64("id"), "h", "toxic")  # over max_rows numbers, no texts
    first = known.orderBy(F.xxhash64("id"), "h", "toxic").limit(max_rows).withColumn("upto", F.sum(F.coalesce("bytes", F.lit(0))).over(order))
    first = first.where(F.col("upto") <= max_bytes).select("id", "h", "toxic")
    return text.join(F.broadcast(first), ["id", "h"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_bytes: int = 48 << 20, counterfactual: float = 2.0, l1: float = 1.5e-4, epochs: int = 60, holdout: int = 5) -> Model:
    """Fit on at most ``max_rows`` labelled texts, ``max_bytes`` together, whose crc32(id) mod ``holdout`` is not 0.

    The sample is bounded by these parameters, so what reaches the driver is bounded too.
    """
    sample = _sample(docs, labels, max_rows, max_bytes, holdout)
    kind = dict(sample.dtypes)["id"]
    found = sample.mapInArrow(_sample_features, f"id {kind}, h long, toxic int, keys array<int>")
    got = found.dropDuplicates(["id", "h", "toxic"]).select("toxic", "keys").toArrow().combine_chunks()
    if not got.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, False)
    keys = got["keys"].combine_chunks() if isinstance(got["keys"], pa.ChunkedArray) else got["keys"]
    lens = np.diff(keys.offsets.to_numpy())
    return _train(np.repeat(np.arange(len(lens), dtype=np.int32), lens), keys.flatten().to_numpy(), (got["toxic"].to_numpy() > 0).astype(np.float64), counterfactual, l1, epochs)


def _train(row: np.ndarray, key: np.ndarray, y: np.ndarray, counterfactual: float, l1: float, epochs: int) -> Model:
    """Accelerated proximal descent on logistic loss + counterfactual penalty + L1, steps by backtracking."""
    n = len(y)
    df = np.bincount(key, minlength=1 << BITS)
    pos = np.bincount(key, weights=y[row], minlength=1 << BITS)
    base = y.mean()
    # features that follow the label at least a little; the rest only add noise to long texts
    z = (pos - base * df) / np.sqrt(np.maximum(df * base * (1 - base), 1e-9))
    keep = np.flatnonzero((df >= 3) & (df < n) & (np.abs(z) > 2.0))
    at = np.full(1 << BITS, -1, np.int64)
    at[keep] = np.arange(len(keep))
    use = at[key] >= 0
    row, col = row[use], at[key[use]]
    d = len(keep)
    changes = _changes(row, col, at, n) if counterfactual > 0 else []
    curve = np.sqrt(np.maximum(np.bincount(col, minlength=d), 1) / n) / 2
    for out, back, share in changes:  # (sum out - sum back) ** 2 <= size * sum of squares
        curve[np.concatenate([out, back])] += 2 * counterfactual * share * (len(out) + len(back))

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        f = np.bincount(row, weights=w[col], minlength=n) + b
        penalty = sum(share * (w[out].sum() - w[back].sum()) ** 2 for out, back, share in changes)
        return float(np.mean(np.logaddexp(0, f) - y * f) + counterfactual * penalty), f

    w, b, v, vb, tight, momentum = np.zeros(d), float(np.log((base + 1e-6) / (1 - base + 1e-6))), np.zeros(d), 0.0, 1.0, 0
    losses = [loss(w, b)[0]]
    for _ in range(epochs):
        m = momentum / (momentum + 3)
        wl, bl = w + m * v, b + m * vb
        here, f = loss(wl, bl)
        r = (1 / (1 + np.exp(-np.clip(f, -500, 500))) - y) / n
        g, gb = np.bincount(col, weights=r[row], minlength=d), r.sum()
        for out, back, share in changes:
            diff = 2 * counterfactual * share * (wl[out].sum() - wl[back].sum())
            g[out] += diff
            g[back] -= diff
        while True:
            new = wl - g / (curve * tight)
            new = np.sign(new) * np.maximum(np.abs(new) - l1 / (curve * tight), 0)
            nb = bl - gb / (0.5 * tight)
            step, sb = new - wl, nb - bl
            there = loss(new, nb)[0]
            if there <= here + g @ step + gb * sb + tight / 2 * ((curve * step) @ step + 0.5 * sb * sb) + 1e-12:
                break
            tight *= 2
        total = there + l1 * np.abs(new).sum()
        if total > losses[-1] and momentum:  # start the momentum again rather than climb
            v, vb, momentum = np.zeros(d), 0.0, 0
            continue
        v, vb, w, b, momentum = new - w, nb - b, new, nb, momentum + 1
        losses.append(total)
    live = np.abs(w) > 1e-4
    return Model(keep[live], w[live].astype(np.float32), float(b), True, tuple(losses))


def _changes(row: np.ndarray, col: np.ndarray, at: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """What the counterfactuals change: features that leave, features that enter, and for which share of the labelled texts.

    A text that holds an identity term swaps it for the next of its group.  Each text also gets
    one term put in, every term an equal share of the texts.
    """
    out = []
    groups = [[term_buckets(t) for t in g] for g in IDENTITY_GROUPS]
    terms = sum(map(len, groups))
    for group in groups:
        for i, own in enumerate(group):
            mine = at[own][at[own] >= 0]
            if not len(mine):
                continue
            out.append((np.zeros(0, np.int64), mine, 1 / terms))
            theirs = at[group[(i + 1) % len(group)]]
            theirs = theirs[theirs >= 0]
            holders = np.bincount(row[np.isin(col, mine)], minlength=n)
            leave, enter = np.setdiff1d(mine, theirs), np.setdiff1d(theirs, mine)
            if (times := int((holders == len(mine)).sum())) and len(leave) + len(enter):
                out.append((leave, enter, times / n))
    return out


def score(docs: DataFrame, model: Model, holdout: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.bias, model.fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias, fitted = shared.value
        table = Model(keys, weights, bias, fitted).table()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offs in C.chunks(batch, "text"):
                hits = []
                for row, bucket in _features(data, offs):
                    live = table[bucket] != 0
                    hits.append((row[live] << BITS) | bucket[live])
                key = C.distinct(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                out[a:b] = np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=b - a)
            p = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30))) if fitted else out
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(F.expr(C.crc32_mod("doc_id", holdout)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``threshold``, with all their columns; without labels, all rows."""
    model = fit(docs, labels, **params)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.bias, model.fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias, fitted = shared.value
        table = Model(keys, weights, bias, fitted).table()
        cut = np.log(threshold / (1 - threshold)) - bias
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b, data, offs in C.chunks(batch, "text") if fitted else ():
                hits = []
                for row, bucket in _features(data, offs):
                    live = table[bucket] != 0
                    hits.append((row[live] << BITS) | bucket[live])
                key = C.distinct(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                keep[a:b] = np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=b - a) < cut
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
