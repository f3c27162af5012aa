"""Hard negatives by exact search over k-means inverted lists.

An anchor's positives are the rows of its label with the highest scores; its hard negatives
are the best rows of other labels whose score lies in a window below a positive's.  Both are
exact top-k searches:

* Centroids are fitted on a bounded sample; every row then goes to the list of its nearest
  centroid, and each list stores its radius, the largest distance of a member to the centroid.
* By Cauchy-Schwarz no member of a list scores more than <q, c> + |q| * radius, or less than
  <q, c> - |q| * radius.  An anchor visits lists in descending order of the upper bound, in
  waves that grow geometrically.  Lists outside the anchor's window are skipped, and it stops
  at the first list whose bound falls strictly below the k-th score it holds.
* A list of many rows (a common vector) is stored as blocks of about ``BLOCK`` rows, dealt by
  the hash of the row, so no task holds more than a block.  Anchors stream past the blocks.

Only the centroids, radii and block counts are sent to every task (at most ``MAX_LISTS``
rows).  Bounds have a slack for rounding; scores themselves are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm import common as C

#: Rows of the sample that the centroids are fitted on.
SAMPLE = 4096
MAX_LISTS = 1024
BLOCK = 4096
FIRST_WAVE, WAVE_FACTOR = 8, 8
#: Cells of one product of anchors and rows.
CELLS = 1 << 21
#: Scores beyond this, either way, count as this.
MOST = 1 << 62


# --- vectors as whole numbers ---------------------------------------------------------


def whole(col: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles; shorter vectors end in zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return np.floor(scale * flat).reshape(len(col), dim)
    out = np.zeros((len(col), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(scale * flat)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, exact, as 64-bit numbers no further from 0 than ``MOST``."""
    most_a, most_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    room = 2.0**52 / max(1, a.shape[1])
    if most_a.max(initial=0) * most_b.max(initial=0) < room:
        return (a @ b.T).astype(np.int64)
    fits = most_a[:, None] * most_b[None, :] < room
    out = np.zeros(fits.shape, np.int64)
    for i in range(len(a)):
        out[i, fits[i]] = (b[fits[i]] @ a[i]).astype(np.int64)
        if not fits[i].all():  # beyond what doubles add up exactly
            q = [int(x) for x in a[i]]
            for j in np.flatnonzero(~fits[i]):
                out[i, j] = max(-MOST, min(MOST, sum(x * int(y) for x, y in zip(q, b[j], strict=True))))
    return out


def kmeans(m: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of the rows of ``m`` by Lloyd's rounds; at most ``lists``."""
    m = np.unique(m, axis=0)
    if not len(m):
        return np.zeros((1, m.shape[1]))
    centre = m[np.sort(np.random.default_rng(seed).choice(len(m), min(lists, len(m)), replace=False))]
    for _ in range(rounds):
        of = nearest(m, centre)[0]
        sums, n = np.zeros_like(centre), np.bincount(of, minlength=len(centre))
        np.add.at(sums, of, m)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and the distance to it."""
    with np.errstate(all="ignore"):
        of = ((centre * centre).sum(axis=1) - 2 * (m @ centre.T)).argmin(axis=1)
        return of, np.sqrt(((m - centre[of]) ** 2).sum(axis=1))


# --- the index ------------------------------------------------------------------------


class Lists:
    """Inverted lists of the rows (row, id, label, embedding, anchor) in a table of their own.

    ``table`` has the rows with their ``block``; ``centre``, ``radius``, ``first`` (number of a
    list's first block) and ``blocks`` (how many it has) describe the lists.
    """

    def __init__(self, rows: DataFrame, run: C.Tables, scale: int, max_lists: int = MAX_LISTS, block: int = BLOCK):
        self.run, self.scale = run, scale
        rows = run.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        n, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
        self.n, self.dim = n, max(1, dim or 1)
        picked = rows.orderBy(F.xxhash64("id", "embedding"), "row").limit(SAMPLE).select("embedding").toArrow()
        sample = whole(picked.column("embedding"), self.dim, scale) if picked.num_rows else np.zeros((0, self.dim))
        self.centre = kmeans(sample, min(max_lists, max(1, round(n**0.5))))
        self.table = run.write(rows.mapInArrow(self._assign(), rows.schema.simpleString()[7:-1] + ",list:int,distance:double"), "assigned")
        found = {r["list"]: (r["n"], r["far"]) for r in self.table.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
        k = len(self.centre)
        far = np.array([found.get(i, (0, 0.0))[1] for i in range(k)])
        self.radius = np.where(np.isfinite(far), far * (1 + 1e-9) + 1e-6, np.inf)
        self.blocks = np.array([-(-found.get(i, (0, 0.0))[0] // block) for i in range(k)], np.int64)
        self.first = np.cumsum(self.blocks) - self.blocks
        run.drop("rows")
        deal = self.run.spark.createDataFrame([(i, int(self.first[i]), max(1, int(self.blocks[i]))) for i in range(k)], "list int, first bigint, blocks bigint")
        self.table = self.table.join(F.broadcast(deal), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks")))

    def _assign(self):
        centre, dim, scale = self.centre, self.dim, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, distance = nearest(whole(batch.column("embedding"), dim, scale), centre)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(distance, pa.float64())], [*batch.schema.names, "list", "distance"])

        return run

    def visits(self, probes: DataFrame, begin: int, end: int) -> DataFrame:
        """The blocks that each probe (row, label, embedding, lo, hi) visits in a wave: the lists at places ``begin`` to ``end`` of its order."""
        centre, radius, first, blocks, dim, scale = self.centre, self.radius, self.first, self.blocks, self.dim, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = whole(batch.column("embedding"), dim, scale)
                with np.errstate(all="ignore"):
                    middle, reach = q @ centre.T, np.linalg.norm(q, axis=1)[:, None] * radius
                    upper, lower = (x + s * (1e-6 * np.abs(x) + 1) for x, s in ((middle + reach, 1), (middle - reach, -1)))
                upper, lower = np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)
                least = np.array([min(x) for x in batch.column("lo").to_pylist()], np.float64)
                most = np.array([max(x) for x in batch.column("hi").to_pylist()], np.float64)
                place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
                wanted = (place >= begin) & (place < end) & (upper >= least[:, None]) & (lower <= most[:, None]) & (blocks > 0)
                who, of = np.nonzero(wanted)
                n = blocks[of]
                block = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = np.repeat(who, n)
                for a in range(0, len(who), 4096):
                    part = batch.take(pa.array(who[a : a + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 4096], pa.int64()), *part.columns], ["block", *part.schema.names])

        return probes.mapInArrow(run, "block bigint," + probes.schema.simpleString()[7:-1])


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first of each group, by descending score, then place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=-1))
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[nth < k]


def _scan(dim: int, scale: int, k: int, same: bool, id_type: pa.DataType):
    """Stream (block, probe?, …) rows sorted by block with the list's rows first; keep ``k`` a probe, window and block."""
    names = ["row", "window", "score", "id"]

    def against(rows: dict, probes: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = whole(probes.column("embedding"), dim, scale)
        label, own = probes.column("label").to_numpy(), probes.column("row").to_numpy()
        windows = len(probes.column("lo")[0])
        lo = np.array(probes.column("lo").to_pylist(), np.int64)
        hi = np.array(probes.column("hi").to_pylist(), np.int64)
        step = max(1, CELLS // max(1, len(rows["row"])))
        for a in range(0, len(q), step):
            part = slice(a, a + step)
            score = products(q[part], rows["m"])
            fits = (label[part, None] == rows["label"]) & (own[part, None] != rows["row"]) if same else label[part, None] != rows["label"]
            fits &= (score >= lo[part].min(axis=1)[:, None]) & (score <= hi[part].max(axis=1)[:, None])
            who, at = np.nonzero(fits)
            s = score[who, at]
            for w in range(windows):
                inside = np.flatnonzero((s >= lo[part][who, w]) & (s <= hi[part][who, w]))
                if len(inside):
                    keep = inside[_first(who[inside], s[inside], at[inside], k)]
                    cols = [pa.array(own[part][who[keep]], pa.int64()), pa.array(np.full(len(keep), w), pa.int32()), pa.array(s[keep], pa.int64()), rows["id"].take(pa.array(at[keep]))]
                    yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, rows = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, probe = batch.column("block").to_numpy(), batch.column("probe").to_numpy()
            cuts = np.flatnonzero((np.diff(at, prepend=at[0] - 1) != 0) | (np.diff(probe, prepend=-1) != 0))
            for x, y in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                part = batch.slice(x, y - x)
                if at[x] != block:
                    held, block, rows = [], at[x], None
                if not probe[x]:
                    held.append(part)
                elif held:
                    if rows is None:
                        t = pa.Table.from_batches(held).select(["row", "id", "label", "embedding"])
                        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
                        rows = {"row": t["row"].to_numpy(), "label": t["label"].to_numpy(), "id": t["id"].combine_chunks().cast(id_type), "m": whole(t["embedding"], dim, scale)}
                    yield from against(rows, part)

    return run


def search(lists: Lists, probes: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """(row, window, score, id, rank): the ``k`` first rows of each probe and window.

    ``probes`` are rows (row, label, embedding, lo, hi) with equally many windows ``lo[w] <=
    score <= hi[w]``; ``same`` looks among the other rows of the probe's label, else among
    rows of other labels.  Higher scores come first, ties by smaller id, null ids last.
    """
    run, kinds = lists.run, dict(lists.table.dtypes)
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    from pyspark.sql.pandas.types import to_arrow_type

    scan = _scan(lists.dim, lists.scale, k, same, to_arrow_type(lists.table.schema["id"].dataType))
    own = lists.table.select("block", F.lit(0).alias("probe"), "row", "label", "embedding", "id", F.lit(None).cast("array<bigint>").alias("lo"), F.lit(None).cast("array<bigint>").alias("hi"))
    found, open_, begin, end = None, probes, 0, FIRST_WAVE
    while True:
        went = lists.visits(open_, begin, end).select("block", F.lit(1).alias("probe"), "row", "label", "embedding", F.lit(None).cast(kinds["id"]).alias("id"), "lo", "hi")
        dealt = own.unionByName(went).repartition(C.width(run.spark), "block").sortWithinPartitions("block", "probe")
        hits = dealt.mapInArrow(scan, f"row bigint, window int, score bigint, id {kinds['id']}")
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        found = run.write(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)
        run.drop(name, keep=1)
        if end >= len(lists.centre):
            return found
        begin, end = end, end * WAVE_FACTOR
        kth = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        floor = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.col("kth")[w], x)))
        open_ = probes.join(kth, "row", "left").withColumn("lo", floor).drop("kth")


# --- hard negatives -------------------------------------------------------------------


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows with a label, a vector, and only components whose ``scale``-fold is a finite double."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", max_lists: int = MAX_LISTS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    ``vectors`` has ``id_col``, ``label`` and ``embedding``; other columns are ignored, so no
    name clashes.  A score is the inner product of vectors whose components became
    floor(scale * x).  For each anchor and each of its first ``positives`` other rows of its
    label, the first ``negatives`` rows of other labels with low * positive <= 100 * negative
    <= high * positive, in percent.

    Null labels, null vectors and vectors with a null or non-finite component take no part.  Null ids are no
    anchors, come last among ties and stay null in the result.  Repeated rows are rows of
    their own.  Missing components of shorter vectors, empty ones included, count as 0.
    Scores beyond 2**62 count as 2**62.  An empty table, or one without anchors, gives no rows.
    """
    run = C.Tables(vectors.sparkSession, "negatives")
    rows = usable(vectors, scale).select(F.col(id_col).alias("id"), F.col("label").cast("bigint").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    lists = Lists(rows, run, scale, max_lists, block)
    probes = lists.table.where("anchor").select("row", "label", "embedding", F.array(F.lit(-MOST)).alias("lo"), F.array(F.lit(MOST)).alias("hi"))
    near = search(lists, probes, positives, True, "positives")

    hundreds, rest = "((score - pmod(score, 100L)) div 100)", "pmod(score, 100L)"
    window = near.withColumn("lo", F.expr(f"{low} * {hundreds} + ({low} * {rest} + 99) div 100")).withColumn("hi", F.expr(f"{high} * {hundreds} + ({high} * {rest}) div 100"))
    by_rank = window.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))  # at most ``positives`` entries
    inner = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("w", i))
    of_rank = probes.drop("lo", "hi").join(by_rank, "row").withColumn("w", inner)
    windows = of_rank.withColumn("lo", F.transform("w", lambda x: F.coalesce(x["lo"], F.lit(MOST)))).withColumn("hi", F.transform("w", lambda x: F.coalesce(x["hi"], F.lit(-MOST)))).drop("w")
    far = search(lists, windows, negatives, False, "negatives")

    named = lists.table.where("anchor").select("row", F.col("id").alias("anchor_id")).join(near.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")), "row")
    out = named.join(far.select("row", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
