"""Near-duplicate documents from bottom-k sketches of one hash function.

1. One pass over the texts hashes every word shingle and keeps, for each document, the
   number of distinct shingles, a 128-bit key of the whole set, and the ``k`` smallest
   hashes (its sketch).  Texts themselves are not shuffled here.
2. Documents with equal sets form one class; only one row of a class goes on, under a number.
3. Inverted lists of the retained values: two sets as alike as asked share at least
   ``overlap(n)`` sketch values, so they share one of the ``k - overlap + 1`` rarest of
   each.  Only those are listed, which leaves words and passages that stand everywhere out
   of the lists without losing a link.
4. A list's members are linked with at most two of them (stars, never all pairs): the one
   with the smallest id, and the one whose retained values stand in most documents on
   average; both are likely to be the text that the others are edited copies of.  The
   similarity estimated from the union of the two sketches filters, the full sets of the
   survivors decide.
5. Components of the confirmed links.  Where a list still holds several components, its
   members are compared across components by an exact prefix join of their full sets, so
   that links a star misses are found as well; components again.

What 3 and 4 say of sketches holds with probability above 1 - 1e-9 a pair, and always for
sets of at most ``k`` shingles.

Defined results: null, empty and wordless texts have no shingles and no links; fewer words
than a shingle make one shingle of the whole sequence; repeated rows, rows with equal ids and
different texts and rows with null ids are linked one by one, each by its own text.  Only id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm import common as C
from larkspur.llm.components import components

K = 64
RISK = 1e-9
BLOCK = 256


@lru_cache(maxsize=64)
def least_overlap(k: int, percent: int) -> int:
    """Largest s with P(fewer than s of the k smallest of the union are in both sets) below RISK."""
    t, total = percent / 100, 0.0
    for s in range(k + 1):
        total += comb(k, s) * t**s * (1 - t) ** (k - s)
        if total > RISK:
            return s
    return k


def _sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each row."""
    low = C.LOWER[data]
    starts, ends, first = C.word_spans(low, offs, C.NONSPACE)
    words = C.span_hash(C.prefix_hash(low), starts, ends)
    grams = C.shingle_hash(words, width) >> np.uint64(1)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield C.distinct(grams[a : b - width + 1])
        elif b > a:
            yield (C.shingle_hash(words[a:b], b - a) ^ np.uint64(b - a)) >> np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): ``h`` tells rows with equal ids apart by their text."""
    return docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(rows: DataFrame, width: int, k: int = K) -> DataFrame:
    """(id, h, n, key, sketch) of each row; sketch holds the k smallest hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketch = np.zeros(batch.num_rows, np.int64), [], []
            for a, _, data, offs in C.chunks(batch, "text"):
                for i, s in enumerate(_sets(data, offs, width), a):
                    n[i] = len(s)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketch.append(s[:k].view(np.int64))
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            values = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(values))], ["id", "h", "n", "key", "sketch"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, h long, n long, key binary, sketch array<long>")


def _checker(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (a, block), the leader of a block first."""
        leader, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, block, role, b = (batch.column(x).to_pylist() for x in ("a", "block", "role", "b"))
            out: list[tuple] = []
            for first, _, data, offs in C.chunks(batch, "text"):
                for i, s in enumerate(_sets(data, offs, width), first):
                    if role[i] == 0:
                        leader, lead = (a[i], block[i]), s
                    elif leader == (a[i], block[i]):
                        both = len(np.intersect1d(lead, s, assume_unique=True))
                        if 100 * both >= percent * (len(lead) + len(s) - both):
                            out.append((a[i], b[i]))
            kind = batch.column("a").type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([y for _, y in out], kind)], ["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int, t: C.Tables) -> DataFrame:
    """The candidate pairs (a, b) whose full shingle sets are as alike as asked.

    A leader's text is sent once for each block of about BLOCK partners, so a leader with
    very many partners is dealt over many tasks; a partner's text is sent once a pair.
    """
    # both sides of the join are written, so that a leader's pairs can be split
    pairs = t.write(pairs, "candidates")
    crowded = t.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "crowded-leaders")
    pairs = pairs.join(crowded, "a", "left").withColumn("block", F.expr("cast(pmod(xxhash64(b), coalesce(blocks, 1)) as int)"))
    roles = pairs.select("a", "block", F.lit(1).alias("role"), "b", F.col("b").alias("id"))
    roles = roles.union(pairs.select("a", "block").distinct().select("a", "block", F.lit(0), "a", "a"))
    kind = dict(docs.dtypes)["id"]
    dealt = docs.join(roles, "id").select("a", "block", "role", "b", "text").repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return dealt.mapInArrow(_checker(width, percent), f"a {kind}, b {kind}").distinct()


def estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose sizes allow the likeness and whose union sketch does not speak against it."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    top = sized.withColumn("top", F.expr(f"slice(sort_array(array_union(sa, sb)), 1, {k})"))
    both = top.withColumn("both", F.expr("size(array_intersect(top, array_intersect(sa, sb)))"))
    # a union smaller than the sketch is complete, so its likeness is exact
    need = F.expr(f"case when size(top) < {k} then ceil({percent} * size(top) / 100) else {least_overlap(k, percent)} end")
    return both.where(F.col("both") >= need).select("a", "b")


def inverted_lists(reps: DataFrame, percent: int, k: int, t: C.Tables) -> DataFrame:
    """(v, id, n, central): each document under the rarest of its retained values, as many as a link needs.

    ``central`` is the mean number of documents that its retained values stand in.
    """
    least = -(-percent // (100 - percent))  # smaller sets have no link to a different set
    posts = reps.where(F.col("n") >= least).select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    # counts are written before they are joined back: a join of two plain exchanges can be split at a common value
    common = t.write(posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    mine = posts.join(common, "v").groupBy("id", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    take = F.expr(f"m - least({least_overlap(k, percent)}, cast(ceil({percent} * n / 100) as int)) + 1 - (m - size(s))")
    central = F.expr("(m - size(s) + aggregate(s, 0L, (a, x) -> a + x.df)) / m")
    return mine.withColumn("take", take).where("take > 0").select(F.explode(F.expr("slice(s, 1, take).v")).alias("v"), "id", "n", central.alias("central"))


def _repeated(sigs: DataFrame) -> DataFrame:
    """(id, h) of the rows that stand in the table more than once, id and text."""
    return sigs.groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1").select("id", "h")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes (key, none, id, h, n, sketch, node) and components (node, component) of the linked ones."""
    t = C.Tables(docs.sparkSession, "near-duplicates")
    base = _rows(docs, id_col, text_col)
    sigs = t.write(signatures(base, width, k), "signatures")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n", "sketch")).alias("r")
    classes = sigs.where("n > 0").groupBy("key").agg(one).select("key", "r.*")
    # written before anything reads them, so the numbers stay whatever is computed again
    classes = t.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.select(F.col("node").alias("id"), "n", "sketch")
    lists = t.write(inverted_lists(reps, percent, k, t), "lists")

    # the texts of listed documents, read once more and kept apart: all that follows reads only these
    listed = lists.select(F.col("id").alias("node")).distinct().join(classes.select("node", F.col("id").alias("rid"), F.col("h").alias("rh")), "node")
    texts = base.join(listed, F.expr("id <=> rid and h = rh")).select(F.col("node").alias("id"), "text")
    if not _repeated(sigs).isEmpty():  # one of each text that stands there again under its id
        texts = texts.groupBy("id").agg(F.first("text").alias("text"))
    texts = t.write(texts, "listed-texts")
    named = lists.select("v", "id", "central").join(classes.select(F.col("node").alias("id"), F.struct("none", F.col("id").alias("rid"), "h").alias("own")), "id")
    leads = F.array(F.min(F.struct("own", "id"))["id"], F.min(F.struct(-F.col("central"), "own", "id"))["id"]).alias("leads")
    lead = named.groupBy("v").agg(leads, F.count("*").alias("c")).where("c > 1")
    lead = t.write(lead.select("v", F.explode(F.array_distinct("leads")).alias("a")), "leaders")
    pairs = t.write(lists.join(lead, "v").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "star-pairs")
    edges = t.write(confirm(estimated(pairs, reps, percent, k), texts, width, percent, t), "links")
    t.drop("shared-values", "leaders", "star-pairs")
    comps = components(edges, "a", "b")

    more = _across(lists, texts, comps, width, percent, t)
    if not more.isEmpty():
        found = t.write(confirm(estimated(more, reps, percent, k), texts, width, percent, t), "links")
        if not found.isEmpty():
            comps = components(edges.union(found), "a", "b")
    t.drop("lists", "listed-texts", "candidates", "crowded-leaders", "cross-pairs", "links")
    return sigs, classes, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links (null where only null ids are),
    ``kept`` whether it is the row's own.
    """
    sigs, classes, comps = _linked(docs, id_col, text_col, width, percent, k)
    smallest = comps.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("smallest"))
    linked = comps.join(smallest, "component").select("node", "smallest")
    root = classes.select("key", "node", "id").join(linked, "node", "left").select("key", F.coalesce("smallest", "id").alias("root"))
    out = sigs.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(root, "key", "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Values (v) whose rows lie in several components."""
    return rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v")


def _across(lists: DataFrame, texts: DataFrame, comps: DataFrame, width: int, percent: int, t: C.Tables) -> DataFrame:
    """Every pair in different components that could still be a link.

    Only documents of lists with several components take part.  Their full sets are put in
    order from the rarest shingle to the commonest; a link between x and a set y that is
    not larger shares one of the first n - ceil(t n) + 1 shingles of x with the first
    n - ceil(2 t n / (1 + t)) + 1 of y, and the places of the shared shingle bound the
    overlap.  Copies with too many shingles of their own meet nobody, so a large family
    of texts that are nearly but not quite alike enough makes no pairs.
    """
    comp = comps.withColumnRenamed("node", "id")
    held = lists.join(comp, "id", "left").select("v", "id", F.coalesce("component", "id").alias("comp"))
    mixed = t.write(_mixed(held), "mixed-values")
    rest = t.write(held.join(mixed, "v").select("id", "comp").distinct(), "unsettled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in C.chunks(batch, "text"):
                sets = list(_sets(data, offs, width))
                cut = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("comp").slice(a, b - a), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "comp", "s"])

    kind = dict(texts.dtypes)["id"]
    sets = t.write(texts.join(rest, "id").select("id", "comp", "text").mapInArrow(run, f"id {kind}, comp {kind}, s array<long>"), "full-sets")
    posts = sets.select("id", "comp", F.size("s").cast("long").alias("n"), F.explode("s").alias("v"))
    common = t.write(posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    mine = posts.join(common, "v").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    mine = mine.withColumn("own", F.expr("n - size(s)"))  # shingles that nobody else has come first
    mine = mine.withColumn("probe", F.expr(f"cast(n - ceil({percent} * n / 100) + 1 - own as int)")).withColumn("index", F.expr(f"n - ceil({2 * percent} * n / {100 + percent}) + 1 - own"))
    places = mine.where("probe > 0").select("id", "comp", "n", "own", "index", F.posexplode(F.expr("slice(s, 1, probe).v")).alias("pos", "v"))
    places = t.write(places.select("v", "id", "comp", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), (F.col("pos") < F.col("index")).alias("indexed")), "prefixes")
    places = t.write(places.join(t.write(_mixed(places), "mixed-shingles"), "v"), "mixed-prefixes")
    x = places.select("v", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    y = places.where("indexed").select("v", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    fits = f"cx <> cy and (ny < nx or (ny = nx and y < x)) and 100 * ny >= {percent} * nx and {100 + percent} * least(lx, ly) >= {percent} * (nx + ny)"
    pairs = t.write(x.join(y, "v").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cross-pairs")
    t.drop("mixed-values", "unsettled", "full-sets", "shared-shingles", "prefixes", "mixed-shingles", "mixed-prefixes")
    return pairs


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, with one row of each near-duplicate group.

    The row with the smallest id stays (null ids last), of equal ids the one with the smaller
    hash of its text, of rows equal in both any one.  Rows without words are in no group and
    stay.  A row is dropped by its id and its text, so another text under its id is safe.
    """
    sigs, classes, comps = _linked(docs, id_col, text_col, width, percent, K)
    first = F.struct("none", "id", "h")
    best = comps.join(classes.select("node", first.alias("own")), "node").groupBy("component").agg(F.min("own").alias("best"))
    linked = comps.join(best, "component").select("node", "best")
    stays = classes.select("key", "node", first.alias("own")).join(linked, "node", "left").select("key", F.coalesce("best", "own").alias("best"))
    judged = sigs.where("n > 0").join(stays, "key").select("id", "h", F.expr("id <=> best.id and h = best.h").alias("stays"))
    t = C.Tables(docs.sparkSession, "keep-first")
    gone = t.write(judged.where("not stays").select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct(), "gone")
    again = t.write(_repeated(judged.where("stays")).withColumnsRenamed({"id": "_again_id", "h": "_again_h"}), "again")
    h = _text_hash(docs[text_col])
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (h == gone["_gone_h"]), "left_anti")
    if again.isEmpty():
        return out
    same = docs[id_col].eqNullSafe(again["_again_id"]) & (h == again["_again_h"])
    whole = F.struct(*(docs[c] for c in docs.columns))
    once = out.join(again, same, "left_semi").groupBy(docs[id_col], h).agg(F.first(whole).alias("row")).select("row.*")
    return out.join(again, same, "left_anti").unionByName(once)
