"""Lexical retrieval: postings, statistics and BM25 over sentence documents.

Everything is keyed by tenant and term.  Query terms meet postings in an equi-join, so the
work is the postings of the query's terms, and no pair without a common term is formed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.text import words
from larkspur.tables import written

K1, B = 1.2, 0.75
#: Scores are added up as whole numbers of this size, so they do not depend on the order of adding.
UNITS = 1_000_000_000


def sentences(chunks: DataFrame) -> DataFrame:
    """(tenant_id, chunk_id, sentence_idx, text): the non-empty lines of each chunk."""
    lines = chunks.select("tenant_id", "chunk_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sentence_idx", "text"))
    return lines.where(F.trim("text") != "").withColumn("sentence_idx", F.col("sentence_idx").cast("bigint"))


def whole(chunks: DataFrame) -> DataFrame:
    """Chunks as documents of one sentence each."""
    return chunks.select("tenant_id", "chunk_id", F.lit(0).cast("bigint").alias("sentence_idx"), "text")


def index(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Postings (tenant_id, chunk_id, sentence_idx, term, tf, dl) of sentence rows with ``text``.

    The shuffle that counts the terms is also what statistics and scoring share: Spark reuses it.
    """
    keyed = docs.select("tenant_id", "chunk_id", "sentence_idx", (words(F.col("text")) if tokens is None else tokens).alias("tokens"))
    terms = keyed.withColumn("dl", F.size("tokens").cast("bigint")).select("tenant_id", "chunk_id", "sentence_idx", "dl", F.explode("tokens").alias("term"))
    return terms.groupBy("tenant_id", "chunk_id", "sentence_idx", "term", "dl").agg(F.count("*").alias("tf")).select("tenant_id", "chunk_id", "sentence_idx", "term", "tf", "dl")


def collection(postings: DataFrame, global_stats: bool = False) -> DataFrame:
    """(tenant_id, n_docs, avgdl), one row for each tenant; with ``global_stats`` all tenants share the whole."""
    docs = postings.select("tenant_id", "chunk_id", "sentence_idx", "dl").distinct()
    if global_stats:
        total = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        return docs.select("tenant_id").distinct().join(F.broadcast(total), F.lit(True))  # one row
    return docs.groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def document_frequency(postings: DataFrame, global_stats: bool = False) -> DataFrame:
    if not global_stats:
        return postings.groupBy("tenant_id", "term").agg(F.count("*").alias("df"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return postings.select("tenant_id", "term").distinct().join(df, "term")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).distinct()


def _units(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """A posting's share of a BM25 score, in whole units."""
    return F.round(idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) * UNITS).cast("bigint")


def bm25(postings: DataFrame, terms: DataFrame, global_stats: bool = False) -> DataFrame:
    """(query_id, tenant_id, chunk_id, sentence_idx, score) of every sentence with a term of the query."""
    hits = weighted(postings.join(terms.select("term").distinct(), "term", "left_semi"), global_stats, postings).join(terms, "term")
    return hits.groupBy("query_id", "tenant_id", "chunk_id", "sentence_idx").agg((F.sum("w") / UNITS).alias("score"))


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), tie: tuple[str, ...] = ("chunk_id", "sentence_idx")) -> DataFrame:
    """The ``k`` best rows of each group with ``rank`` from 1; ties in order of ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


MAX_QUERY_TERMS = 1 << 21


def _blocks(queries: DataFrame, cells: int) -> Iterator[tuple[list, dict[str, int], list[np.ndarray]]]:
    """Queries in blocks whose (terms x queries) stay below ``cells``: ids, term numbers, each query's term numbers."""
    ids, vocab, rows = [], {}, []
    for r in queries.select("query_id", F.array_sort(F.array_distinct(words(F.col("query")))).alias("t")).orderBy("query_id").toLocalIterator():
        if ids and (len(vocab) + len(r.t)) * (len(ids) + 1) > cells:
            yield ids, vocab, rows
            ids, vocab, rows = [], {}, []
        ids.append(r.query_id)
        rows.append(np.array([vocab.setdefault(t, len(vocab)) for t in r.t], np.int64))
    if ids:
        yield ids, vocab, rows


def _asked(rows: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the queries of each term begin, the queries term by term, and how many queries there are."""
    term, query = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.searchsorted(np.sort(term), np.arange(n_terms + 1)), query[np.argsort(term, kind="stable")], len(rows)


class _Kept:
    """The ``k`` best rows of each query and tenant that a task has seen: score, then tie columns.

    Candidates gather in columns and are cut to ``k`` a group whenever they have doubled, so no row is handled alone.
    """

    LEAST = 1 << 17

    def __init__(self, k: int, ids: list, tie: tuple[str, ...]):
        self.k, self.ids, self.tie = k, ids, tie
        self.parts: list[pa.Table] = []
        self.n, self.most = 0, self.LEAST
        self.names: dict[str, int] = {}
        self.floor = np.zeros((0, len(ids)))  # by tenant and query: the k-th best score so far

    def tenants(self, names: list[str]) -> np.ndarray:
        found = np.array([self.names.setdefault(t, len(self.names)) for t in names], np.int64)
        self.floor = np.vstack([self.floor, np.zeros((len(self.names) - len(self.floor), len(self.ids)))])
        return found

    def add(self, score: np.ndarray, tenant: np.ndarray, keys: list[pa.Array], a: int, held: np.ndarray | None = None) -> None:
        """Scores (rows x queries) of the rows from ``a`` on; ``tenant`` has their numbers, ``keys`` the tie columns of all rows, ``held`` what counts (else: scores above 0)."""
        at, q = np.nonzero((score > 0 if held is None else held) & (score >= self.floor[tenant]))
        if not len(at):
            return
        pick = pa.array(at + a)
        self.parts.append(pa.table([pa.array(tenant[at] * len(self.ids) + q), pa.array(score[at, q]), *(c.take(pick) for c in keys)], ["_group", "_score", *self.tie]))
        self.n += len(at)
        if self.n > self.most:
            self._cut()

    def _cut(self) -> None:
        found = pa.concat_tables(self.parts)
        group, score = found["_group"].to_numpy(), found["_score"].to_numpy()
        order = np.lexsort((-score, group))
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        full = sizes >= self.k
        floor = np.zeros(len(starts))
        floor[full] = score[order[starts[full] + self.k - 1]]
        self.floor.reshape(-1)[group[order[starts[full]]]] = floor[full]
        good = order[score[order] >= np.repeat(floor, sizes)]  # ties of the k-th stay
        found = found.take(pa.array(good))
        sizes = np.unique(group[good], return_counts=True)[1]
        if sizes.max() > self.k:
            keys = [("_group", "ascending"), ("_score", "descending"), *((c, "ascending") for c in self.tie)]
            rank = np.arange(len(good)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_start").filter(pa.array(rank < self.k)))
        self.parts, self.n = [found.combine_chunks()], found.num_rows
        self.most = max(self.LEAST, 2 * self.n)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._cut()
        found, n = self.parts[0], len(self.ids)
        group = found["_group"].to_numpy()
        query, tenant = pa.array(self.ids, pa.int64()).take(pa.array(group % n)), pa.array(list(self.names), pa.string()).take(pa.array(group // n))
        yield from pa.table([query, tenant, pa.array(found["_score"].to_numpy() / UNITS), *(found[c] for c in self.tie)], ["query_id", "tenant_id", "score", *self.tie]).to_batches()


def _best(k: int, shared, tie: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task keeps ``k`` rows of each query and tenant, whatever it reads."""
        ids, asked = shared.value
        kept = _Kept(k, ids, tie)
        for batch in batches:
            parts = batch.column("parts")
            if not len(parts):
                continue
            flat = parts.flatten()
            offs = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            term, weight = flat.field("t").to_numpy(), flat.field("w").to_numpy().astype(np.float64)
            tenant, keys = kept.tenants(batch.column("tenant_id").to_pylist()), [batch.column(c) for c in tie]
            for a, b in _pieces(offs, len(ids)):
                kept.add(_sums(asked, term, weight, offs[a : b + 1]), tenant[a:b], keys, a)
        yield from kept.rows()

    return run


#: Products of a weight and a query's place that a task holds at once.
CELLS = 1 << 21


def _pieces(offs: np.ndarray, width: int, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``CELLS`` products (or one row) and ``rows`` rows."""
    a, n, most = 0, len(offs) - 1, max(1, CELLS // max(1, width))
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1))
        yield a, b
        a = b


def _sums(asked: tuple[np.ndarray, np.ndarray, int], term: np.ndarray, weight: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x queries: the weights of each row's terms added up by query; a term meets only the queries that have it."""
    begin, query, width = asked
    lo, hi, n = int(offs[0]), int(offs[-1]), len(offs) - 1
    first = begin[term[lo:hi]]
    count = begin[term[lo:hi] + 1] - first
    ends = np.cumsum(count)
    at = np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
    cell = np.repeat(np.repeat(np.arange(n) * width, np.diff(offs)), count) + query[at]
    # whole numbers below 2**53: exact in any order
    return np.bincount(cell, np.repeat(weight[lo:hi], count), n * width).reshape(n, width)


def _top_of(weighted: DataFrame, queries: DataFrame, k: int, tie: tuple[str, ...]) -> DataFrame:
    """The ``k`` best rows of each query and tenant of (tenant_id, tie…, term, w): score = sum of w (in units) over the query's terms.

    A block of queries goes to every task as the queries of each term; a task adds up its rows,
    so the work between machines is one row a sentence and k rows a query, tenant and task, not
    one a query and sentence.
    """
    spark = weighted.sparkSession
    ddl = f"query_id bigint, tenant_id string, score double, {', '.join(f'{c} {t}' for c, t in weighted.dtypes if c in tie)}"
    out = None
    for ids, vocab, rows in _blocks(queries, MAX_QUERY_TERMS):
        shared = spark.sparkContext.broadcast((ids, _asked(rows, max(1, len(vocab)))))
        numbered = spark.createDataFrame(list(vocab.items()) or [("", 0)], "term string, t int")
        docs = weighted.join(F.broadcast(numbered), "term").groupBy("tenant_id", *tie).agg(F.collect_list(F.struct("t", "w")).alias("parts"))
        part = docs.mapInArrow(_best(k, shared, tuple(c for c, _ in weighted.dtypes if c in tie)), ddl)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], ddl)
    w = Window.partitionBy("query_id", "tenant_id").orderBy(F.desc("score"), *tie)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Terms of a row with their counts or places, ``term number * 2**32 + count`` each.
_COUNTED = "tenant_id string, chunk_id string, sentence_idx bigint, dl bigint, parts array<bigint>"
#: Tokens that a task numbers at once, and weights (tenants x terms) that go to every task.
TOKENS, WEIGHTS = 1 << 19, 1 << 23
#: Bytes of text that a task cuts into words at once.
TEXT_BYTES = 1 << 20


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Small letters and digits by byte (else 0; bytes of two-byte characters stand for themselves), and the two bytes of U+0080 to U+00FF."""
    one = np.arange(256, dtype=np.uint8)
    one[:128] = [ord(c.lower()) if c.isascii() and c.isalnum() else 0 for c in map(chr, range(128))]
    two = [c.lower() if unicodedata.category(c)[0] in "LN" else "\0\0" for c in map(chr, range(128, 256))]
    return one, np.frombuffer("".join(two).encode(), np.uint8).reshape(128, 2)


_BYTE, _PAIR = _letters()
#: A character beyond U+00FF; texts without one are cut into words by bytes, the others by ``words``.
_WIDE = r"[^\x00-\xFF]"


def _words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The ``words`` of texts of characters up to U+00FF, and where those of each text begin and end."""
    offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    low = _BYTE[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        pair = _PAIR[((raw[lead] & 1) << 6) | (raw[lead + 1] & 0x3F)]
        low[lead], low[lead + 1] = pair[:, 0], pair[:, 1]
    inside = low != 0
    edge = np.zeros(len(low) + 1, bool)  # a text begins here
    edge[offs] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[inside])), np.searchsorted(starts, offs)


def _numbered(found: pa.Array, offs: np.ndarray, terms: pa.Array, places: bool) -> tuple[np.ndarray, pa.ListArray]:
    """Numbers of words and ``parts`` of rows whose words are ``found``, from place to place of ``offs``."""
    lengths, size = np.diff(offs), max(1, len(terms))
    t = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(t >= 0)
    row, t = np.repeat(np.arange(len(lengths)), lengths)[at], t[at].astype(np.int64)
    if places:
        ends, code = np.searchsorted(at, offs), (t << 32) + at - offs[row]
    else:
        code, tf = np.unique(row * size + t, return_counts=True)
        ends, code = np.searchsorted(code, np.arange(len(offs)) * size), (code % size << 32) + tf
    return lengths, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code))


def _counted(docs: DataFrame, vocab: dict[str, int], places: bool = False) -> DataFrame:
    """(tenant_id, chunk_id, sentence_idx, dl, parts) of every sentence with words: the counts of the terms of ``vocab`` in it.

    With ``places`` parts hold the place of each occurrence (from 0) instead of the count, in the order of the sentence.
    Words go to Python only where a text has characters beyond U+00FF; other texts go as they are and are cut there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(vocab))
    names = ["tenant_id", "chunk_id", "sentence_idx", "dl", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.string())
        for whole in batches:
            plain = whole.column("tokens").is_null()
            for rows, cut in ((whole.filter(plain), True), (whole.filter(pc.invert(plain)), False)):
                if not rows.num_rows:
                    continue
                every = pc.binary_length(rows.column("text")) if cut else pc.list_value_length(rows.column("tokens"))
                every = np.append(0, np.cumsum(every.to_numpy(zero_copy_only=False).astype(np.int64)))
                for a, b in _pieces(every, max(1, CELLS // (TEXT_BYTES if cut else TOKENS)), rows.num_rows):
                    batch = rows.slice(a, b - a)
                    found, offs = _words_of(batch.column("text")) if cut else (batch.column("tokens").flatten(), every[a : b + 1] - every[a])
                    lengths, parts = _numbered(found, offs, terms, places)
                    out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths.astype(np.int64)), parts], names)
                    yield out.filter(pa.array(lengths > 0))

    text = F.coalesce("text", F.lit(""))
    rows = docs.where("tenant_id is not null").select("tenant_id", "chunk_id", F.col("sentence_idx").cast("bigint").alias("sentence_idx"), text.alias("text"), text.rlike(_WIDE).alias("wide"))
    sent = rows.select("tenant_id", "chunk_id", "sentence_idx", F.when(~F.col("wide"), F.col("text")).alias("text"), F.when(F.col("wide"), words(F.col("text"))).alias("tokens"))
    return sent.mapInArrow(run, _COUNTED)


def counted_weights(batch: pa.RecordBatch, place: dict[str, int], idf: np.ndarray, avgdl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights (in units) of rows of counted terms, and where each row begins."""
    parts = batch.column("parts")
    packed, offs = parts.flatten().to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    row = np.repeat(np.arange(len(parts)), np.diff(offs))
    own, dl = np.array([place[t] for t in batch.column("tenant_id").to_pylist()], np.int64)[row], batch.column("dl").to_numpy()[row]
    term, tf = packed >> 32, (packed & 0xFFFFFFFF).astype(np.float64)
    # the operations of ``_units`` in their order
    return term, np.floor(idf[own, term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl[own])) * UNITS + 0.5), offs


def _best_counted(k: int, shared, tie: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As ``_best`` for rows of counted terms, with the statistics at hand."""
        ids, asked, place, idf, avgdl = shared.value
        kept = _Kept(k, ids, tie)
        for batch in batches:
            parts = batch.column("parts")
            if not len(parts):
                continue
            packed, offs = parts.flatten().to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            names, dl = batch.column("tenant_id").to_pylist(), batch.column("dl").to_numpy()
            own, tenant, keys = np.array([place[t] for t in names], np.int64), kept.tenants(names), [batch.column(c) for c in tie]
            for a, b in _pieces(offs, len(ids)):
                lo, hi = offs[a], offs[b]
                row = np.repeat(np.arange(a, b), np.diff(offs[a : b + 1]))
                term, tf = packed[lo:hi] >> 32, (packed[lo:hi] & 0xFFFFFFFF).astype(np.float64)
                # the operations of ``_units`` in their order
                w = np.floor(idf[own[row], term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl[own[row]])) * UNITS + 0.5)
                kept.add(_sums(asked, term, w, offs[a : b + 1] - lo), tenant[a:b], keys, a)
        yield from kept.rows()

    return run


def _rows_with_terms(place: dict[str, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tenant_id, t, n): rows of a task that have the term, at most ``WEIGHTS`` counts."""
        total = np.zeros(len(place) * size, np.int64)
        for batch in batches:
            parts = batch.column("parts")
            row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
            once = row * size + (parts.flatten().to_numpy() >> 32)
            if (np.diff(once) <= 0).any():  # a term with several places counts once
                once = np.unique(once)
            own = np.array([place[t] for t in batch.column("tenant_id").to_pylist()], np.int64)
            total += np.bincount(own[once // size] * size + once % size, minlength=len(total))
        cell = np.flatnonzero(total)
        yield from pa.table([pa.array(list(place), pa.string()).take(pa.array(cell // size)), pa.array((cell % size).astype(np.int32)), pa.array(total[cell])], ["tenant_id", "t", "n"]).to_batches()

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tenant_id, chunk_id, low, high): rows of a chunk that stand together with ascending sentences are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, goes_on = batch.column("sentence_idx").to_numpy(), np.ones(batch.num_rows - 1, bool)
        for key in batch.columns[:2]:
            goes_on &= pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
        low = np.flatnonzero(np.append(True, ~(goes_on & (at[1:] > at[:-1]))))
        high = np.append(low[1:], batch.num_rows) - 1
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(low)) for c in batch.columns[:2]), pa.array(at[low]), pa.array(at[high])], ["tenant_id", "chunk_id", "low", "high"])


def meeting(counted: DataFrame) -> bool:
    """May sentence rows repeat: do stretches of rows of a chunk meet?  Never false where a row is there twice."""
    rows = counted.select("tenant_id", "chunk_id", F.coalesce("sentence_idx", F.lit(-1)).alias("sentence_idx"))
    found = rows.mapInArrow(_stretches, "tenant_id string, chunk_id string, low bigint, high bigint")
    before = F.max("high").over(Window.partitionBy("tenant_id", "chunk_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    return not found.withColumn("before", before).where("low <= before").isEmpty()


def statistics_of(counted: DataFrame, n_terms: int) -> tuple[dict[str, int], np.ndarray, np.ndarray] | None:
    """Tenants' numbers, idf (tenants x terms) and mean lengths of counted rows; None where sentence rows repeat or the weights are more than ``WEIGHTS``."""
    whole = counted.groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tenants = whole.limit(WEIGHTS // max(1, n_terms) + 1).collect()
    again = counted.groupBy("tenant_id", "chunk_id", "sentence_idx").agg(F.count("*").alias("n")).where("n > 1")
    if len(tenants) * n_terms > WEIGHTS or (meeting(counted) and not again.isEmpty()):
        return None
    place = {r.tenant_id: i for i, r in enumerate(tenants)}
    part = counted.select("tenant_id", "parts").mapInArrow(_rows_with_terms(place, max(1, n_terms)), "tenant_id string, t int, n bigint")
    df = part.groupBy("tenant_id", "t").agg(F.sum("n").alias("df"))
    weights = np.zeros((len(tenants), max(1, n_terms)))
    for r in df.join(F.broadcast(whole), "tenant_id").select("tenant_id", "t", idf(F.col("n_docs"), F.col("df")).alias("idf")).toLocalIterator():
        weights[place[r.tenant_id], r.t] = r.idf
    return place, weights, np.array([r.avgdl for r in tenants])


def bm25_top_of(docs: DataFrame, queries: DataFrame, k: int, pool: DataFrame | None = None) -> DataFrame:
    """``bm25_top(index(docs), queries, k)`` of sentence rows with ``text``, without postings of words that no query has.

    The words of a block of queries are numbered and sent to every task.  A task counts them in
    its sentences, which stay where they are and are written once, a row each; statistics are
    groupings of these rows by tenant and term, and a second pass scores.  Only the chunks of
    ``pool`` (tenant_id, chunk_id) are shown where it is given; statistics are of all.

    Repeated sentence rows (their counts add up), and more than ``WEIGHTS`` tenants times terms,
    take the postings instead, with the same results.
    """
    spark, tie = docs.sparkSession, ("chunk_id", "sentence_idx")
    ddl = "query_id bigint, tenant_id string, score double, chunk_id string, sentence_idx bigint"
    out = None
    for ids, vocab, rows in _blocks(queries, MAX_QUERY_TERMS):
        counted = written(_counted(docs, vocab), "counted")
        stats = statistics_of(counted, len(vocab))
        if stats is None:
            hits = weighted(index(docs))
            return top_weighted(hits if pool is None else hits.join(pool.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi"), queries, k)
        shared = spark.sparkContext.broadcast((ids, _asked(rows, max(1, len(vocab))), *stats))
        shown = counted.where(F.size("parts") > 0)
        if pool is not None:
            shown = shown.join(pool.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi")
        part = shown.mapInArrow(_best_counted(k, shared, tie), ddl)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], ddl)
    w = Window.partitionBy("query_id", "tenant_id").orderBy(F.desc("score"), *tie)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted(postings: DataFrame, global_stats: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """(tenant_id, chunk_id, sentence_idx, term, w): each posting's units of a BM25 score, by the statistics of ``whole`` (the postings themselves)."""
    whole = postings if whole is None else whole
    hits = postings.join(document_frequency(whole, global_stats), ["tenant_id", "term"]).join(collection(whole, global_stats), "tenant_id")
    w = _units(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.select("tenant_id", "chunk_id", "sentence_idx", "term", w.alias("w"))


def bm25_top(postings: DataFrame, queries: DataFrame, k: int, global_stats: bool = False) -> DataFrame:
    """``top(bm25(…), k)`` of each query and tenant for many queries (bigint ``query_id``) in one pass over the postings."""
    return top_weighted(weighted(postings, global_stats), queries, k)


def top_weighted(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best sentences of each query and tenant from weighted postings."""
    return _top_of(hits, queries, k, ("chunk_id", "sentence_idx"))


def delete(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Postings without those of tombstoned (tenant_id, chunk_id)."""
    return postings.join(tombstones.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_anti")


def substring(chunks: DataFrame, needle: str) -> DataFrame:
    """Chunks whose text contains ``needle`` whatever the case, score 1; the empty needle is in all."""
    return chunks.where(F.contains(F.lower("text"), F.lit(needle.lower()))).withColumn("score", F.lit(1.0))
