"""Steps whose cost must not grow faster than their input, and results that no bound may cut."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from larkspur.functions import vectors as V
from larkspur.operators import dense, evaluate as E, ingest, lexquery as L, ranking, sparse, structural as C, tiered as T
from larkspur.plans import retrieval as R
from larkspur.sources import bindings as S


def test_calls_meet_only_symbols_near_their_line(spark, capsys):
    rng = random.Random(4)
    sym = []
    for i in range(400):
        start = rng.randrange(-5, 300)
        sym.append((i, f"f{i % 3}.py", start, start + rng.choice([-1, 0, 1, 2, 7, 8, 15, 16, 200])))
    calls = [(f"f{rng.randrange(4)}.py", rng.randrange(-8, 520), rng.choice("ab")) for _ in range(500)]
    want = set()
    for file, line, callee in calls:
        inside = [(b - a, i) for i, f, a, b in sym if f == file and a <= line <= b]
        if inside:
            want.add((file, line, callee, min(inside)[1]))
    s = spark.createDataFrame(sym, "symbol_id int, file string, line_start int, line_end int")
    found = C.attribute_calls(spark.createDataFrame(calls, "call_file string, call_line int, callee_name string"), s)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    capsys.readouterr()
    found.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "call_file" in x]
    assert joins and all("block" in x or "call_line" in x.split("Inner")[0] for x in joins), joins  # none by the file alone


def test_cache_keeps_every_live_entry(spark):
    none = spark.createDataFrame([], "entry_id string, tenant_id string, project_id string, query_embedding array<float>, created_at bigint")
    new = spark.range(10_050).select(F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("project_id"), F.array(F.col("id").cast("float")).alias("query_embedding"), F.lit(1000).cast("bigint").alias("created_at"))
    assert T.cache_insert(none, new, 1000).count() == 10_050
    assert T.cache_insert(none, new, 1000, capacity=T.CAPACITY).count() == T.CAPACITY


def test_relevance_by_class_equals_pairs(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none"), (4, "a")], "query_id int, class string")
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)] + [(0, "a")], "doc_id int, class string")
    results = spark.createDataFrame([(q, d, r) for q in (1, 2, 3) for r, d in enumerate((1, 0, 3, 2, 5), 1)], "query_id int, doc_id int, rank int")
    pairs = queries.join(docs, "class").select("query_id", "doc_id")
    for k in (1, 3):
        got, want = (sorted(map(tuple, x.collect())) for x in (E.per_query_by_class(queries, docs, results, k), E.per_query(queries, pairs, results, k)))
        assert got == want


def test_cosine_of_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "PAIRS", 7)
    monkeypatch.setattr(dense, "MAX_QUERY_BYTES", 64)
    rng = np.random.default_rng(1)
    rows = [(i, None if i == 8 else "xyz"[i % 3], None if i in (4, 10) else rng.normal(size=4).tolist()) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id bigint, tenant_id string, embedding array<double>")
    asked = v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    want = {}
    for q, qt, a in rows[::2]:
        for i, t, b in rows:
            if qt is not None and qt == t:
                want[q, i] = None if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    got = dense.pairs(v, asked).collect()
    assert len(got) == len(want) and {(r.query_id, r.vec_id) for r in got} == set(want)
    assert all(r.score is None if want[r.query_id, r.vec_id] is None else abs(r.score - want[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_texts_are_cut_in_slices_of_bounded_bytes(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 40, None, "b" * 500, "", "c" * 60, "d" * 60])], ["id", "text"])
    docs = spark.createDataFrame([(i, "One thing. Another thing!\n" * i) for i in range(80)], "doc_id int, text string").coalesce(1)
    whole = [sorted(map(tuple, f(docs, "doc_id").collect())) for f in (ingest.split_chunks, ingest.split_sentences)]
    monkeypatch.setattr(ingest, "SLICE_BYTES", 100)
    assert [x.column("id").to_pylist() for x in ingest._slices([batch])] == [[0, 1], [2], [3, 4], [5]]
    assert [sorted(map(tuple, f(docs, "doc_id").collect())) for f in (ingest.split_chunks, ingest.split_sentences)] == whole


def test_words_of_queries_counted_in_place(spark, monkeypatch, capsys):
    """Equal to the scores from postings: in blocks and pieces, for a pool of chunks, and where rows repeat or weights are too many."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [("abc"[i % 3], f"c{i % 90}", i // 90, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(270)] + [(None, "x", 0, "w1"), ("d", "y", 0, None), ("d", "z", 0, "nothing asked")]
    docs = spark.createDataFrame(rows, "tenant_id string, chunk_id string, sentence_idx bigint, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices([*words, "absent"], k=4))) for i in range(12)] + [(50, ""), (51, None)], "query_id bigint, query string")
    of = lambda df: sorted(tuple(r) for r in df.select("query_id", "tenant_id", "chunk_id", "sentence_idx", "score", "rank").collect())
    want = of(sparse.bm25_top(sparse.index(docs), queries, 5))
    found = sparse.bm25_top_of(docs, queries, 5)
    assert of(found) == want
    capsys.readouterr()
    found.explain()
    assert "term" not in capsys.readouterr().out  # no postings in it
    pool = docs.where("chunk_id like 'c1%'").select("tenant_id", "chunk_id").distinct()
    inside = sparse.weighted(sparse.index(docs)).join(pool, ["tenant_id", "chunk_id"], "left_semi")
    assert of(sparse.bm25_top_of(docs, queries, 5, pool)) == of(sparse.top_weighted(inside, queries, 5))
    twice = docs.unionByName(docs.limit(40))
    assert of(sparse.bm25_top_of(twice, queries, 5)) == of(sparse.bm25_top(sparse.index(twice), queries, 5))
    monkeypatch.setattr(sparse, "MAX_QUERY_TERMS", 30)
    monkeypatch.setattr(sparse, "CELLS", 8)
    monkeypatch.setattr(sparse, "TOKENS", 4)
    assert of(sparse.bm25_top_of(docs, queries, 5)) == want
    monkeypatch.setattr(sparse, "WEIGHTS", 1)
    assert of(sparse.bm25_top_of(docs, queries, 5)) == want
    assert sparse.bm25_top_of(docs, queries.limit(0), 5).isEmpty()


def test_words_are_cut_from_bytes(spark, monkeypatch, capsys):
    """Texts of characters up to U+00FF are cut in columns of bytes, the others by ``words``: the same counts and places."""
    rng = random.Random(3)
    every, wide = [chr(c) for c in range(256)], ["\u0130", "\u0152", "\u03a3", "\u2013", "\u4e2d", "\U0001d7d8"]
    texts = ["".join(every), "".join(f"a{c}b {c} " for c in every), "", None, " ", "\u00e9", "Z"] + ["".join(rng.choices(every[48:] + wide * (i % 2), k=rng.randrange(60))) for i in range(200)]
    texts = [x for t in texts for x in (t, t)]  # neighbours: no word goes on in the next text
    docs = spark.createDataFrame([("t", f"c{i}", 0, t) for i, t in enumerate(texts)], "tenant_id string, chunk_id string, sentence_idx bigint, text string").cache()
    cut = {r.chunk_id: r.w for r in docs.select("chunk_id", sparse.words(F.col("text")).alias("w")).collect()}
    plain = pa.array(["x-"] + [t or "" for t in texts if max(t or "", default="") <= "\xff"], pa.string())[1:]
    found, offs = sparse._words_of(plain)
    assert [found[a:b].to_pylist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [cut[f"c{i}"] for i, t in enumerate(texts) if max(t or "", default="") <= "\xff"]
    vocab = {w: i for i, w in enumerate(sorted({w for ws in cut.values() for w in ws})[::2])}
    for size in (sparse.TEXT_BYTES, sparse.CELLS):
        monkeypatch.setattr(sparse, "TEXT_BYTES", size)
        for places in (False, True):
            got = {r.chunk_id: (r.dl, sorted(divmod(p, 1 << 32) for p in r.parts)) for r in sparse._counted(docs, vocab, places).collect()}
            held = {c: [(vocab[w], i if places else ws.count(w)) for i, w in enumerate(ws) if w in vocab] for c, ws in cut.items() if ws}
            assert got == {c: (len(cut[c]), sorted(h if places else set(h))) for c, h in held.items()}
    capsys.readouterr()
    sparse._counted(docs, vocab).explain()
    assert "U+00FF" in sparse._counted.__doc__ and "rlike" in capsys.readouterr().out.lower()


def test_a_term_meets_only_queries_that_have_it():
    """Scores by the queries of each term equal those by the whole matrix, rows without terms and terms without queries among them."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(30, n, replace=False)) for n in (4, 0, 9, 1, 30)]
    asked = sparse._asked(rows, 32)
    assert len(asked[1]) == sum(map(len, rows))  # nothing is kept for a term and a query without it
    matrix = np.zeros((32, 5))
    for q, terms in enumerate(rows):
        matrix[terms, q] = 1
    lengths = rng.integers(0, 6, 40)
    offs = np.append(0, np.cumsum(lengths)) + 3
    term, weight = rng.integers(0, 32, offs[-1] + 2), rng.integers(1, 1 << 40, offs[-1] + 2).astype(float)
    want = np.vstack([(matrix[term[a:b]] * weight[a:b, None]).sum(0) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    assert (sparse._sums(asked, term, weight, offs) == want).all()
    assert sparse._sums(asked, term, weight, offs[:1].repeat(3)).tolist() == [[0.0] * 5] * 2


def test_repeats_are_found_by_stretches_of_rows(spark):
    """A chunk's rows that stand together are one row of the shuffle, not one a sentence; no repeated row is missed."""
    docs = spark.createDataFrame([("a", "c", 0, "x"), ("b", None, 0, "x")], "tenant_id string, chunk_id string, sentence_idx bigint, text string").select("tenant_id", "chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(499).cast("bigint"))).alias("sentence_idx"))
    of = "tenant_id string, chunk_id string, low bigint, high bigint"
    found = docs.coalesce(1).where("tenant_id = 'a'").mapInArrow(sparse._stretches, of).collect()
    assert [tuple(r) for r in found] == [("a", "c", 0, 499)]
    assert not sparse.meeting(docs) and not sparse.meeting(docs.orderBy(F.desc("sentence_idx")))
    for more in ("chunk_id = 'c' and sentence_idx = 7", "chunk_id is null and sentence_idx = 0", "sentence_idx > 480"):
        assert sparse.meeting(docs.unionByName(docs.where(more))), more
    blank = docs.withColumn("sentence_idx", F.when(F.col("sentence_idx") > 0, F.col("sentence_idx")))
    assert not sparse.meeting(blank) and sparse.meeting(blank.unionByName(blank.where("sentence_idx is null")))


def test_names_called_from_one_place_share_a_block(spark, monkeypatch):
    """20 groups of 200 names with 50 callers each: about a row of bits a caller, not one a caller and block of all names."""
    sym = spark.range(1000).select(F.col("id").alias("symbol_id"), F.concat(F.lit("caller"), "id").alias("name"))
    edges = spark.range(4000).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("j")).select(((F.col("n") % 20) * 50 + F.col("j")).alias("caller_symbol_id"), F.concat(F.lit("name"), "n").alias("callee_name"))
    rows, write = {}, C.written

    def counted(df, name):
        out = write(df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(C, "written", counted)
    assert C.find_callers(sym, edges, edges.select(F.col("callee_name").alias("name")), 2).count() == 200_000
    assert rows["callers"] <= 1400


ASKED = ["w0", "w0 w1^2 w2", '"w0 w1"^1.5 w2', "+w0 -w1 w2", "w0 AND w1 OR w2", "(w0 OR w1) AND w3", '"w0 w2"~3', "w0 AND NOT (w1 OR w2)", '(w1 OR "w2 w3")^2 w4', '-w2 +(w0 w1)^0.5 "w0 w1 w4"~9', '"w0 w0"', "w5^0", "absent", "-w0", None]


def sentences_of(spark, seed):
    rng = random.Random(seed)
    rows = [("abc"[i % 3], f"c{i % 50}", i // 50, " ".join(f"W{rng.randrange(12)}" for _ in range(rng.randrange(0, 12)))) for i in range(240)] + [(None, "x", 0, "w0 w1"), ("d", "y", 0, None), ("d", "z", 0, "w9")]
    return spark.createDataFrame(rows, "tenant_id string, chunk_id string, sentence_idx bigint, text string")


def test_one_query_is_a_filter(spark, capsys):
    """Rows by the query language without a shuffle, equal to those by postings."""
    docs = sentences_of(spark, 3)
    postings = L.positional(docs).cache()
    for text in ASKED[:-2]:
        found = L.matching(docs, text)
        capsys.readouterr()
        found.explain()
        assert "Exchange" not in capsys.readouterr().out
        asked = spark.createDataFrame([(0, text)], "query_id int, query string")
        want = sorted(tuple(r) for r in L.score(postings, asked).select("tenant_id", "chunk_id", "sentence_idx").collect())
        assert sorted(tuple(r)[:3] for r in found.where("tenant_id is not null").collect()) == want, text


def test_trees_evaluated_in_place(spark, monkeypatch, capsys):
    """Equal to the scores from positional postings: in blocks and pieces, and where rows repeat or weights are too many."""
    docs = sentences_of(spark, 5)
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id bigint, query string")
    of = lambda df: sorted(tuple(r) for r in df.select("query_id", "tenant_id", "chunk_id", "sentence_idx", "score", "rank").collect())
    want = of(L.search(L.positional(docs), queries, 6))
    found = L.search_of(docs, queries, 6)
    assert of(found) == want and any(r[4] == 0 for r in want)
    capsys.readouterr()
    found.explain()
    assert "positions" not in capsys.readouterr().out  # no postings in it
    twice = docs.unionByName(docs.limit(40))
    assert of(L.search_of(twice, queries, 6)) == of(L.search(L.positional(twice), queries, 6))
    monkeypatch.setattr(L, "MAX_NODES", 9)
    monkeypatch.setattr(L, "CELLS", 40)
    monkeypatch.setattr(sparse._Kept, "LEAST", 1)
    assert of(L.search_of(docs, queries, 6)) == want
    monkeypatch.setattr(sparse, "WEIGHTS", 1)
    assert of(L.search_of(docs, queries, 6)) == want
    assert L.search_of(docs, queries.limit(0), 6).isEmpty() and L.search_of(docs.limit(0), queries, 6).isEmpty()


def test_best_rows_are_kept_in_columns(monkeypatch):
    """The best of random scores with many ties, null keys among them, cut whenever candidates doubled; ties by key, nulls first."""
    monkeypatch.setattr(sparse._Kept, "LEAST", 8)
    rng = np.random.default_rng(2)
    kept, rows = sparse._Kept(3, [7, 8], ("chunk_id", "sentence_idx")), []
    for _ in range(20):
        score, names = rng.integers(0, 4, (30, 2)).astype(float), rng.choice(["t", "u"], 30).tolist()
        keys = [[None if x == 0 else str(x) for x in rng.integers(0, 40, 30)], rng.integers(0, 1 << 30, 30).tolist()]
        kept.add(score, kept.tenants(names), [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64())], 0)
        rows += [(q, names[i], score[i, j] / sparse.UNITS, keys[0][i], keys[1][i]) for i in range(30) for j, q in enumerate((7, 8)) if score[i, j] > 0]
        assert kept.n <= 8 + 60 + 12
    order = lambda r: (-r[2], r[3] is not None, r[3] or "", r[4])
    want = {g: sorted((r for r in rows if r[:2] == g), key=order)[:3] for g in {r[:2] for r in rows}}
    got = [tuple(r.values()) for b in kept.rows() for r in b.to_pylist()]
    assert len(got) == 12 and {g: sorted((r for r in got if r[:2] == g), key=order) for g in want} == want


def test_ranked_rows_carry_no_texts(spark):
    """Texts do not go through the joins and windows of the ranked lists; their bytes, hashes and vectors do, with the same budget."""
    rows = R._embedded(spark, SMALL).cache()
    assert "text" not in rows.columns and "text" not in R._ranked(spark, SMALL).columns
    texts = rows.drop("n_bytes").join(S.live(spark, SMALL).select("tenant_id", "chunk_id", "text"), ["tenant_id", "chunk_id"])
    of = lambda df: sorted(tuple(r) for r in df.select("query_id", "tenant_id", "chunk_id", "rank", "used_tokens").collect())
    assert of(ranking.budget(rows)) == of(ranking.budget(texts)) != []
    assert texts.where(F.array_distinct(F.zip_with("embedding", V.mock_embedding(F.col("text"), 16).cast("array<float>"), lambda a, b: a == b)) != F.array(F.lit(True))).isEmpty()
