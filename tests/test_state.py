"""Traces, tiers, maintenance, evaluation, store and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluate as E, maintenance as M, tiered as T, traces
from larkspur.sources.store import ChunkStore, read_eval
from larkspur.streaming import jobs


def test_python_frames_innermost_first(spark):
    text = 'Traceback (most recent call last):\n  File "a.py", line 1, in main\n    f()\n  File "b.py", line 2, in f\nKeyError: \'x\''
    r = traces.parse(spark.createDataFrame([(1, text), (2, None)], "trace_id int, full_trace string")).orderBy("trace_id").collect()
    assert [(f.file, f.line, f.function) for f in r[0].frames] == [("b.py", 2, "f"), ("a.py", 1, "main")] and r[0].error_signature == "KeyError: 'x'"
    assert r[1].frames == [] and r[1].dialect == "generic"


def test_wal_replay(spark):
    log = spark.createDataFrame([(1, "add", "t", "a", "1"), (2, "checkpoint", None, None, None), (3, "add", "t", "b", "2"), (4, "add", "t", "b", "3"), (5, "add", "t", "c", "4"), (6, "delete", "t", "c", None), (7, "delete", "t", "zz", None), (8, None, None, None, None), (9, "add", "t", "d", "5")], "seq int, op string, tenant_id string, chunk_id string, payload string")
    assert [(r.chunk_id, r.payload) for r in M.wal_replay(log).collect()] == [("b", "3")]
    present = spark.createDataFrame([("t", "b")], "tenant_id string, chunk_id string")
    assert M.wal_replay(log, present).isEmpty()


def test_cache_rules(spark):
    e = spark.createDataFrame([("e1", "t", None, [1.0, 0.0], ["c1"], 1, 1000, 0.95), ("e2", "t", "p", [1.0, 0.0], ["c2"], 1, 1000, 0.5), ("e3", "t", None, [1.0, 0.0], ["c3"], 1, 1000 - T.TTL_MS, 0.5)], "entry_id string, tenant_id string, project_id string, query_embedding array<float>, result_ids array<string>, memory_version bigint, created_at bigint, confidence double")
    q = spark.createDataFrame([(1, "t", None, [1.0, 0.1]), (2, "t", "p", [1.0, 0.0]), (3, "u", None, [1.0, 0.0]), (4, "t", None, [0.0, 1.0])], "query_id int, tenant_id string, project_id string, embedding array<float>")
    got = {r.query_id: (r.entry_id, r.confidence) for r in T.cache_lookup(q, e, 1000).collect()}
    assert got == {1: ("e1", 1.0), 2: ("e2", 0.6)}
    new = spark.createDataFrame([("t", 2)], "tenant_id string, current_version bigint")
    assert T.cache_lookup(q, e, 1000, new).isEmpty()
    gone = spark.createDataFrame([("c1",)], "chunk_id string")
    assert sorted(r.entry_id for r in T.cache_invalidate(e, chunks=gone).collect()) == ["e2", "e3"]


def test_demotion_needs_warm_up(spark):
    hot = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    scored = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "chunk_id string, promotion_score double")
    assert T.demotions(scored, hot, 99).isEmpty() and [r.chunk_id for r in T.demotions(scored, hot, 100).collect()] == ["a"]


def test_evaluation(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (3, "z")], "query_id int, doc_id string")
    res = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "q", 1)], "query_id int, doc_id string, rank int")
    got = {r.query_id: (r.recall, r.mrr, r.precision) for r in E.per_query(queries, qrels, res).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "query_id int, value double")
    b = E.bootstrap(v, 200).first()
    assert b == E.bootstrap(v, 200).first() and b.lower < b.mean == 0.5 < b.upper
    p = E.paired(v, v.withColumn("value", F.col("value") + F.col("query_id") % 3 * 0.1)).first()
    assert p.n == 40 and p.wins == 26 and p.ties == 14 and p.p < 0.001
    assert E.bootstrap(v.limit(0)).isEmpty()


def test_store_round_trip(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "store"))
    assert s.live().isEmpty() and s.tenants().isEmpty()
    a = s.add("t1", "The quick brown fox", "doc", project="p", episode="e1", timestamp_ms=1)
    b = s.add("t1", "A lazy dog. " * 200, "doc", timestamp_ms=2)
    c = s.add("t2", "The quick secret", "doc", timestamp_ms=3)
    assert [r.chunk_id for r in s.search("t1", "quick").collect()] == [a]
    hit = s.search("t1", "QUICK---fox!!", episode="e1").first()
    assert hit.citation.citation_id.startswith(a) and hit.episode_id == "e1"
    assert s.get("t2", a).isEmpty() and s.get("t1", b).count() == 1
    with pytest.raises(ValueError):
        s.search("t1", "x", k=0)
    with pytest.raises(ValueError):
        s.add("bad tenant", "x")
    with pytest.raises(ValueError):
        s.add("t1", "x", "nope")
    assert s.delete("t1", a) and not s.delete("t1", a) and s.search("t1", "quick").isEmpty()
    before = sorted(r.chunk_id for r in s.live().collect())
    assert s.stats("t1").first().deleted == 1
    assert s.compact() and sorted(r.chunk_id for r in s.live().collect()) == before and c in before
    assert s.tombstones().isEmpty() and s.stats("t1").first().deleted == 0
    assert {r.tenant_id for r in s.disk_stats().collect()} == {"t1", "t2"}


def test_store_with_an_embedder(spark, tmp_path):
    """Vectors find what words do not, and both lists are fused."""
    near = lambda c: F.array(F.when(c.rlike("fox|animal"), 1.0).otherwise(0.0), F.when(c.rlike("tax|money"), 1.0).otherwise(0.1))
    s = ChunkStore(spark, str(tmp_path / "store"), near)
    fox, tax = s.add("t1", "The quick brown fox", "doc", timestamp_ms=1), s.add("t1", "A tax return", "doc", timestamp_ms=2)
    other = s.add("t2", "Another fox", "doc", timestamp_ms=3)
    got = [r.chunk_id for r in s.search("t1", "animal return").collect()]
    assert sorted(got) == sorted([fox, tax]) and other not in got
    assert [r.chunk_id for r in s.search("t1", "animal", k=1).collect()] == [fox]
    s.delete("t1", fox)
    assert s.compact() and [r.chunk_id for r in s.search("t1", "animal").collect()] == [tax]
    assert ChunkStore(spark, str(tmp_path / "store")).search("t1", "animal").isEmpty()


def test_late_adds_do_not_undo_deletes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seq bigint, op string, tenant_id string, chunk_id string, payload string"
    for row in [(5, "delete", "t", "a", None), (1, "add", "t", "a", "1")]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.upsert_sink(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert jobs.current(spark, out).isEmpty()


def test_tombstones_written_during_compaction_stay(spark, tmp_path, monkeypatch):
    s = ChunkStore(spark, str(tmp_path / "store"))
    a, b = s.add("t1", "one", "doc"), s.add("t1", "two", "doc")
    s.delete("t1", a)
    live = s.live
    monkeypatch.setattr(s, "live", lambda *x: (live(*x), s.delete_batch(spark.createDataFrame([("t1", b)], "tenant_id string, chunk_id string")))[0])
    assert s.compact()
    monkeypatch.undo()
    assert s.live().isEmpty() and [r.chunk_id for r in s.tombstones().collect()] == [b]


def test_eval_files(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"queries": [{"id": "q1", "query": "x", "relevant": ["d1", "d2"]}], "documents": [{"id": "d1", "text": "t", "type": "documentation"}]}))
    q, d, r = read_eval(spark, str(p))
    assert q.count() == 1 and d.first().type == "doc" and r.count() == 2


def test_streams_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = [(1, "add", "t", "a", "1"), (2, "add", "t", "b", "2"), (3, "delete", "t", "a", None), (4, "add", "t", "b", "3")]
    schema = "seq bigint, op string, tenant_id string, chunk_id string, payload string"
    for i in (0, 2):
        spark.createDataFrame(log[i : i + 2], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.upsert_sink(stream, out, str(tmp_path / "cp")).awaitTermination()
    now = jobs.current(spark, out)
    want = M.wal_replay(spark.createDataFrame(log, schema))
    assert [(r.chunk_id, r.payload) for r in now.collect()] == [(r.chunk_id, r.payload) for r in want.collect()] == [("b", "3")]
    q = jobs.latest_state(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.chunk_id, r.op) for r in spark.table("latest").collect()) == [("a", "delete"), ("b", "add")]


def test_search_through_the_cache_writes_back_once(spark):
    from larkspur.operators import tiered as T

    asked = spark.createDataFrame([(1, "t", None, [1.0, 0.0]), (2, "t", "p", [0.0, 1.0]), (3, "u", None, [1.0, 1.0])], "query_id int, tenant_id string, project_id string, embedding array<float>")
    empty = spark.createDataFrame([], "entry_id string, tenant_id string, project_id string, query_embedding array<float>, memory_version bigint, created_at bigint, confidence double, result_ids array<string>")
    versions = spark.createDataFrame([("t", 4)], "tenant_id string, current_version int")
    searched = []

    def search(queries):
        searched.append(sorted(r.query_id for r in queries.collect()))
        return queries.select("query_id", F.explode(F.expr("array(struct('b' as c, 2 as r), struct('a' as c, 1 as r))")).alias("x")).where("query_id <> 3").select("query_id", F.col("x.c").alias("chunk_id"), F.col("x.r").alias("rank"))

    one = T.search_through(asked, empty, search, 1000)
    assert searched == [[1, 2, 3]] and {(r.query_id, r.chunk_id, r["rank"], r.source) for r in one.results.collect()} == {(q, c, n, "search") for q in (1, 2) for c, n in (("a", 1), ("b", 2))}
    kept = T.cache_insert(T.cache_insert(empty, one.entries, 1000), one.entries, 1000)
    assert kept.count() == 2 and {tuple(r.result_ids) for r in kept.collect()} == {("a", "b")}
    log = T.keep_accesses(T.keep_accesses(one.accesses.limit(0), one.accesses), one.accesses)
    assert log.count() == 4
    two = T.search_through(asked, kept, search, 2000)
    assert searched[1] == [3] and {(r.query_id, r.chunk_id, r["rank"], r.source) for r in two.results.collect()} == {(q, c, n, "cache") for q in (1, 2) for c, n in (("a", 1), ("b", 2))}
    assert {r.memory_version for r in T.search_through(asked, empty, search, 1000, versions).entries.collect()} == {4}
    T.search_through(asked, kept, search, 3000, versions)  # entries of version 0 are too old for tenant t
    assert searched[-1] == [1, 2, 3]


def test_rows_added_while_compacting_stay(spark, tmp_path):
    """An add and a delete between the reading of the old files and their removal."""
    store = ChunkStore(spark, str(tmp_path / "store"))
    a, b = store.add("t", "first text"), store.add("t", "second text")
    store.delete("t", b)
    late = {}

    class Slow(ChunkStore):
        def tombstones(self):
            found = spark.createDataFrame(super().tombstones().collect(), super().tombstones().schema)
            if not late:
                late["c"] = store.add("t", "third text")
                store.delete_batch(spark.createDataFrame([("t", a)], "tenant_id string, chunk_id string"))
            return found

    assert Slow(spark, store.base).compact()
    assert [r.chunk_id for r in store.live("t").collect()] == [late["c"]]
    assert store.compact() and [r.chunk_id for r in store.live("t").collect()] == [late["c"]]
    assert store.disk_stats().first().files == 1
