"""Stateful streams give what the batch operators give, also after a restart from the checkpoint."""

import random

from pyspark.sql import functions as F

from larkspur.operators import maintenance as M, tiered as T
from larkspur.streaming import jobs

EVENTS = "tool_name string, timestamp_ms bigint, trace_id string, duration_ms double"


def run(stream, checkpoint, into, key):
    """One run to the end of what is there; the newest row of each key stays in ``into``."""
    def keep(batch, number):
        for r in batch.collect():
            into[r[key]] = r

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_rolling_latencies_with_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(500), f"t{i}", rng.choice([None, rng.random() * 9])) for i in range(900)]
    found, src = {}, str(tmp_path / "in")
    for part in (rows[:200], rows[200:650], rows[650:]):
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(src)
        run(jobs.rolling_latencies(spark.readStream.schema(EVENTS).parquet(src), last=60), str(tmp_path / "cp"), found, "tool_name")
    batch = M.latency_stats(spark.createDataFrame([r for r in rows if r[3] is not None], EVENTS), 60, order=("timestamp_ms", "trace_id"))
    want = {r.tool_name: tuple(round(x, 9) for x in (r.n, r["mean"], r.p50, r.p90, r.p99)) for r in batch.collect()}
    assert {k: tuple(round(x, 9) for x in (r.n, r["mean"], r.p50, r.p90, r.p99)) for k, r in found.items()} == want


def test_access_decay_forgets_and_starts_anew(spark, tmp_path):
    src, found = str(tmp_path / "in"), {}
    hours = [[(c, h + 1000) for c, h in part] for part in ([("x", 0), ("x", 5), ("y", 6)], [("y", 60)], [("z", 130)], [("z", 131)], [("x", 140)], [("z", 141)])]
    for part in hours:
        df = spark.createDataFrame(part, "chunk_id string, h int").select("chunk_id", F.timestamp_millis(F.col("h").cast("bigint") * 3_600_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        run(jobs.access_decay(spark.readStream.schema("chunk_id string, ts timestamp").parquet(src)), str(tmp_path / "cp"), found, "chunk_id")
        if part == [("z", 1131)]:
            assert found["x"].forgotten and found["x"].access_count == 2 and not found["y"].forgotten
    at = {k: (r.access_count, r.first_access // 3_600_000, r.last_access // 3_600_000, r.forgotten) for k, r in found.items()}
    assert at == {"x": (1, 1140, 1140, False), "y": (2, 1006, 1060, False), "z": (3, 1130, 1141, False)}
    now = 1130 * 3_600_000
    stats = T.access_stats(spark.createDataFrame([(c, None, h * 3_600_000) for part in hours[:3] for c, h in part], "chunk_id string, project_id string, timestamp_ms bigint"))
    assert {r.chunk_id for r in T.decay_all(stats, now).collect()} == {"y", "z"}  # the batch form forgets the same
