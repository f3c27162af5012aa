"""Structured Streaming forms of the stateful features: change log, access log, cache, latencies.

Each takes a streaming DataFrame and returns one (or starts a sink); ``availableNow`` runs
give what the batch operators give on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_state(log: DataFrame) -> DataFrame:
    """Latest record of each (tenant_id, chunk_id) of a change log (seq, op, …), deletes included (complete or update mode)."""
    last = log.groupBy("tenant_id", "chunk_id").agg(F.max(F.struct("seq", "op", "payload")).alias("r"))
    return last.select("tenant_id", "chunk_id", "r.*")


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """Number of the newest whole version folder (before ``below``)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((n for n in whole if below is None or n < below), default=None)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table that ``upsert_sink`` keeps."""
    return spark.read.parquet(f"{path}/v{_newest(spark, path)}").where("op <> 'delete'")


def upsert_sink(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a change log to a Parquet table at ``path``, one version folder a batch; a batch that is retried replaces its own folder.

    Deletes stay in the table as rows, so that an older add that comes late does not bring a
    row back; ``current`` reads the newest whole version without them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("tenant_id", "chunk_id").agg(F.max(F.struct("seq", "op", "payload")).alias("r")).select("tenant_id", "chunk_id", "r.*")
        schema = "tenant_id string, chunk_id string, seq bigint, op string, payload string"
        version = _newest(spark, path, number)
        old = spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/v{version}")
        both = old.unionByName(last.select(old.columns))
        new = both.groupBy("tenant_id", "chunk_id").agg(F.max(F.struct("seq", "op", "payload")).alias("r")).select("tenant_id", "chunk_id", "r.*")
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(log: DataFrame) -> DataFrame:
    """Running (chunk_id, access_count, first_access, last_access)."""
    return log.groupBy("chunk_id").agg(F.count("*").alias("access_count"), F.min("timestamp_ms").alias("first_access"), F.max("timestamp_ms").alias("last_access"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of (ts, session_id) events with counts; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latencies(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling-window count, mean and greatest duration of each tool."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool_name")
    return w.agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("most")).select(F.col("w.start").alias("start"), "tool_name", "n", "mean", "most")


def live_entries(inserts: DataFrame, ttl: str = "45 minutes") -> DataFrame:
    """Cache inserts deduplicated by entry within the TTL (append mode)."""
    return inserts.withWatermark("created", ttl).dropDuplicatesWithinWatermark(["entry_id"])


_RING = "times array<bigint>, ids array<string>, figures array<double>"


def _newest_rows(times: np.ndarray, ids: np.ndarray, values: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``last`` newest rows by time, then id."""
    order = np.lexsort((ids.astype(str), times))[::-1][:last]
    return times[order], ids[order], values[order]


def rolling_latencies(events: DataFrame, last: int = 1000, by: str = "tool_name", value: str = "duration_ms") -> DataFrame:
    """(by, n, mean, p50, p90, p99) over the ``last`` newest rows of each group so far (update mode).

    The state of a group is its ring of ``last`` rows (timestamp_ms, trace_id as text, value).
    Every partition of a batch sends at most ``last`` rows of a group to it, so a group with
    most of the rows makes no long task.  Rows without a value are left out.
    """
    rows = events.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col("timestamp_ms").cast("bigint").alias("at"), F.col("trace_id").cast("string").alias("id"), F.col(value).cast("double").alias("v"))

    def newest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.sort_values(["at", "id"], ascending=False).groupby("k", dropna=False).head(last)

    def ring(key: tuple[Any], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, ids, values = (np.array(x, t) for x, t in zip(state.get, (np.int64, object, float), strict=True)) if state.exists else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))
        for part in parts:
            times, ids, values = _newest_rows(np.append(times, part["at"].to_numpy(np.int64)), np.append(ids, part["id"].to_numpy(object)), np.append(values, part["v"].to_numpy(float)), last)
        state.update((times.tolist(), ids.tolist(), values.tolist()))
        ordered = np.sort(values)
        at = lambda p: float(ordered[p * (len(ordered) - 1) // 100])
        yield pd.DataFrame({by: [key[0]], "n": [len(values)], "mean": [float(values.mean())], "p50": [at(50)], "p90": [at(90)], "p99": [at(99)]})

    kind = dict(rows.dtypes)["k"]
    few = rows.mapInPandas(newest, rows.schema)
    return few.groupBy("k").applyInPandasWithState(ring, f"{by} {kind}, n bigint, mean double, p50 double, p90 double, p99 double", _RING, "update", "NoTimeout")


#: Hours after the last access at which exp(-hours / 24) falls below 0.01.
FORGOTTEN_HOURS = 24 * float(np.log(100))


def access_decay(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(chunk_id, access_count, first_access, last_access, forgotten) of an access log (chunk_id, ts), in update mode.

    A chunk is forgotten, and its state dropped, once the watermark is ``FORGOTTEN_HOURS``
    behind its last access, where its decay falls below 0.01; a later access starts anew.
    """

    def step(key: tuple[Any], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, first, last = state.get if state.exists else (0, None, None)
        gone = state.hasTimedOut
        if gone:
            state.remove()
        else:
            for part in parts:
                ms = part["ts"].astype("datetime64[ms]").astype("int64")
                count += len(part)
                first = int(ms.min()) if first is None else min(first, int(ms.min()))
                last = int(ms.max()) if last is None else max(last, int(ms.max()))
            state.update((count, first, last))
            state.setTimeoutTimestamp(max(last + int(FORGOTTEN_HOURS * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"chunk_id": [key[0]], "access_count": [count], "first_access": [first], "last_access": [last], "forgotten": [gone]})

    rows = log.select("chunk_id", "ts").withWatermark("ts", late)
    return rows.groupBy("chunk_id").applyInPandasWithState(step, f"chunk_id {dict(log.dtypes)['chunk_id']}, access_count bigint, first_access bigint, last_access bigint, forgotten boolean", "n bigint, first bigint, last bigint", "update", "EventTimeTimeout")
