"""Tables written once in the folder that driver and executors share, to cut lineage between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and the master is local, a temporary folder stands in."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Remove every table written so far."""
    for spark, path in _written:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except (Py4JError, OSError, AttributeError):  # the driver's JVM is gone at exit
            break
    _written.clear()


def numbered(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """``df`` with the dense place of each row in the order of the given columns, from 0.

    Rows are dealt by ranges and counted by range; only these counts, one a partition, meet.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before, total = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before.append((r["_part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "_part bigint, _before bigint"))
    return dealt.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
