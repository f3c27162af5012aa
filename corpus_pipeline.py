"""Five-stage corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and
returns the columns of ``documents`` (the last one: pieces with their places).  ``run``
writes every stage as Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import materialize
from larkspur.llm.decontaminate import drop_contaminated
from larkspur.llm.neardup import keep_first
from larkspur.llm.packing import pack_documents
from larkspur.llm.pii import redact
from larkspur.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts get the intercept's score, repeated rows go or stay together."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more. Texts without words are in no group and stay."""
    return keep_first(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark; null and wordless texts have none and stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text, null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset; a null or empty text is the end mark alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier and the components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


#: Rows of an Arrow batch: an executor holds a batch of texts in its buffers and in Python for each task at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(ROWS))
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
