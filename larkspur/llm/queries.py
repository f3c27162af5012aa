"""Registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the next by id. Null texts are empty; null ids come last, equal ids in order of the hash of their text; repeated rows stay rows."""
    from larkspur.llm.fingerprint import edited_neighbours

    return edited_neighbours(_table(spark, sf_dir, "documents"))


BPE = "byte_bpe_50k.json"


def _tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document. A null or empty text is one piece, the id 0 alone; repeated and null ids are packed row by row."""
    from larkspur.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes kept of every document. Null and short texts lose nothing; of repeated rows each counts as the other's copy."""
    from larkspur.llm.repeats import removal

    return removal(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of all documents. Null and empty texts have length 0; an empty table gives no rows."""
    from larkspur.llm.tokens import length_histogram

    return length_histogram(_table(spark, sf_dir, "documents"), _tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in every document, row by row. Null, empty and wordless texts have none; items without words or id are left out."""
    from pyspark.sql import functions as F

    from larkspur.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join(F.transform("runs", lambda r: F.concat(r["starts"], F.lit(":"), r["ends"])), ",").alias("hit_spans"), F.col("longest").alias("longest_match"), "longest_at")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each template found in a document. Null and empty texts give none; repeated rows are scanned one by one."""
    from larkspur.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every row. Texts without words are linked with nothing; equal texts are linked whatever their ids, and null ids only where nothing smaller is reachable."""
    from larkspur.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page. Null, empty and text-free pages give the empty text; tags that never end are text."""
    from larkspur.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document. Null and empty texts have none; repeated rows are judged one by one."""
    from larkspur.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. Null and empty texts get the model's intercept; null ids are scored but never learned from, and not held out; without labels all score 0."""
    from larkspur.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor against every row of ``embeddings``; labels of ids divisible by 7 move on by one. Rows without label, vector or a finite component take no part; ties go by id."""
    from pyspark.sql import functions as F

    from larkspur.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests; a null text counts as empty."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from larkspur.llm.bpe import decode, encode

    ranks = _tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks).drop("text"), *ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 5 % of the documents of 20 words or more towards the texts of ``benchmark``. Null and wordless texts weigh 0 and are never drawn; ties go by id."""
    from larkspur.llm.importance import resample

    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests hold the others against brute force."""
    from larkspur.llm import sql

    return {"op5_decontamination": sql.DECONTAMINATION, "op7_minhash_neardup": sql.NEAR_DUPLICATES, "op11_hard_negatives": sql.HARD_NEGATIVES, "op13_importance_resampling": sql.IMPORTANCE}
