"""The queries of this subpackage by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import language_id, packing, personal_data, pieces, secrets, simhash, substring_dedup, token_counts, topk_search, vector_dedup
from recallspark.llm.common import fresh_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are the first versions that a ledger of its own sees."""
    docs = _documents(spark, sf_dir)
    ledger = secrets.BlobLedger(spark, fresh_path(spark, "secret-ledger"))
    ledger.scan(docs, "doc_id")
    found = ledger.report(docs, "doc_id")
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = language_id.fit(docs.where(language_id.in_training()))
    found = language_id.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (~language_id.in_training()).alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_substring_dedup, op3_language_id, op4_packing, op5_sentencepiece, op6_token_counts, op7_simhash, op8_vector_dedup, op9_pii, op10_topk_search)}
