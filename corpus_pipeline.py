"""A training corpus from documents: languages, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of docs, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import language_id, near_copies, packing, personal_data, substring_dedup
from recallspark.llm.common import fresh_path, shuffles_removed

#: Least part of a text's letter n-grams that its language explains; documents below it, and those without letters, go.
MIN_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows teach.

    Learned from rows with an id, a text and a label whose id is not held out; judged are all rows, by their texts alone: a
    null id or label changes nothing, null and empty texts and those without letters go, repeated rows stay or go together.
    """
    filters = language_id.fit(docs.where(language_id.in_training()))
    found = language_id.identify(docs, filters, prefix="__")
    return found.where((F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).drop("__lang_pred", "__score")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) the document with the smallest id.

    Where that id has several texts in the group, the one with the least hash stays. Repeated rows count as one; rows
    without an id are kept, as nothing says which of them to keep.
    """
    found = near_copies.near_copies(docs).where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("same").alias("__same"))
    own = docs.withColumn("__same", F.xxhash64("text"))
    kept = own.hint("merge").join(found.drop("component"), ["doc_id", "__same"]).dropDuplicates(["doc_id", "__same"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold; a text that keeps all its words stays as it is, also if it is null or empty."""
    found = substring_dedup.drop_repeats(docs, prefix="__")
    return _with_text(found, F.when(F.col("__n_removed") > 0, F.col("__kept_text")).otherwise(F.col("text")), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the kinds of the spans of personal data in their place; a null text stays null."""
    return _with_text(personal_data.redact_personal_data(docs), F.col("text"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token sequences: a row for each piece, with its ids. Rows with a null or repeated id are packed like any others."""
    return packing.pack_documents(docs, with_ids=True)


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """docs with this text, and its number of characters where there is such a column."""
    docs = docs.withColumn("text", text)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*(F.col(f"`{c}`") for c in columns))


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = fresh_path(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs


#: SQL has no tokenizer and no SimHash; the tests compare with a brute-force version.
ORACLE_SQL = None
