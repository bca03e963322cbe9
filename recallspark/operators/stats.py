"""Statistics of the indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flag(c: str):
    return F.sum(F.col(c).cast("long"))


def exact_stats(entries: DataFrame, scope: str | None = None) -> DataFrame:
    """(operation_kind, count, success, replayable) by operation, in order; of one scope on request."""
    rows = entries if scope is None else entries.where(F.col("cache_scope") == scope)
    return rows.groupBy("operation_kind").agg(F.count("*").alias("count"), _flag("success").alias("success"), _flag("replayable").alias("replayable")).orderBy("operation_kind")


def semantic_stats(entries: DataFrame, scope: str) -> DataFrame:
    """(embedding_provider, embedding_index, operation_kind, count, success) of a scope, in order."""
    keys = ["embedding_provider", "embedding_index", "operation_kind"]
    return entries.where(F.col("cache_scope") == scope).groupBy(*keys).agg(F.count("*").alias("count"), _flag("success").alias("success")).orderBy(*keys)
