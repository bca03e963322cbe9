"""Offline measures of retrieval against labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_of_hits(hits: DataFrame, labelled: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank) from hits (query_id, rank from 1), the labelled ones among the first k of each query, and labelled (query_id, relevant), how many each query has."""
    first = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    found = labelled.join(first, "query_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return found.select("query_id", (n / F.col("relevant")).alias("recall"), (n / F.lit(k)).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank) of ranked (query_id, record_key, rank from 1) against relevant (query_id, record_key), for each labelled query."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "record_key"])
    return quality_of_hits(hits, relevant.groupBy("query_id").agg(F.count("*").alias("relevant")), k)


def summary(quality: DataFrame) -> DataFrame:
    """Recall at k, precision at k and mean reciprocal rank over queries."""
    return quality.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall_at_k"), F.avg("precision").alias("precision_at_k"), F.avg("reciprocal_rank").alias("mrr"))


def false_reuse(decisions: DataFrame, reusable: DataFrame) -> DataFrame:
    """(queries, reused, false_reuse_rate, coverage) of decisions (query_id, reusable, record_key) against labels (query_id, record_key): reuse of a record that isn't labelled is false."""
    right = reusable.select("query_id", "record_key", F.lit(True).alias("right")).distinct()
    rows = decisions.join(right, ["query_id", "record_key"], "left")
    reused = F.count_if("reusable")
    wrong = F.count_if(F.col("reusable") & F.col("right").isNull())
    return rows.agg(F.count("*").alias("queries"), reused.alias("reused"), F.when(reused > 0, wrong / reused).alias("false_reuse_rate"), (reused / F.count("*")).alias("coverage"))


def threshold_sweep(scored: DataFrame, relevant: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, returned, hits, precision, recall) of scored (query_id, record_key, score) at each threshold, from one pass over the scores."""
    labels = relevant.select("query_id", "record_key", F.lit(1).alias("label")).distinct()
    rows = scored.join(labels, ["query_id", "record_key"], "left")
    levels = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = rows.select(*by, "label", F.explode(F.filter(levels, lambda t: t <= F.col("score"))).alias("threshold"))
    out = rows.groupBy(*by, "threshold").agg(F.count("*").alias("returned"), F.count("label").alias("hits"))
    return rates(out, labels.agg(F.count("*").alias("total")), by)


def rates(found: DataFrame, total: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """found (by..., threshold, returned, hits) with precision and recall; total is one row with the number of labels."""
    out = found.join(F.broadcast(total))
    return out.select(*by, "threshold", "returned", "hits", (F.col("hits") / F.col("returned")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"))
