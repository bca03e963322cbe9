"""Matching of calls with history: exact reuse and hybrid retrieval, for batches of queries in one plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import policy, vectors
from recallspark.functions.text import preview
from recallspark.operators.exact import exact_call, with_facts
from recallspark.operators.ranking import bm25_of_bounded, first_per_group
from recallspark.operators.semantic import normalize_semantic
from recallspark.sources.embedders import Embedder, Reranker, embedded

#: The reasons that results give.
UNSUPPORTED_EXACT = "tool/action is not supported by exact-v5"
NO_KEY = "no exact key found"
REUSE = "fresh successful replayable exact match"
FAILED = "exact history exists but selected observation failed: "
STALE = "exact history exists but the selected observation is stale"
UNSUPPORTED_SEMANTIC = "tool/action is not supported by semantic-v3"
CANDIDATES = "semantic candidates require an equivalence decision before reuse"
NO_CANDIDATE = "no semantic candidate reached the score threshold"


def exact_reason(selected, call_replayable, entries):
    """(reusable, reason) columns for the selected entry of a call's history."""
    s = selected
    reusable = F.coalesce(call_replayable & s["success"] & s["replayable"] & s["fresh"], F.lit(False))
    reason = (
        F.when(entries == 0, NO_KEY).when(reusable, REUSE).when(~s["success"], F.concat(F.lit(FAILED), s["status_reason"])).when(~s["replayable"], s["policy_reason"]).otherwise(STALE)
    )
    return reusable, reason


def match_keys(queries: DataFrame, entries: DataFrame, now: int, limit: int = 20) -> DataFrame:
    """queries (query_id, exact_key, replayable) with matched, reusable, reason, match_count, selected and matches.

    Entries of other keys than those asked for go first, before anything is shuffled where these are few. A key's history
    is its newest entries, successful ones first, cut to limit before the join; selected is the first entry that is
    successful, replayable and fresh, else the first successful one, else the first.
    """
    newest = [F.desc("success"), F.desc("ended_at"), F.asc("record_key")]
    asked = entries.join(queries.select("exact_key").distinct(), "exact_key", "leftsemi")
    history = first_per_group(asked, ["exact_key"], newest, limit, "history_rank")
    fresh = policy.is_fresh(F.col("expires_at_epoch"), F.lit(now))
    choice = F.when(F.col("success") & F.col("replayable") & fresh, 0).when(F.col("success"), 1).otherwise(2)
    shown = ["history_rank", "record_key", "source_path", "tool_name", "action_kind", "operation_kind", "success", "status_reason", "replayable", "replay_policy", "policy_reason",
             "freshness_class", "ttl_seconds", "ended_at", "expires_at_epoch", "response_sha256"]
    entry = F.struct(choice.alias("choice"), *shown, fresh.alias("fresh"), preview(F.col("response_text")).alias("response_preview"))
    by_key = history.select("exact_key", entry.alias("e")).groupBy("exact_key").agg(F.collect_list("e").alias("all"))
    by_key = by_key.select("exact_key", F.array_min("all").alias("selected"), F.array_sort("all", lambda a, b: a["history_rank"] - b["history_rank"]).alias("matches"))
    found = queries.join(by_key, "exact_key", "left")
    count = F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches"))
    reusable, reason = exact_reason(F.col("selected"), F.col("replayable"), count)
    return found.select(*queries.columns, (count > 0).alias("matched"), reusable.alias("reusable"), reason.alias("reason"), count.alias("match_count"), "selected", "matches")


def match_exact(queries: DataFrame, entries: DataFrame, now: int, scope: str = "local", limit: int = 20, include_response: bool = True, dealt: bool = False) -> DataFrame:
    """A row for each query (query_id, tool_name, tool_input): supported, matched, reusable, reason, key and policy, history, and the response if it may be reused. dealt: as in with_facts."""
    calls = exact_call(with_facts(queries.select("query_id", "tool_name", "tool_input"), scope, parts=("key",), dealt=dealt)).select("query_id", "exact.*").withColumnRenamed("reason", "policy_reason")
    found = match_keys(calls.where("exact_key is not null").select("query_id", "exact_key", "replayable"), entries, now, limit).drop("exact_key", "replayable")
    out = calls.join(found, "query_id", "left").withColumn("supported", F.col("exact_key").isNotNull())
    for c in ("matched", "reusable"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    out = out.withColumn("reason", F.coalesce("reason", F.lit(UNSUPPORTED_EXACT))).withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    if include_response:
        reused = out.where("reusable").select("query_id", F.col("selected.record_key").alias("record_key"))
        responses = entries.select("record_key", "tool_input", "tool_response").join(reused, "record_key").drop("record_key")
        out = out.join(responses, "query_id", "left")
    return out


def candidates_of(entries: DataFrame, candidate_k: int, now: int, fresh_only: bool = True) -> DataFrame:
    """The newest successful entries of each block, at most candidate_k, and of these the fresh ones.

    The bound comes first: stale entries use it up. It does not depend on the query, so it is applied once for all queries.
    """
    block = ["cache_scope", "embedding_provider", "embedding_index", "operation_kind", "semantic_version"]
    newest = first_per_group(entries.where("success"), block, [F.desc("ended_at"), F.asc("record_key")], candidate_k, "recency_rank")
    return newest.where(policy.is_fresh(F.col("expires_at_epoch"), F.lit(now))) if fresh_only else newest


def score_candidates(pairs: DataFrame, query_vectors: DataFrame, dense_weight: float = 0.8, lexical_weight: float = 0.2) -> DataFrame:
    """pairs (query_id, query_text, query_metadata and an entry) with dense, lexical, boost and hybrid scores and the hybrid rank.

    query_vectors (query_id, query_vector) come in after the lexical scores, in one place of the plan: a query is embedded once.
    """
    scored = bm25_of_bounded(pairs, "query_text", "semantic_text", ["query_id"]).join(query_vectors, "query_id")
    dense = vectors.cosine(F.col("query_vector"), F.col("embedding"))
    boost = vectors.metadata_boost(F.col("query_metadata"), F.col("metadata"))
    scored = scored.withColumn("dense_score", dense).withColumn("metadata_boost", boost).drop("query_vector")
    scored = scored.withColumn("hybrid_score", vectors.hybrid(F.col("dense_score"), F.col("lexical_score"), F.col("metadata_boost"), dense_weight, lexical_weight))
    return first_per_group(scored, ["query_id"], [F.desc("hybrid_score"), F.asc("recency_rank")], 1 << 30, "hybrid_rank")


def rerank(scored: DataFrame, reranker: Reranker, top_n: int = 10) -> DataFrame:
    """scored with rerank_score for the first top_n candidates of each query.

    A query's candidates, which are bounded, are gathered in order; the model sees its text and theirs once, and the plan below is read once.
    """

    @F.arrow_udf("array<double>")
    def scores(query: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for q, documents in zip(query.to_pylist(), texts.to_pylist(), strict=True):
            found = reranker.score(q, documents) if documents else []
            if len(found) != len(documents):
                raise ValueError("Reranker returned the wrong number of scores")
            out.append([float(x) for x in found])
        return pa.array(out, pa.list_(pa.float64()))

    rest = [c for c in scored.columns if c != "hybrid_rank"]
    one = F.struct("hybrid_rank", *(F.col(f"`{c}`") for c in rest))
    groups = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["hybrid_rank"] - b["hybrid_rank"]).alias("__all"))
    head = F.transform(F.slice("__all", 1, top_n), lambda x: x["semantic_text"])
    groups = groups.withColumn("__scores", scores(F.element_at("__all", 1)["query_text"], head))
    each = groups.select("__scores", F.posexplode("__all").alias("__at", "__one"))
    return each.select("__one.*", F.get("__scores", F.col("__at")).alias("rerank_score")).select(*scored.columns, "rerank_score")


def accepted(scored: DataFrame, min_score: float = 0.65, top_k: int = 5) -> DataFrame:
    """The candidates whose final score (the reranker's where there is one) reaches min_score, best first, at most top_k for each query."""
    final = scored.withColumn("final_score", F.coalesce("rerank_score", "hybrid_score"))
    return first_per_group(final.where(F.col("final_score") >= min_score), ["query_id"], [F.desc("final_score"), F.asc("hybrid_rank")], top_k)


def match_semantic(
    queries: DataFrame, entries: DataFrame, embedder: Embedder, now: int, scope: str, top_k: int = 5, candidate_k: int = 50, min_score: float = 0.65,
    dense_weight: float = 0.8, lexical_weight: float = 0.2, fresh_only: bool = True, include_response: bool = False, reranker: Reranker | None = None, rerank_top_n: int = 10, dealt: bool = False,
) -> DataFrame:
    """A row for each query (query_id, tool_name, tool_input): supported, matched, reason, text, candidate_count and candidates; reusable is always false."""
    if not scope.strip():
        raise ValueError("cache_scope must not be empty")
    if dense_weight < 0 or lexical_weight < 0 or dense_weight + lexical_weight <= 0:
        raise ValueError("dense and lexical weights must be non-negative with a positive sum")
    if top_k <= 0 or candidate_k <= 0:
        raise ValueError("top_k and candidate_k must be positive")
    calls = normalize_semantic(queries.select("query_id", "tool_name", "tool_input"), dealt=dealt).select("query_id", "semantic.*")
    fits = calls.where("semantic_text is not null")
    vectors_ = embedded(fits.select("query_id", "semantic_text"), "semantic_text", embedder, "query_vector", query=True).select("query_id", "query_vector")
    mine = fits.select("query_id", "operation_kind", "semantic_version", F.col("semantic_text").alias("query_text"), F.col("metadata").alias("query_metadata"))
    block = (F.col("cache_scope") == scope) & (F.col("embedding_provider") == embedder.provider_name) & (F.col("embedding_index") == embedder.index_id)
    pairs = mine.join(candidates_of(entries.where(block), candidate_k, now, fresh_only), ["operation_kind", "semantic_version"])
    broken = F.raise_error(F.lit("stored vector has another length than its index")).cast("boolean")
    pairs = pairs.where(F.when(F.size("embedding") != F.col("dimensions"), broken).otherwise(True))
    scored = score_candidates(pairs, vectors_, dense_weight, lexical_weight)
    scored = rerank(scored, reranker, rerank_top_n) if reranker else scored.withColumn("rerank_score", F.lit(None).cast("double"))
    judged = scored.withColumn("final_score", F.coalesce("rerank_score", "hybrid_score")).withColumn("ok", F.col("final_score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("ok"), F.desc("final_score"), F.asc("hybrid_rank"))
    ranked = judged.withColumn("rank", F.row_number().over(order))
    six = [F.bround(c, 6).alias(c) for c in ("dense_score", "lexical_score", "metadata_boost", "hybrid_score", "rerank_score", "final_score")]
    shown = ["rank", "record_key", "source_path", "tool_name", "operation_kind", "semantic_text", "metadata", *six, policy.is_fresh(F.col("expires_at_epoch"), F.lit(now)).alias("fresh"),
             "ended_at", "response_sha256", preview(F.col("response_text")).alias("response_preview")] + ["tool_response"] * include_response
    # of all candidates the number, of those that are accepted the first ones: one pass, as a query's candidates are bounded
    best = F.collect_list(F.when(F.col("ok") & (F.col("rank") <= top_k), F.struct(*shown)))
    lists = ranked.groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.array_sort(best, lambda a, b: a["rank"] - b["rank"]).alias("candidates"))
    out = calls.join(lists.withColumn("candidates", F.when(F.size("candidates") > 0, F.col("candidates"))), "query_id", "left")
    supported, matched = F.col("semantic_text").isNotNull(), F.col("candidates").isNotNull()
    reason = F.when(~supported, UNSUPPORTED_SEMANTIC).when(matched, CANDIDATES).otherwise(NO_CANDIDATE)
    return out.select(
        "query_id", supported.alias("supported"), matched.alias("matched"), F.lit(False).alias("reusable"), reason.alias("reason"), "semantic_version", "operation_kind", "semantic_text",
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "candidates",
    )
