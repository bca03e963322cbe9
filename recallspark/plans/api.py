"""The library interface: imports, matches and statistics by path."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators import ingest, match, stats
from recallspark.operators.exact import exact_call, with_facts
from recallspark.sources.embedders import Embedder, Reranker
from recallspark.sources.records import BROKEN, broken_line, log_path, read_records
from recallspark.sources.tables import exact_table, semantic_table


def _rebuild(table, judged: DataFrame, entries: DataFrame, slice_, call: str, path: str) -> dict:
    try:
        table.rebuild(entries, slice_)
    except Exception as e:
        if BROKEN in str(e) and (where := broken_line(table.spark, path)):
            raise ValueError(f"{BROKEN} at {where}") from e
        raise
    return ingest.report(judged, call)


def ingest_exact_records(spark: SparkSession, records_path: str, table_path: str, cache_scope: str = "local", trust_legacy_origins: bool = False) -> dict:
    """Replaces what the table holds of this log by the log's records; the report of what was imported."""
    records = read_records(spark, records_path)
    judged = ingest.exact_records(records, cache_scope, trust_legacy_origins).persist()
    try:
        source = log_path(records_path, spark)
        out = _rebuild(exact_table(spark, table_path), judged, ingest.exact_entries(judged), F.col("source_path") == source, "exact", records_path)
        return {"source": source, **out, "cache_scope": cache_scope, "trust_legacy_origins": trust_legacy_origins, "database": exact_stats(spark, table_path)}
    finally:
        judged.unpersist()


def ingest_semantic_records(spark: SparkSession, records_path: str, table_path: str, embedder: Embedder, cache_scope: str, trust_legacy_origins: bool = False, batch_size: int = ingest.BATCH) -> dict:
    """Replaces what the table holds of this log in this scope and index by the log's records; the report of what was imported."""
    if not cache_scope.strip():
        raise ValueError("cache_scope must not be empty")
    records = read_records(spark, records_path)
    judged = ingest.semantic_records(records, cache_scope, trust_legacy_origins).persist()
    try:
        source = log_path(records_path, spark)
        own = (F.col("source_path") == source) & (F.col("cache_scope") == cache_scope) & (F.col("embedding_provider") == embedder.provider_name) & (F.col("embedding_index") == embedder.index_id)
        out = _rebuild(semantic_table(spark, table_path), judged, ingest.semantic_entries(judged, embedder, batch_size), own, "semantic", records_path)
        names = {"embedding_provider": embedder.provider_name, "embedding_model": embedder.model_id, "embedding_index_id": embedder.index_id}
        return {"source": source, **out, **names, "cache_scope": cache_scope, "trust_legacy_origins": trust_legacy_origins, "database": semantic_stats(spark, table_path, cache_scope)}
    finally:
        judged.unpersist()


def _one(spark: SparkSession, tool_name: str, tool_input: dict) -> DataFrame:
    return spark.createDataFrame([(0, tool_name, json.dumps(tool_input, ensure_ascii=False))], "query_id long, tool_name string, tool_input string")


def match_exact(spark: SparkSession, table_path: str, tool_name: str, tool_input: dict, now_epoch: int | None = None, include_response: bool = True, limit: int = 20, cache_scope: str = "local") -> dict:
    """The answer for one call, as a document; batches of calls go through operators.match."""
    now = int(time.time()) if now_epoch is None else now_epoch
    entries = exact_table(spark, table_path).read()
    key = exact_call(with_facts(_one(spark, tool_name, tool_input), cache_scope, parts=("key",), dealt=True)).select("exact.exact_key").first()[0]
    entries = entries.where(F.col("exact_key") == F.lit(key))  # goes down to the files, which are in order of the key
    row = match.match_exact(_one(spark, tool_name, tool_input), entries, now, cache_scope, limit, include_response, True).first().asDict(True)
    if not row["supported"]:
        return {k: row[k] for k in ("supported", "matched", "reusable", "reason")}
    out = {k: row[k] for k in ("supported", "matched", "reusable", "reason", "exact_key", "key_version", "operation_kind")}
    out["canonical"] = json.loads(row["canonical_json"])
    out["query_policy"] = {k: row[k] for k in ("freshness_class", "ttl_seconds", "replayable", "replay_policy")}
    hide = ("choice", "history_rank", "policy_reason")
    shown = lambda e: e and {k: v for k, v in e.items() if k not in hide}
    out |= {"match_count": row["match_count"], "selected": shown(row["selected"]), "matches": [shown(e) for e in row["matches"] or []]}
    if include_response and row["reusable"]:
        out["tool_response"] = json.loads(row["tool_response"])
    return out


def match_semantic(spark: SparkSession, table_path: str, tool_name: str, tool_input: dict, embedder: Embedder, cache_scope: str, now_epoch: int | None = None, reranker: Reranker | None = None, include_response: bool = False, **options) -> dict:
    now = int(time.time()) if now_epoch is None else now_epoch
    queries = _one(spark, tool_name, tool_input)
    entries = semantic_table(spark, table_path).read()
    row = match.match_semantic(queries, entries, embedder, now, cache_scope, reranker=reranker, include_response=include_response, dealt=True, **options).first().asDict(True)
    row["candidates"] = row["candidates"] or []
    if not row["supported"]:
        return {k: row[k] for k in ("supported", "matched", "reusable", "reason", "candidates")}
    for c in row["candidates"]:
        c["metadata"] = {k: v for k, v in c["metadata"].items() if v is not None}
        if include_response:
            c["tool_response"] = json.loads(c["tool_response"])
    names = {"cache_scope": cache_scope, "embedding_provider": embedder.provider_name, "embedding_model": embedder.model_id, "embedding_index_id": embedder.index_id}
    return {k: v for k, v in row.items() if k != "query_id"} | names | {"reranker_model": reranker.model_id if reranker else None}


def exact_stats(spark: SparkSession, table_path: str, scope: str | None = None) -> dict:
    rows = [r.asDict() for r in stats.exact_stats(exact_table(spark, table_path).read(), scope).collect()]
    return {"total": sum(r["count"] for r in rows), "operations": rows}


def semantic_stats(spark: SparkSession, table_path: str, scope: str) -> dict:
    rows = [r.asDict() for r in stats.semantic_stats(semantic_table(spark, table_path).read(), scope).collect()]
    return {"cache_scope": scope, "total": sum(r["count"] for r in rows), "indexes": rows}
