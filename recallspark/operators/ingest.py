"""From records to entries of the two indexes, and reports of what was imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import policy
from recallspark.operators.exact import exact_call, with_facts
from recallspark.operators.semantic import semantic_call
from recallspark.sources.embedders import Embedder, embedded

BATCH = 32


def _judged(records: DataFrame, scope: Column | str, trust_legacy: bool) -> DataFrame:
    """records with origin, status and observed_at_epoch. Cheap gates come first: only calls of trusted origin are parsed."""
    origin = policy.origin_status(F.col("execution_source"), F.col("source_is_text"), F.col("legacy_fields"), trust_legacy)
    rows = records.withColumn("origin", origin)
    rows = rows.withColumn("whole", F.col("tool_name").isNotNull() & F.col("tool_input").isNotNull() & F.col("tool_response").isNotNull())
    parse = F.col("origin.ok") & F.col("whole")
    rows = with_facts(rows.withColumn("__call", F.col("tool_input")).withColumn("tool_input", F.when(parse, F.col("tool_input"))), scope, True, ("key", "safe", "response"), True)
    f = F.col("facts")
    status = policy.response_status(f["response_kind"], f["is_error"], f["timeout"], f["exit_code"], F.col("tool_name"))
    return rows.drop("__call").withColumn("status", status).withColumn("observed_at_epoch", policy.iso_epoch(F.col("ended_at")))


def exact_records(records: DataFrame, scope: Column | str = "local", trust_legacy: bool = False) -> DataFrame:
    """records with their exact call and outcome: imported, or why not (origin, invalid, unsupported, broken_url, secret_response)."""
    rows = exact_call(_judged(records, scope, trust_legacy))
    outcome = (
        F.when(~F.col("whole"), "invalid").when(~F.col("origin.ok"), "origin").when(F.coalesce(F.col("facts.broken_url"), F.lit(False)), "broken_url")
        .when(F.col("exact").isNull(), "unsupported").when(~F.col("facts.response_clean"), "secret_response").otherwise("imported")
    )
    return rows.withColumn("outcome", outcome)


def exact_entries(judged: DataFrame) -> DataFrame:
    """Entries of the imported ones among exact_records, with seq."""
    f, e = F.col("facts"), F.col("exact")
    return judged.where("outcome = 'imported'").select(
        "seq", F.coalesce("record_key", "whole_key").alias("record_key"), "source_path", "cache_scope", e["key_version"].alias("key_version"), e["exact_key"].alias("exact_key"), "tool_name",
        e["action_kind"].alias("action_kind"), e["operation_kind"].alias("operation_kind"), e["canonical_json"].alias("canonical_json"), e["freshness_class"].alias("freshness_class"),
        e["ttl_seconds"].alias("ttl_seconds"), e["replayable"].alias("replayable"), e["replay_policy"].alias("replay_policy"), e["reason"].alias("policy_reason"), "started_at", "ended_at",
        "observed_at_epoch", policy.expiry(F.col("observed_at_epoch"), e["ttl_seconds"]).alias("expires_at_epoch"), F.col("status.ok").alias("success"), F.col("status.reason").alias("status_reason"),
        f["safe_input"].alias("tool_input"), f["safe_response"].alias("tool_response"), f["response_text"].alias("response_text"), F.sha2(f["response_text"], 256).alias("response_sha256"),
        "source_record", F.current_timestamp().alias("imported_at"),
    )


def semantic_records(records: DataFrame, scope: Column | str, trust_legacy: bool = False) -> DataFrame:
    """records with their semantic call and outcome: imported, invalid (also by origin) or unsupported."""
    rows = semantic_call(exact_call(_judged(records, scope, trust_legacy)), True)
    outcome = F.when(~F.col("whole") | ~F.col("origin.ok"), "invalid").when(F.col("semantic").isNull(), "unsupported").otherwise("imported")
    return rows.withColumn("outcome", outcome)


def semantic_entries(judged: DataFrame, embedder: Embedder, batch_size: int = BATCH) -> DataFrame:
    """Entries of the imported ones among semantic_records, embedded, with seq. Responses are stored without credentials."""
    f, s = F.col("facts"), F.col("semantic")
    rows = embedded(judged.where("outcome = 'imported'").withColumn("__text", s["semantic_text"]), "__text", embedder, "__vector", batch_size)
    return rows.select(
        "seq", "cache_scope", F.coalesce("record_key", F.sha2("__text", 256)).alias("record_key"), "source_path", s["semantic_version"].alias("semantic_version"), "tool_name",
        s["action_kind"].alias("action_kind"), s["operation_kind"].alias("operation_kind"), F.col("__text").alias("semantic_text"), s["metadata"].alias("metadata"),
        F.lit(embedder.provider_name).alias("embedding_provider"), F.lit(embedder.index_id).alias("embedding_index"), F.col("__vector").cast("array<float>").alias("embedding"),
        F.size("__vector").alias("dimensions"), s["freshness_class"].alias("freshness_class"), s["ttl_seconds"].alias("ttl_seconds"), "started_at", "ended_at", "observed_at_epoch",
        policy.expiry(F.col("observed_at_epoch"), s["ttl_seconds"]).alias("expires_at_epoch"), F.col("status.ok").alias("success"), F.col("status.reason").alias("status_reason"),
        f["safe_input"].alias("tool_input"), f["safe_response"].alias("tool_response"), f["safe_text"].alias("response_text"), F.sha2(f["safe_text"], 256).alias("response_sha256"),
        F.current_timestamp().alias("imported_at"),
    )


def report_counts(judged: DataFrame, call: str) -> DataFrame:
    """(counter, name, n): all counters of a report from one pass; call is the column of calls, exact or semantic."""
    ok = F.col("outcome") == "imported"
    tool = F.coalesce("tool_name", F.lit("invalid_record"))
    lost = tool if call == "exact" else F.when(F.col("outcome") == "invalid", "invalid_record").otherwise(tool)
    tools = tool if call == "exact" else F.when(F.col("outcome") != "invalid", tool)
    named = [
        ("total", F.lit("seen")), ("total", F.when(ok, "imported").otherwise("unsupported")), ("tool_counts", tools), ("imported_tool_counts", F.when(ok, tool)),
        ("unsupported_tool_counts", F.when(~ok, lost)), ("operation_counts", F.when(ok, F.col(f"{call}.operation_kind"))),
        ("status_counts", F.when(ok, F.when(F.col("status.ok"), "success").otherwise("failed"))), ("provenance_counts", F.col("origin.reason")), ("outcome_counts", F.col("outcome")),
    ]
    each = F.array(*(F.struct(F.lit(c).alias("counter"), n.alias("name")) for c, n in named))
    return judged.select(F.explode(each).alias("x")).select("x.*").where("name is not null").groupBy("counter", "name").agg(F.count("*").alias("n"))


def report(judged: DataFrame, call: str) -> dict:
    """The counters as a report: their names are bounded by tools and reasons, not by records."""
    out: dict = {k: {} for k in ("tool_counts", "imported_tool_counts", "unsupported_tool_counts", "operation_counts", "status_counts", "provenance_counts", "outcome_counts")}
    out = {"seen": 0, "imported": 0, "unsupported": 0} | out
    for r in report_counts(judged, call).collect():
        (out if r["counter"] == "total" else out[r["counter"]])[r["name"]] = r["n"]
    return out
