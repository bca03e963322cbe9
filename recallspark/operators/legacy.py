"""The older description of calls: one key for any tool, an intent text, and a freshness class judged by words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions import policy
from recallspark.operators.exact import with_facts


def normalize_calls(calls: DataFrame) -> DataFrame:
    """calls (tool_name, tool_input) with the column normalized: struct(canonical_key, kind, intent_text, fingerprint as JSON,
    freshness_class, ttl_seconds, cacheable, reason); null where the input is no object or its command names a broken URL.

    A terminal's command that fetches a URL is known by the request and what is done with the response, other commands by
    their words, searches by their plain query, all else by its input.
    """
    rows = with_facts(calls, parts=("legacy",))
    f = F.col("facts")
    old = f["legacy"]
    fresh = policy.freshness_for_text(old["haystack"], old["kind"])
    found = F.struct(
        f["generic_key"].alias("canonical_key"), old["kind"].alias("kind"), old["intent"].alias("intent_text"), old["fingerprint"].alias("fingerprint"),
        fresh["freshness_class"].alias("freshness_class"), fresh["ttl_seconds"].alias("ttl_seconds"), F.lit(True).alias("cacheable"), F.lit(None).cast("string").alias("reason"),
    )
    return rows.withColumn("normalized", F.when(f["valid"] & ~f["broken_url"], found)).drop("facts", "cache_scope")
