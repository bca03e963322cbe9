"""Exact calls: which calls have a key, the key, and the policy that comes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import policy
from recallspark.functions.batches import spread
from recallspark.functions.documents import KEY_VERSION, PARTS, facts

#: What a policy says for its reason.
SEARCH_REASON = "read-only web search response"
CURL_REASON = "pure curl response"
STATEFUL_REASON = "curl call is stateful, dynamic, authenticated, or has side effects"
NAVIGATE_REASON = "browser_navigate changes tab state and its observation does not contain page content"
SEARCH_TTL = 600


def with_facts(calls: DataFrame, scope: Column | str = "local", response: bool = False, parts: tuple[str, ...] = PARTS, dealt: bool = False) -> DataFrame:
    """calls (tool_name, tool_input[, tool_response] as JSON texts) with the columns facts, of which only parts are computed, and cache_scope.

    The work is dealt to all tasks first, unless the rows are dealt already or few.
    """
    calls = calls if dealt else spread(calls)
    scope = F.lit(scope) if isinstance(scope, str) else scope
    answer = F.col("tool_response") if response else None
    return calls.withColumn("cache_scope", scope).withColumn("facts", facts(F.col("tool_name"), F.col("tool_input"), answer, F.col("cache_scope"), parts))


def navigate_document(scope: Column, kind: Column, url: Column, new_tab: Column, auth_scope: Column) -> Column:
    """The canonical JSON of a browser's navigation; fields in order of their names."""
    auth = F.transform(auth_scope, lambda a: F.when(a["name"].isNull(), F.to_json(F.struct(a["kind"].alias("kind"), a["scope_required"].alias("scope_required")))).otherwise(F.to_json(F.struct(a["kind"].alias("kind"), a["name"].alias("name")))))
    before = F.to_json(F.struct(kind.alias("action_kind")))
    after = F.to_json(F.struct(
        scope.alias("cache_scope"), F.lit(KEY_VERSION).alias("key_version"), new_tab.alias("new_tab"), F.lit("web_search_browser").alias("operation_kind"),
        F.lit("browser_navigate").alias("tool_name"), url.alias("url"),
    ))
    return F.concat(F.regexp_replace(before, r"\}$", ""), F.lit(',"auth_scope":['), F.array_join(auth, ","), F.lit("],"), F.substring(after, 2, 1 << 30))


def curl_replayable(request: Column) -> Column:
    """Whether a request may be answered from history: it reads a search URL, sends nothing and changes nothing."""
    bare = (F.size(request["body_parts"]) == 0) & (F.size(request["auth_scope"]) == 0) & (F.size(request["secret_headers"]) == 0)
    return request["replay_safe"] & request["method"].isin("GET", "HEAD") & policy.is_search_url(request["url"]) & bare


def exact_call(calls: DataFrame) -> DataFrame:
    """calls with facts (with_facts) and the column exact: null if the call has no key, else struct(exact_key, key_version,
    action_kind, operation_kind, canonical_json, freshness_class, ttl_seconds, replayable, replay_policy, reason)."""
    f, tool = F.col("facts"), F.col("tool_name")
    p, r = f["page"], f["request"]
    fits = f["valid"] & (F.trim(F.col("cache_scope")) != "")
    search = policy.is_search_tool(tool) & ~f["secret_field"] & f["query"].isNotNull()
    curl = (tool == "terminal") & f["has_fetch"] & r["exact_supported"] & policy.is_search_url(r["url"])
    page_fits = (tool == "browser_navigate") & policy.is_search_url(p["url"])
    kind = lambda default: F.coalesce(f["kind"], F.lit(default))

    def call(operation: str, action: str, document: Column, fresh: Column, replayable: Column, reason: Column) -> Column:
        return F.struct(
            F.sha2(document, 256).alias("exact_key"), F.lit(KEY_VERSION).alias("key_version"), kind(action).alias("action_kind"), F.lit(operation).alias("operation_kind"),
            document.alias("canonical_json"), fresh["freshness_class"].alias("freshness_class"), fresh["ttl_seconds"].alias("ttl_seconds"), replayable.alias("replayable"),
            F.when(replayable, "response").otherwise("match_only").alias("replay_policy"), reason.alias("reason"),
        )

    always = F.struct(F.lit("search").alias("freshness_class"), F.lit(SEARCH_TTL).cast("long").alias("ttl_seconds"))
    pure = F.coalesce(curl_replayable(r), F.lit(False))
    document = navigate_document(F.col("cache_scope"), kind("BrowserNavigateAction"), p["url"], f["new_tab"], p["auth_scope"])
    found = (
        F.when(fits & curl, call("web_search_curl", "TerminalAction", f["curl_json"], policy.freshness_for_url(r["url"]), pure, F.when(pure, CURL_REASON).otherwise(STATEFUL_REASON)))
        .when(fits & page_fits, call("web_search_browser", "BrowserNavigateAction", document, policy.freshness_for_url(p["url"]), F.lit(False), F.lit(NAVIGATE_REASON)))
        .when(fits & search, call("web_search", "SearchAction", f["search_json"], always, F.lit(True), F.lit(SEARCH_REASON)))
    )
    return calls.withColumn("exact", found)


def normalize_exact(calls: DataFrame, scope: Column | str = "local") -> DataFrame:
    """calls (tool_name, tool_input) with their exact call."""
    return exact_call(with_facts(calls, scope, parts=("key",))).drop("facts")
