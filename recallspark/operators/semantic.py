"""Calls as text: what a call is about, for retrieval of calls that are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import policy, text, urls
from recallspark.functions.documents import SEMANTIC_VERSION
from recallspark.operators.exact import SEARCH_TTL, exact_call, with_facts

MAX_PAGE_CHARS = 12_000
METADATA = (
    "struct<url:string,host:string,path:string,method:string,query:string,postprocess:string,new_tab:boolean,source_action:string,"
    "content_chars:bigint,indexed_content_chars:bigint,start_from_char:string,extract_links:boolean,domains:array<string>,recency:string>"
)
_FIELDS = [x.split(":")[0] for x in METADATA[7:-1].replace("array<string>", "array").split(",")]


def _metadata(**known: Column) -> Column:
    return F.struct(*(known.get(n, F.lit(None)).alias(n) for n in _FIELDS)).cast(METADATA)


def _pairs_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda q: F.concat(q["name"], F.lit(" "), q["value"])), " ")


def call_text(*parts: Column | str) -> Column:
    """The parts as one clean line without credentials."""
    return text.redact(text.clean(F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))))


def _url_operation(url: Column, search: str, other: str) -> Column:
    return F.when(policy.is_search_url(url), search).otherwise(other)


def semantic_call(calls: DataFrame, with_response: bool = False) -> DataFrame:
    """calls with facts and exact, and the column semantic: null if the call has no text, else struct(semantic_version,
    action_kind, operation_kind, semantic_text, metadata, freshness_class, ttl_seconds).

    With responses, calls that read the current page take URL and text from what was observed.
    """
    f, tool, r = F.col("facts"), F.col("tool_name"), F.col("facts.request")
    at, body = f["page"], f["body"]
    open_ = F.size(at["auth_scope"]) == 0
    kind = lambda default: F.coalesce(f["kind"], F.lit(default))

    def call(action: str, operation: Column, line: Column, metadata: Column, fresh: Column) -> Column:
        return F.struct(
            F.lit(SEMANTIC_VERSION).alias("semantic_version"), kind(action).alias("action_kind"), operation.alias("operation_kind"), line.alias("semantic_text"),
            metadata.alias("metadata"), fresh["freshness_class"].alias("freshness_class"), fresh["ttl_seconds"].alias("ttl_seconds"),
        )

    host = lambda x: x["host"]
    navigate = call(
        "BrowserNavigateAction", _url_operation(at["url"], "web_search_browser", "browser_page"),
        call_text("browser navigate web page", host(at), text.path_words(at["path"]), _pairs_text(at["pairs"])),
        _metadata(url=at["url"], host=host(at), path=at["path"], new_tab=f["new_tab"]), policy.freshness_for_url(at["url"]),
    )
    method = F.coalesce(r["method"], F.lit("GET"))
    curl = call(
        "TerminalAction", _url_operation(r["url"], "web_search_curl", "web_fetch_curl"),
        call_text("web fetch http", method, host(r), text.path_words(r["path"]), _pairs_text(r["query_pairs"]), r["postprocess_signature"]),
        _metadata(url=r["url"], host=host(r), path=r["path"], method=r["method"], query=F.to_json(urls.query_map(r["query_pairs"])), postprocess=r["postprocess_signature"]),
        policy.freshness_for_url(r["url"]),
    )
    query = text.clean(f["query"])
    always = F.struct(F.lit("search").alias("freshness_class"), F.lit(SEARCH_TTL).cast("long").alias("ttl_seconds"))
    search = call("SearchAction", F.lit("web_search"), text.redact(F.concat(F.lit("web search query "), query)), _metadata(query=query, domains=f["domains"], recency=f["recency"]), always)
    indexed = F.substring(body, 1, MAX_PAGE_CHARS)
    content = call(
        "BrowserGetContentAction", _url_operation(f["seen"], "web_search_browser", "browser_page"),
        call_text("browser web page content", host(at), text.path_words(at["path"]), _pairs_text(at["pairs"]), indexed),
        _metadata(url=at["url"], host=host(at), path=at["path"], source_action=tool, content_chars=F.length(body).cast("long"), indexed_content_chars=F.length(indexed).cast("long"),
                  start_from_char=f["start_from_char"], extract_links=f["extract_links"]),
        policy.freshness_for_url(at["url"]),
    )
    bare = (F.size(r["body_parts"]) == 0) & (F.size(r["auth_scope"]) == 0) & (F.size(r["secret_headers"]) == 0) & (F.size(r["side_effects"]) == 0)
    reads = r["exact_supported"] & r["replay_safe"] & r["method"].isin("GET", "HEAD") & bare
    operation = F.col("exact.operation_kind")
    found = (
        F.when((tool == "browser_navigate") & f["url"].isNotNull(), F.when(open_, navigate))
        .when(operation == "web_search_curl", curl)
        .when(operation == "web_search", search)
        .when((tool == "terminal") & reads, curl)
        .when(F.lit(with_response) & tool.isin("browser_get_content", "browser_get_state") & at.isNotNull() & open_, content)
    )
    return calls.withColumn("semantic", F.when(f["valid"], found))


def normalize_semantic(calls: DataFrame, scope: Column | str = "local", dealt: bool = False) -> DataFrame:
    """calls (tool_name, tool_input) with their semantic call."""
    return semantic_call(exact_call(with_facts(calls, scope, parts=("key",), dealt=dealt))).drop("facts", "exact")


def normalize_semantic_records(records: DataFrame, scope: Column | str = "local") -> DataFrame:
    """records (tool_name, tool_input, tool_response) with their semantic call, from observations where the call has no URL. Observations are large, so records stay in their tasks."""
    return semantic_call(exact_call(with_facts(records, scope, True, ("key", "page"), True)), True).drop("facts", "exact")
