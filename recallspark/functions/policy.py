"""Policies as Catalyst expressions: freshness, provenance, status and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.fixed import SEARCH_TOOLS

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: Patterns, classes and lifetimes in seconds; the first class that fits holds.
SEARCH_URL = r"(?iu)(?:/search(?:/|\?|$)|[?&](?:q|query|search_query)=|google\.|bing\.|duckduckgo\.)"
URL_CLASSES = (
    ("volatile", 300, rf"(?iu){_B}(latest|current|today|now|recent|news|price|stock|weather|score|trending|release){_E}"),
    ("search", 600, SEARCH_URL),
    ("immutable", 2_592_000, r"(?iu)(?:/commit/[0-9a-f]{7,40}(?:/|$)|/raw/[0-9a-f]{40}/|arxiv\.org/(?:abs|pdf)/[0-9]{4}\.[0-9]+)"),
    ("static", 604_800, r"(?iu)(?:raw\.githubusercontent\.com|github\.com/.+/(?:blob|raw)/|\.md$|\.txt$|\.json$|\.ya?ml$|\.pdf$|/docs?/|readme)"),
)
URL_DEFAULT = ("web", 21_600)
TEXT_CLASSES = (
    ("volatile", 300, rf"(?iu){_B}(latest|current|today|tonight|tomorrow|yesterday|now|recent|news|breaking|price|stock|weather|sports|score|schedule|leaderboard|trending|release){_E}"),
    ("search", 600, rf"(?iu){_B}(search|query|google|bing|duckduckgo|arxiv\.org/search|github\.com/search){_E}"),
    ("static_web", 86_400, r"(?iu)(raw\.githubusercontent\.com|/raw/|\.md$|\.txt$|\.json$|\.yaml$|\.yml$)"),
)
OBSERVATIONS = ("BrowserObservation", "FileEditorObservation", "FinishObservation", "SearchObservation", "TerminalObservation", "ThinkObservation", "ToolObservation")


def _classified(x: Column, classes: tuple, default: Column, default_ttl: Column) -> Column:
    name, ttl = default, default_ttl
    for label, seconds, pattern in reversed(classes):
        name, ttl = F.when(x.rlike(pattern), label).otherwise(name), F.when(x.rlike(pattern), seconds).otherwise(ttl)
    return F.struct(name.alias("freshness_class"), ttl.cast("long").alias("ttl_seconds"))


def is_search_url(url: Column) -> Column:
    return url.rlike(SEARCH_URL)


def freshness_for_url(url: Column) -> Column:
    """struct(freshness_class, ttl_seconds) of a canonical URL."""
    return _classified(url, URL_CLASSES, F.lit(URL_DEFAULT[0]), F.lit(URL_DEFAULT[1]))


def freshness_for_text(haystack: Column, kind: Column) -> Column:
    """The older policy, over an intent text with URL, host, path and query; kind is curl, web_search or another."""
    web = kind.isin("curl", "web_search")
    return _classified(haystack, TEXT_CLASSES, F.when(web, "web").otherwise("generic"), F.when(web, 3_600).otherwise(86_400))


def is_search_tool(tool: Column) -> Column:
    return F.lower(tool).isin(*SEARCH_TOOLS)


def _quoted(x: Column) -> Column:
    """x in the quotes that reasons show."""
    return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def origin_status(source: Column, is_text: Column, legacy_fields: Column, trust_legacy: bool = False) -> Column:
    """struct(ok, reason): executions by the tool itself; records without a source only if old records are trusted and have their fields.

    source is the value of execution_source as text (null: none), is_text whether it is a string.
    """
    other = F.concat(F.lit("execution_source="), F.when(is_text, _quoted(source)).otherwise(source), F.lit(" is not an origin"))
    legacy = F.lit(trust_legacy) & F.coalesce(legacy_fields, F.lit(False))
    own = F.coalesce((source == "tool") & is_text, F.lit(False))
    return F.struct(
        (own | (source.isNull() & legacy)).alias("ok"),
        F.when(own, "trusted tool origin").when(source.isNotNull(), other).when(legacy, "trusted legacy tool origin").otherwise("missing trusted execution provenance").alias("reason"),
    )


def response_status(kind: Column, is_error: Column, timeout: Column, exit_code: Column, tool: Column) -> Column:
    """struct(ok, reason) of an observation. is_error, timeout and exit_code are JSON texts (null: missing); kind is null unless it is a string."""
    expected = (
        F.when(tool == "terminal", F.array(F.lit("TerminalObservation")))
        .when(F.startswith(tool, F.lit("browser_")), F.array(F.lit("BrowserObservation")))
        .when(tool.isin(*SEARCH_TOOLS), F.array(F.lit("SearchObservation"), F.lit("ToolObservation")))
    )
    code = F.when(exit_code == "null", None).otherwise(exit_code)
    whole = code.rlike("^-?[0-9]+$") | code.isin("true", "false")  # a boolean is a number here
    shown = F.when(code == "true", "True").when(code == "false", "False").otherwise(code)
    reason = (
        F.when(~F.coalesce(kind.isin(*OBSERVATIONS), F.lit(False)), "missing or unrecognized observation kind")
        .when(expected.isNotNull() & ~F.array_contains(expected, kind), F.concat(F.lit("observation kind "), _quoted(kind), F.lit(" does not match tool "), _quoted(tool)))
        .when(~F.coalesce(is_error == "false", F.lit(False)), "tool_response.is_error is not explicitly false")
        .when(F.coalesce(timeout == "true", F.lit(False)), "tool_response.timeout=true")
        .when(code.isNotNull() & ~whole, "tool_response.exit_code is not an integer")
        .when(code.isNotNull() & ~code.rlike("^(-?0+|false)$"), F.concat(F.lit("exit_code="), shown))
        .otherwise("success")
    )
    return F.struct((reason == "success").alias("ok"), reason.alias("reason"))


def iso_epoch(x: Column) -> Column:
    """Seconds of an ISO-8601 time, extended or basic, UTC where it names no zone; null if it is none."""
    basic = [F.try_to_timestamp(x, F.lit(f)) for f in ("yyyyMMdd'T'HHmmssX", "yyyyMMdd'T'HHmmss")]
    dated = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(x))
    return F.unix_seconds(F.coalesce(dated, *basic))


def expiry(observed: Column, ttl: Column) -> Column:
    return observed + ttl


def is_fresh(expires: Column, now: Column) -> Column:
    return F.coalesce(expires > now, F.lit(False))
