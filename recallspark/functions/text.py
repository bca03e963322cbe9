"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.fixed import HAN, HIDDEN, SENSITIVE_QUERY_KEYS, SPACE, secret_assignment, secret_scheme, secret_value

#: The edges of words, and what a text's credentials look like, for the JVM.
_EDGE = r"(?<![\p{L}\p{N}_])"
_END = r"(?:(?<=[a-zA-Z0-9_])(?![\p{L}\p{N}_])|(?<=-)(?=[\p{L}\p{N}_]))"
SECRETS = ("(?iu)" + secret_assignment(SPACE), "(?iu)" + secret_scheme(_EDGE, SPACE), secret_value(_EDGE, _END))
#: Words that every credential's name or shape holds: a text without any of them needs no closer look.
CUES = "(?iu)authorization|cookie|api[_-]?key|token|password|secret|bearer|basic|eyj|sk_|ghp_|github_pat_"
URL = rf"(?i)https?://[^{SPACE}'\"<>]+"
TOKEN = r"[\p{L}\p{N}_]+|[./:@?&=+\-]"
PREVIEW_CHARS = 1200


def collapse(x: Column) -> Column:
    """x with each run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(x, f"[{SPACE}]+", " "))


def clean(x: Column) -> Column:
    return collapse(F.lower(x))


def query_text(x: Column) -> Column:
    """Lower case without URL schemes; what is not a letter of a-z, a digit or one of _ - . / : separates."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "https?://", " "), r"[^a-z0-9_\-./:]+", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def tokens(x: Column) -> Column:
    """Words and URL signs in order, then single Han characters, then pairs of neighbours among these."""
    low = F.lower(x)
    han = F.regexp_extract_all(low, F.lit(HAN), F.lit(0))
    pairs = F.zip_with(F.slice(han, 1, F.greatest(F.size(han) - 1, F.lit(0))), F.slice(han, 2, F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), han, pairs)


def redact(x: Column) -> Column:
    """x with credentials replaced: values of assignments, authorisation values, and tokens of known shapes."""
    out = x
    for pattern, by in zip(SECRETS, (f"$1{HIDDEN}", HIDDEN, HIDDEN), strict=True):
        out = F.regexp_replace(out, pattern, by)
    return F.when(x.rlike(CUES), out).otherwise(x)


def has_secret(x: Column) -> Column:
    """Whether x holds a credential; a URL also if it has user information or a value for a sensitive query key."""
    from recallspark.functions.urls import parts

    p = parts(x)
    key = lambda kv: F.trim(F.regexp_replace(F.lower(F.try_url_decode(kv[0])), "[^a-z0-9]+", "_"), F.lit("_"))
    pairs = F.transform(F.split(p["query"], "&"), lambda kv: F.split(kv, "=", 2))
    in_query = F.exists(pairs, lambda kv: (F.size(kv) == 2) & (F.get(kv, F.lit(1)) != "") & key(kv).isin(*SENSITIVE_QUERY_KEYS))
    in_url = F.substring(x, 1, 8).rlike("^https?://") & (p["has_user"] | in_query)
    in_text = x.rlike(CUES) & (x.rlike(SECRETS[0]) | x.rlike(SECRETS[1]) | x.rlike(SECRETS[2]))
    return in_text | F.coalesce(in_url, F.lit(False))


def path_words(x: Column) -> Column:
    return F.translate(x, "/-_.", "    ")


def first_block(x: Column, tag: str) -> Column:
    """What stands between the first <tag> and its </tag>, without white space at its ends; null if there is none."""
    found = F.regexp_extract(x, f"(?isu)<{tag}>[{SPACE}]*(.*?)[{SPACE}]*</{tag}>", 1)
    return F.when(x.rlike(f"(?isu)<{tag}>.*?</{tag}>"), F.regexp_replace(found, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def find_urls(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(URL), F.lit(0))


def preview(x: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(x, 1, chars)
