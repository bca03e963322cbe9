"""URL functions as Catalyst expressions.

The generic grammar of RFC 3986 is one regular expression per part, as parse_url gives up on characters that URLs in
logs do hold. Query strings are decoded and encoded again pair by pair, in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.fixed import HIDDEN, SECRET_QUERY_KEY, SENSITIVE_QUERY_KEYS, SPACE

_GRAMMAR = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PAIR = "struct<name:string,value:string>"
_SCOPE = "struct<kind:string,name:string,scope_required:string>"


def parts(url: Column) -> Column:
    """struct(scheme, authority, host, port, path, query, fragment, has_user); host is in lower case, port null if none or not valid."""
    get = lambda k: F.regexp_extract(url, _GRAMMAR, k)
    authority = get(2)
    place = F.regexp_replace(authority, "^.*@", "")
    bracketed = F.startswith(place, F.lit("["))
    host = F.when(bracketed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(place, ":", 1))
    port = F.when(bracketed, F.regexp_extract(place, r"\]:([0-9]+)$", 1)).otherwise(F.regexp_extract(place, r"^[^:]*:([0-9]+)$", 1))
    port = port.try_cast("int")
    user = F.regexp_extract(authority, "^(.*)@", 1)
    return F.struct(
        F.lower(get(1)).alias("scheme"), authority.alias("authority"), F.lower(host).alias("host"), F.when(port.between(0, 65535), port).alias("port"),
        get(3).alias("path"), get(4).alias("query"), get(5).alias("fragment"), (~user.isin("", ":")).alias("has_user"),
    )


def decode(x: Column) -> Column:
    """Form decoding; a per cent sign that begins no escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), F.replace(x, F.lit("+"), F.lit(" ")))


def encode(x: Column) -> Column:
    """Form encoding that keeps letters, digits and _ . - ~ only."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Decoded pairs of a query string in order, blank values kept."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: decode(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.contains(p, F.lit("=")), decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("")
    return F.transform(pieces, lambda p: F.struct(name(p).alias("name"), value(p).alias("value")))


def query_map(pairs: Column) -> Column:
    """The values of each name as an array, names in order."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    values = F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]))
    return F.map_from_arrays(names, values)


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"]))), "&")


def canonical(url: Column) -> Column:
    """struct(url, scheme, host, path, query, pairs, auth_scope) of an absolute HTTP(S) URL, else null.

    Scheme and host in lower case; no default or invalid port, user information or fragment; values of secret query keys
    are replaced. auth_scope names the secrets that were there.
    """
    url = F.regexp_replace(F.regexp_replace(url, f"^[{SPACE}]+|[{SPACE}]+$", ""), "[.,]+$", "")
    p = parts(F.regexp_replace(url, "[\t\r\n]", ""))
    default = F.when(p["scheme"] == "http", 80).otherwise(443)
    host = F.when(F.contains(p["host"], F.lit(":")), F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"])
    place = F.when((p["port"] > 0) & (p["port"] != default), F.concat(host, F.lit(":"), p["port"].cast("string"))).otherwise(host)
    secret = lambda q: q["name"].rlike(SECRET_QUERY_KEY)
    raw = query_pairs(p["query"])
    pairs = F.transform(raw, lambda q: F.struct(q["name"].alias("name"), F.when(secret(q), HIDDEN).otherwise(q["value"]).alias("value")))
    nothing = F.lit(None).cast("string")
    scope = F.transform(F.filter(raw, secret), lambda q: F.struct(F.lit("url_query_secret").alias("kind"), F.lower(q["name"]).alias("name"), nothing.alias("scope_required")))
    user = F.when(p["has_user"], F.array(F.struct(F.lit("url_userinfo").alias("kind"), nothing.alias("name"), F.lit("true").alias("scope_required"))))
    scope = F.concat(scope, F.coalesce(user, F.array().cast(f"array<{_SCOPE}>")))
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    query = encode_pairs(pairs)
    whole = F.concat(p["scheme"], F.lit("://"), place, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    found = F.struct(whole.alias("url"), p["scheme"].alias("scheme"), p["host"].alias("host"), path.alias("path"), query.alias("query"), pairs.alias("pairs"), scope.alias("auth_scope"))
    return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), found)


def redacted(url: Column) -> Column:
    """A URL without user information and with the values of sensitive query keys replaced; other text as it is."""
    p = parts(url)
    sensitive = lambda q: F.trim(F.regexp_replace(F.lower(q["name"]), "[^a-z0-9]+", "_"), F.lit("_")).isin(*SENSITIVE_QUERY_KEYS)
    pairs = F.transform(query_pairs(p["query"]), lambda q: F.struct(q["name"].alias("name"), F.when(sensitive(q), HIDDEN).otherwise(q["value"]).alias("value")))
    query = encode_pairs(pairs)
    port = F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"].cast("string"))).otherwise("")
    out = F.concat(p["scheme"], F.lit("://"), p["host"], port, p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
                   F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""))
    return F.when(url.rlike("^https?://"), out).otherwise(url)
