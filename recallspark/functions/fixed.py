"""Fixed values that expressions and Arrow functions share: patterns, names and marks that results depend on.

Two regular-expression engines read the patterns of credentials. They differ in what counts as white space and as the
edge of a word, so a pattern is made for an engine from these two.
"""

from __future__ import annotations

#: Characters that count as white space in texts, for a character class of the JVM.
SPACE = "".join(f"\\u{c:04x}" for c in range(0x10000) if chr(c).isspace())
#: Ideographs that tokens are made of one by one.
HAN = "[㐀-鿿]"
HIDDEN = "<redacted>"
#: Names of secrets: parts of field names, fields, headers, query keys.
SECRET_FIELD_PARTS = ("api_key", "apikey", "authorization", "cookie", "credential", "password", "secret", "token")
SENSITIVE_FIELDS = ("authorization", "cookie", "password", "passwd", "token", "access_token", "api_key", "apikey", "x_api_key")
SENSITIVE_HEADERS = ("authorization", "cookie", "x-api-key", "api-key")
SENSITIVE_QUERY_KEYS = ("api_key", "apikey", "access_token", "authorization", "auth", "cookie", "password", "secret", "token")
SECRET_QUERY_KEY = r"(?i)^(?:api[_-]?key|access[_-]?token|auth(?:orization)?|cookie|password|secret|token)$"
SEARCH_TOOLS = ("web_search", "browser_search", "search")


def secret_assignment(space: str) -> str:
    """A credential that follows its name; the name is group 1. space is the inside of a class of white space."""
    return (
        rf"(authorization[{space}]*[:=][{space}]*(?:bearer[{space}]+)?|cookie[{space}]*[:=][{space}]*|"
        rf"(?:api[_-]?key|access[_-]?token|password|secret|token)[{space}]*[:=][{space}]*)[^{space},;\"'}}]+"
    )


def secret_scheme(edge: str, space: str) -> str:
    """An authorisation value after its scheme; edge is a place where a word may begin."""
    return rf"{edge}(?:bearer|basic)[{space}]+[a-z0-9._~+/=-]+"


def secret_value(edge: str, end: str) -> str:
    """Tokens of known shapes."""
    return rf"(?:{edge}eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+{end}|{edge}(?:sk|ghp|github_pat)_[a-zA-Z0-9_-]{{8,}}{end})"
