"""Codes, names and messages: the string rules of the connectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First two digits of supported six-digit codes.
SHARE_PREFIXES = ("00", "30", "60", "68", "90", "92")
#: The longest summary, the shortest run that is taken for a token, what is put in place of a secret.
LIMIT, TOKEN, HIDDEN = 300, 24, "[REDACTED]"
#: Names after which a secret stands.  What an authorization header holds may have spaces and ends at a delimiter.
SECRETS = r"refresh[_-]?token|access[_-]?token|token|password|secret|api[_-]?key"
_TOKEN_MARKS = r"[A-Za-z0-9._~+/=-]"


def padded_code(x: Column) -> Column:
    return F.lpad(F.regexp_replace(F.trim(x.cast("string")), r"\.0$", ""), 6, "0")


def strict_code(x: Column) -> Column:
    """Six digits, with or without an exchange suffix; anything else is missing."""
    out = F.regexp_extract(F.upper(F.trim(x.cast("string"))), r"^(\d{6})(?:\.(?:SH|SZ|BJ))?$", 1)
    return F.when(out != "", out)


def is_share(code: Column) -> Column:
    return F.substring(code, 1, 2).isin(*SHARE_PREFIXES)


def exchange(code: Column, ninety_two: str = "BJ") -> Column:
    """Exchange of a code.  Two rules are in use; they differ on codes that begin with 92."""
    first, two = F.substring(code, 1, 1), F.substring(code, 1, 2)
    return F.when(two == "92", ninety_two).when(first.isin("6", "9"), "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")


def with_suffix(code: Column, ninety_two: str = "BJ") -> Column:
    return F.concat(code, F.lit("."), exchange(code, ninety_two))


def is_special_treatment(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)^\*?ST"), F.lit(False))


def extracted_ticker(x: Column) -> Column:
    out = F.regexp_extract(x, r"(\d{6})", 1)
    return F.when(out != "", out)


def _hide_after(message: Column, names: str, value: str) -> Column:
    """``name: value`` with the value hidden; in quotes it ends with them.  What is hidden already stays, so hiding twice is hiding once."""
    name = rf"""(["']?\b(?:{names})\b["']?\s*[:=]\s*)"""
    return F.regexp_replace(message, rf"""(?i){name}(?:\[REDACTED\]|"[^"]*"|'[^']*'|{value})""", f"$1{HIDDEN}")


def redacted(message: Column, limit: int = LIMIT, secrets: Sequence[str] = ()) -> Column:
    """Known secrets, credentials, bearer tokens and token-like strings hidden, white space folded, length limited."""
    out = message
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit(HIDDEN))
    out = _hide_after(out, "authorization", r"[^,;}\]\r\n]+")
    out = _hide_after(out, SECRETS, r"(?:bearer\s+)?[^\s,;}\]]+")
    out = F.regexp_replace(out, rf"(?i)\bbearer\s+{_TOKEN_MARKS}+", f"Bearer {HIDDEN}")
    out = F.regexp_replace(out, rf"(?<!{_TOKEN_MARKS}){_TOKEN_MARKS}{{{TOKEN},}}", HIDDEN)
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, limit)
