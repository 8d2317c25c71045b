"""Redaction and identifier gate with their conditional exemptions: an Arrow-batched UDF each, as native replacement cannot
decide by a match's value (reserved test hosts, valid addresses, check digits)."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

_I = re.IGNORECASE
_RE = {
    name: re.compile(getattr(P, name), _I)
    for name in (
        "EMAIL", "MAILBOX", "HOST", "URL", "DOMAIN", "HANDLE", "PHONE", "CARD", "ORDER_ID", "SECRET_PREFIX", "SECRET_EXPLICIT", "SECRET_BARE", "SECRET_BENIGN",
        "ACCOUNT", "BIRTH_DATE", "GOVERNMENT_ID", "LABELED_ID", "IPV6", "MAC", "STREET", "LABELED_PERSON",
    )
}
_RE |= {name: re.compile(getattr(P, name)) for name in ("SSN", "IPV4", "TITLE_CASE_PERSON")}


_DIGIT, _DOTTED = re.compile(r"\d"), re.compile(r"\.[A-Z]{2}", _I)
_WORDS = {
    "GOVERNMENT_ID": ("passport", "national", "government", "tax", "driver", "social", "ssn"),
    "LABELED_ID": ("customer", "member", "employee", "user", "recipient", "client", "case", "record", "external"),
    "SECRET_EXPLICIT": ("api", "access", "credential", "secret", "passw", "pwd"),
}
_WORDS["SECRET_BARE"] = _WORDS["SECRET_EXPLICIT"]


def may_hold(kind: str, text: str) -> bool:
    """False only if a text lacks what every match of a pattern has: a mark, a digit or a word. Words are looked for in ASCII texts alone, as case folds further beyond."""
    if kind in ("EMAIL", "HANDLE"):
        return "@" in text
    if kind == "URL":
        return "://" in text or "www." in text.lower()
    if kind == "DOMAIN":
        return _DOTTED.search(text) is not None
    if kind in ("SSN", "BIRTH_DATE", "IPV4", "ACCOUNT", "CARD", "STREET", "PHONE", "ORDER_ID"):
        return _DIGIT.search(text) is not None
    if kind in ("IPV6", "LABELED_PERSON"):
        return ":" in text
    if kind == "MAC":
        return ":" in text or "-" in text
    if not text.isascii():
        return True
    if kind == "SECRET_PREFIX":
        return "_" in text or "akia" in text.lower()
    if kind in _WORDS:
        low = text.lower()
        return any(w in low for w in _WORDS[kind])
    return True


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    doubled = (int(c) * 2 for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _reserved_host(host: str | None) -> bool:
    host = (host or "").casefold().rstrip(".")
    return host.endswith(".test") and _RE["HOST"].fullmatch(host) is not None


def _reserved(kind: str, m: re.Match) -> bool:
    """Whether a match is exempt: a well-formed name below .test, or a marked handle."""
    if kind == "EMAIL":
        return _RE["MAILBOX"].fullmatch(m[1]) is not None and _reserved_host(m[2])
    if kind == "URL":
        shown = m[0].rstrip(",;.!?")
        try:
            return _reserved_host(urlsplit(shown if "://" in shown else f"http://{shown}").hostname)
        except ValueError:
            return False
    if kind == "DOMAIN":
        return _reserved_host(m[1])
    return m[1].casefold().startswith(P.HANDLE_EXEMPT)


def _is_address(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def looks_secret(value: str) -> bool:
    """A compact secret, not a document's or version's name."""
    if _RE["SECRET_PREFIX"].search(value):
        return True
    if _RE["SECRET_BENIGN"].fullmatch(value) or len(value) < 10:
        return False
    return any(map(str.isalpha, value)) and (any(map(str.isdigit, value)) or not set("_./+").isdisjoint(value))


def holds_secret(text: str) -> bool:
    named = (m[1] for kind in ("SECRET_EXPLICIT", "SECRET_BARE") if may_hold(kind, text) for m in _RE[kind].finditer(text))
    return (may_hold("SECRET_PREFIX", text) and _RE["SECRET_PREFIX"].search(text) is not None) or any(map(looks_secret, named))


def _keep_or(mask: str, kept):
    return lambda m: m[0] if kept(m) else mask


#: Steps of the redaction in their order: pattern and replacement.
_STEPS = (
    *((kind, _keep_or(mask, lambda m, kind=kind: _reserved(kind, m))) for kind, mask in (("EMAIL", "[EMAIL]"), ("URL", "[URL]"), ("DOMAIN", "[URL]"))),
    ("SSN", "[SSN]"),
    ("BIRTH_DATE", r"\1[DOB]"),
    ("GOVERNMENT_ID", "[GOVERNMENT_ID]"),
    ("LABELED_ID", "[IDENTIFIER]"),
    ("IPV4", _keep_or("[NETWORK_ID]", lambda m: not _is_address(m[0]))),
    ("IPV6", _keep_or("[NETWORK_ID]", lambda m: not _is_address(m[0]))),
    ("MAC", "[NETWORK_ID]"),
    ("ACCOUNT", "[ACCOUNT]"),
    ("ORDER_ID", "[ORDER_ID]"),
    ("SECRET_EXPLICIT", lambda m: m[0].replace(m[1], "[SECRET]")),
    ("SECRET_BARE", lambda m: m[0].replace(m[1], "[SECRET]")),
    ("SECRET_PREFIX", "[SECRET]"),
    ("CARD", _keep_or("[PAYMENT_CARD]", lambda m: not luhn(_digits(m[0])))),
    ("STREET", "[ADDRESS]"),
    ("HANDLE", _keep_or("[HANDLE]", lambda m: _reserved("HANDLE", m))),
    ("PHONE", "[PHONE]"),
    ("LABELED_PERSON", r"\1: [PERSON]"),
    ("TITLE_CASE_PERSON", "[PERSON]"),
)


def redacted(text: str) -> str | None:
    """A seed text with personal data masked; None if nothing or too much is left."""
    for kind, mask in _STEPS:
        if may_hold(kind, text):
            text = _RE[kind].sub(mask, text)
    text = " ".join(text.split())
    return text if 0 < len(text) <= P.TEXT_LIMIT else None


def holds_identifier(text: str) -> bool:
    """Whether a text has a real address, host, card, handle, secret, account or phone number.

    What a check has looked at is blanked before the next one; order numbers are blanked without failing.
    """
    for kind in ("EMAIL", "URL", "DOMAIN"):
        if not may_hold(kind, text):
            continue
        if any(not _reserved(kind, m) for m in _RE[kind].finditer(text)):
            return True
        text = _RE[kind].sub(lambda m: " " * len(m[0]), text)
    digits = may_hold("CARD", text)
    if digits and any(luhn(_digits(m[0])) for m in _RE["CARD"].finditer(text)):
        return True
    if digits:
        text = _RE["ORDER_ID"].sub(lambda m: " " * len(m[0]), text)
    if may_hold("HANDLE", text) and any(not _reserved("HANDLE", m) for m in _RE["HANDLE"].finditer(text)):
        return True
    return holds_secret(text) or any(may_hold(kind, text) and _RE[kind].search(text) for kind in ("ACCOUNT", "PHONE"))


@F.pandas_udf(T.StringType())
def redact(text: pd.Series) -> pd.Series:
    return text.map(redacted, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def external_identifier(text: pd.Series) -> pd.Series:
    return text.map(holds_identifier, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def secret_value(text: pd.Series) -> pd.Series:
    return text.map(looks_secret, na_action="ignore")
