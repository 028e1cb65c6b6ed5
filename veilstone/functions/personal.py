"""Shapes of identifiers that stand in free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fixed shapes of the identifier scan, in the order in which kinds are reported (fixed values).
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
#: Eight groups, or up to seven on either side of a double colon.
IPV6 = (
    r"(?<![\w:.])(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}(?![\w:.])"
    r"|(?<![\w:.])(?:[A-Fa-f0-9]{1,4})?(?::[A-Fa-f0-9]{1,4}){0,6}::(?:[A-Fa-f0-9]{1,4})?(?::[A-Fa-f0-9]{1,4}){0,6}(?![\w:.])"
)
PHONE = r"\+?\d[\d\s().\-]{7,}\d"
EXTENSION = r"(?i)\b(?:x|ext\.?|extension)\s*\d{3,6}\b"
PHONE_DIGITS = 10


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _found(text: Column, kind: str, pattern: str, keep=None) -> Column:
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: F.trim(x)))
    if keep is not None:
        hits = F.filter(hits, keep)
    return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def scan(text: Column, ipv6: bool = True) -> Column:
    """array<struct<kind, value>>: the different e-mail addresses, IPv4 and IPv6 addresses and
    phone numbers (ten figures or more) of a text, by kind, in order of appearance."""
    kinds = [_found(text, "email", EMAIL), _found(text, "ipv4", IPV4)]
    if ipv6:
        kinds.append(_found(text, "ipv6", IPV6, lambda x: x.rlike("[0-9A-Fa-f]")))
    kinds.append(_found(text, "phone", PHONE, lambda x: digits(x) >= PHONE_DIGITS))
    return F.coalesce(F.concat(*kinds), F.array().cast("array<struct<kind:string,value:string>>"))


def phone_signals(text: Column) -> Column:
    """How many phone numbers and extensions a text holds, repeated ones counted again."""
    numbers = F.size(F.filter(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda x: digits(x) >= PHONE_DIGITS))
    return numbers + F.size(F.regexp_extract_all(text, F.lit(EXTENSION), 0))
