"""Integers kept as text, and file addresses that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer_of(text: Column) -> Column:
    """The integer that a text spells (blanks around, sign, leading zeros, '.0'), else null.

    A text with a fraction, or none that fits a bigint, gives null.
    """
    number = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").try_cast("decimal(38,6)")
    whole = number.try_cast("bigint")
    return F.when(number == whole, whole)


def _segments(path: Column) -> Column:
    """Path segments: percent decoding, then '.', '..' and empty ones resolved.

    An encoded slash stays inside its segment (as U+0000). A '..' above the root is dropped.
    """
    kept = F.regexp_replace(F.regexp_replace(path, r"\+", "%2B"), "(?i)%2F", "%00")
    decoded = F.coalesce(F.try_url_decode(kept), path)
    parts = F.filter(F.split(F.when(path.contains("%"), decoded).otherwise(path), "/"), lambda s: ~s.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.array_append(acc, s)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.when(F.array_contains(parts, ".."), resolved).otherwise(parts)


_URL = r"^(?i)([a-z][a-z0-9+.\-]*):(?://([^/?#]*))?(.*)$"
_IS_URL = r"^(?i)([a-z][a-z0-9+.\-]*://|file:)"


def is_url(address: Column) -> Column:
    """True for an absolute URL; a relative path with a colon in it is none."""
    return address.rlike(_IS_URL)


def address_root(address: Column) -> Column:
    """'scheme://authority' of a URL in lower case (file://localhost is file://), null for a relative path."""
    scheme = F.lower(F.regexp_extract(address, _URL, 1))
    host = F.lower(F.regexp_extract(address, _URL, 2))
    host = F.when((scheme == "file") & (host == "localhost"), "").otherwise(host)
    return F.when(is_url(address), F.concat(scheme, F.lit("://"), host))


def address_segments(address: Column) -> Column:
    """The resolved path segments of a URL or of a relative path."""
    return _segments(F.when(is_url(address), F.regexp_extract(address, _URL, 3)).otherwise(address))
