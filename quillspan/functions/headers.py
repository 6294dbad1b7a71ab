"""Headers and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def media_base(content_type: Column) -> Column:
    """The media type without parameters, trimmed, in lower case; empty for null."""
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def header(headers: Column, name: str) -> Column:
    """The value under the exact name, else under the least name that is equal but for case, else empty."""
    alike = F.array_min(F.filter(F.map_keys(headers), lambda k: F.lower(k) == name.lower()))
    return F.coalesce(F.element_at(headers, F.lit(name)), F.element_at(headers, alike), F.lit(""))


def has_header(headers: Column, *names: str) -> Column:
    return F.coalesce(F.exists(F.map_keys(headers), lambda k: F.lower(k).isin(*[n.lower() for n in names])), F.lit(False))


def body_text(body: Column) -> Column:
    """A body as text, malformed bytes replaced; null is empty."""
    return F.coalesce(F.try_validate_utf8(body.cast("string")), F.make_valid_utf8(body.cast("string")), F.lit(""))


def first_solid(text: Column) -> Column:
    """The first character that is no JSON white space."""
    return F.substring(F.regexp_replace(text, r"^[ \t\n\r]+", ""), 1, 1)


_TOKEN = r"[A-Za-z0-9!#$%&'*+\-.^_`|~]+"


def parse_header(line: Column) -> Column:
    """(name, value) of ``Key: Value``; null without a colon, with a name that is no token, or with a line end or NUL in the value."""
    name, value = F.trim(F.substring_index(line, ":", 1)), F.regexp_replace(F.regexp_replace(line, r"(?s)\A[^:]*:", ""), r"(?s)\A\s+|\s+\z", "")
    fine = line.contains(":") & name.rlike(rf"\A{_TOKEN}\z") & ~value.rlike(r"[\r\n\x00]")
    return F.when(fine, F.struct(name.alias("name"), value.alias("value")))


def cookie_header(headers: Column) -> Column:
    """(cookie, rest): the values of all headers that are ``Cookie`` but for case, in the order of their names, and the other headers."""
    names = F.array_sort(F.filter(F.map_keys(headers), lambda k: F.lower(k) == "cookie"))
    return F.struct(F.array_join(F.transform(names, lambda k: F.element_at(headers, k)), "; ").alias("cookie"), F.map_filter(headers, lambda k, _: F.lower(k) != "cookie").alias("rest"))


def cookies(value: Column) -> Column:
    """(name, value) of each cookie of a header; pieces without an equals sign or a name are left out."""
    pieces = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: F.trim(F.substring_index(p, "=", 1)) != "")
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.trim(F.regexp_replace(p, r"(?s)\A[^=]*=", "")).alias("value"))
    return F.transform(F.filter(pieces, lambda p: p.contains("=")), pair)
