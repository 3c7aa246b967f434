"""Scalar expressions: rounding, identifiers, text keys, times and error lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier and field patterns.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
ISRC_PATTERN = r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"
ISWC_PATTERN = r"^T-[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]$"
COUNTRY_PATTERN = r"^[A-Z]{2}$"
LANGUAGE_PATTERN = r"^[a-z]{3}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
UPC_PATTERN = r"^[0-9]{8,14}$"
LOCAL_ZONE = "Africa/Kampala"


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Spark may copy a column's expression into a lambda that refers to it, and then
    computes it again for every element. A lambda variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.rint(value).cast("int")


def ratio(part: str | Column, whole: str | Column, places: int = 4) -> Column:
    """``part / whole`` rounded, or NULL when ``whole`` is zero."""
    return F.round(F.try_divide(column(part).cast("double"), column(whole).cast("double")), places)


def is_blank(value: str | Column) -> Column:
    c = column(value)
    return c.isNull() | (F.trim(c) == "")


def error_list(*checks: tuple[Column, str | Column]) -> Column:
    """The messages whose condition holds, in the order given."""
    items = [F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in checks]
    return F.filter(F.array(*items), lambda m: m.isNotNull())


def normalize_isrc(value: str | Column) -> Column:
    """Upper case without spaces and hyphens; NULL when not a valid ISRC."""
    code = F.translate(F.upper(F.trim(column(value))), " -", "")
    return F.when(code.rlike(ISRC_PATTERN), code)


def normalize_iswc(value: str | Column) -> Column:
    """Canonical ``T-ddd.ddd.ddd-d``; NULL when not a valid ISWC."""
    raw = F.trim(column(value))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    formatted = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{3})(\d)$", r"T-$1.$2.$3-$4")
    return F.when(raw.rlike(ISWC_PATTERN), raw).when(digits.rlike(r"^\d{10}$"), formatted)


def normalize_title(value: str | Column) -> Column:
    """Lower case; runs of anything but ``a-z0-9`` become one space."""
    text = F.regexp_replace(F.lower(column(value)), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(text), F.lit(""))


def title_artist_key(title: str | Column, artist: str | Column) -> Column:
    return F.concat_ws("|", normalize_title(title), normalize_title(artist))


def confidence_hint(votes: Column, query_coverage: Column, track_coverage: Column) -> Column:
    """An uncalibrated triage hint: the smaller coverage, damped below 20 votes."""
    damped = F.least(query_coverage, track_coverage) * F.least(F.lit(1.0), votes / F.lit(20.0))
    return F.round(damped, 4)


def midpoint(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(column(start)) + F.floor((F.unix_micros(column(end)) - F.unix_micros(column(start))) / 2)
    )


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(column(end)) - F.unix_micros(column(start))) / F.lit(1e6)


def local_date(at: str | Column) -> Column:
    """The calendar date in the tariff's home time zone."""
    return F.to_date(F.from_utc_timestamp(column(at), LOCAL_ZONE))


def has_offset(text: Column) -> Column:
    return text.rlike(r"([zZ]|[+-][0-9]{2}:?[0-9]{2}|:[0-9.]+[+-][0-9]{2})$")


def parse_timestamp(value: str | Column, *, naive: str = "utc") -> Column:
    """ISO-8601 text to a timestamp; NULL when it cannot be read.

    ``naive`` says what a text without an offset means: ``"utc"`` or ``"error"``.
    The session time zone must be UTC.
    """
    text = F.trim(column(value))
    parsed = F.try_to_timestamp(text)
    return parsed if naive == "utc" else F.when(has_offset(text), parsed)


def stable_id(*parts: str | Column) -> Column:
    """A surrogate key that a rerun reproduces."""
    return F.sha2(F.concat_ws("\u001f", *[column(p).cast("string") for p in parts]), 256)
