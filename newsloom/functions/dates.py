"""Dates out of scraped text.  Every parser gives null where it fails, so that the next one is tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first match of each kind is the only one that is tried.
ENGLISH = r"(?i)(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2},?\s+\d{4}"
JAPANESE = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
NUMERIC = r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})"
COMPACT = r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)"


def _ymd(text: Column, pattern: str, century: int = 0) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    return F.try_make_timestamp(part(1) + century, part(2), part(3), F.lit(0), F.lit(0), F.lit(0))


def english_date(text: Column) -> Column:
    """``Nov. 7, 2022`` and its kin at midnight; the comma is needed."""
    found = F.regexp_replace(F.regexp_extract(text, ENGLISH, 0), r"\s+", " ")
    return F.coalesce(*(F.try_to_timestamp(found, F.lit(f)) for f in ("MMM. d, yyyy", "MMM d, yyyy", "MMMM d, yyyy")))


def written_date(text: Column) -> Column:
    """The first date with a whole year in a text: English, Japanese, then numeric; midnight UTC."""
    return F.coalesce(english_date(text), _ymd(text, JAPANESE), _ymd(text, NUMERIC))


def parse_date_text(text: Column) -> Column:
    """The first date in a text: with a whole year, then six digits; midnight UTC."""
    return F.coalesce(written_date(text), _ymd(text, COMPACT, 2000))


def parse_iso(value: Column) -> Column:
    """A date or an ISO timestamp, with its offset if it has one, else UTC."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text))


def parse_feed_date(*values: Column) -> Column:
    """The first of several feed dates that is one: RFC 822 (weekday ignored) or ISO."""
    out = []
    for value in values:
        text = F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*[A-Za-z]{3,9},?\s+", ""), r"\s+", " "))
        text = F.regexp_replace(F.regexp_replace(text, r" (?:GMT|UTC|UT|Z)$", " +0000"), r"^(\d) ", "0$1 ")
        out += [F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm Z")), F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss")), parse_iso(value)]
    return F.coalesce(*out)


def enrich_published_at(published: Column, title: Column, summary: Column, excerpt: Column) -> Column:
    """A missing publication time is taken from the first text with a date."""
    return F.coalesce(published, parse_date_text(title), parse_date_text(summary), parse_date_text(excerpt))


def selector_date(text: Column, formats: list[str]) -> Column:
    """The first of several explicit formats that fits the text, blanks collapsed."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(*(F.try_to_timestamp(flat, F.lit(f)) for f in formats)) if formats else F.lit(None).cast("timestamp")


def business_day(ts: Column, tz: str = "UTC") -> Column:
    """Whether the local day is one from Monday to Friday."""
    return F.weekday(F.from_utc_timestamp(ts, tz)) < 5
