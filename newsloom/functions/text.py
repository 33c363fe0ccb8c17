"""Text columns: blobs, normal forms, identifiers, hashes, truncations and labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens too common to identify an event, and the units of a capacity.
GENERIC_TOKENS = ["bess", "energy", "fip", "grid", "mwh", "mw", "news", "ppa", "project"]
IDENTIFIER = "[A-Za-z][A-Za-z0-9&.-]{2,}"
CAPACITY = r"(?i)(\d+(?:\.\d+)?)\s*(?:mw|mwh|gw|gwh)"
#: Longest texts of feed summaries, feed bodies and excerpts, and of summaries and excerpts from list pages.
SUMMARY_CHARS, BODY_CHARS, EXCERPT_CHARS, PAGE_SUMMARY_CHARS, PAGE_EXCERPT_CHARS = 2000, 12000, 500, 500, 300


def filled(*columns: Column | str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def text_blob(title: str = "title", summary: str = "summary", excerpt: str = "raw_excerpt") -> Column:
    """The non-empty ones of three texts, joined by blanks."""
    return F.array_join(F.filter(F.array(title, summary, excerpt), lambda x: x.isNotNull() & (x != "")), " ")


def normalize_text(text: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """Lower case, whole boilerplate words and everything but a-z and 0-9 to blanks, blanks collapsed."""
    out = F.lower(text)
    if boilerplate:
        words = "|".join(re.escape(w.lower()) for w in boilerplate)
        out = F.regexp_replace(out, rf"(?U)\b({words})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]+", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    from html import unescape

    return text.map(unescape, na_action="ignore")


#: A character reference with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescape_closed(text: pd.Series) -> pd.Series:
    from html import unescape
    from html.entities import html5

    decoded = lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return text.map(lambda t: _CLOSED.sub(decoded, t), na_action="ignore")


def html_unescape(text: Column, closed: bool = False) -> Column:
    """Character references decoded; texts without ``&`` never leave the JVM's value.

    As in HTML, old names count without a semicolon too (``&amp`` at the end of a text that was cut, say); with ``closed``
    only references that end in one are decoded.
    """
    decode = _unescape_closed if closed else _unescape
    return F.when(text.contains("&"), decode(F.when(text.contains("&"), text))).otherwise(text)


def latin_identifiers(text: Column) -> Column:
    """Distinct lower-cased Latin tokens of three and more characters that are not generic."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, GENERIC_TOKENS)))


def capacity_values(text: Column) -> Column:
    """Distinct numbers in front of a unit of power or energy."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CAPACITY), F.lit(1)))


def content_hash(source: str = "source", title: str = "title", url: str = "url") -> Column:
    """SHA-256 of source, title and url."""
    return F.sha2(F.concat_ws("|", source, title, url), 256)


def strip_html(text: Column) -> Column:
    """Trimmed; with markup, tags become blanks and runs of blanks one."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))
    return F.when(text.contains("<"), flat).otherwise(F.trim(text))


def resolve_url(href: Column, base: Column) -> Column:
    """A link made absolute against its page (built-in cases: absolute, ``//host``, ``/path``, relative, ``?query``)."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*)?)", 1)
    directory = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(folder, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(folder, href))
        .otherwise(F.concat(directory, F.regexp_replace(href, r"^(?:\./)+", "")))
    )


def relevance_label(score: Column) -> Column:
    """High from 80, Medium from 60, else Low; what is no number counts as 0."""
    value = F.coalesce(score.try_cast("int"), F.lit(0))
    return F.when(value >= 80, "High").when(value >= 60, "Medium").otherwise("Low")


def looked_up(key: Column, labels: dict[str, str]) -> Column:
    """The label of an id; an id without one is its own."""
    if not labels:
        return key
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def display_date(published: Column, collected: Column, tz: str = "Asia/Hong_Kong") -> Column:
    """The local publication day; else the day it was first seen, marked as such; else a note."""
    day = lambda ts: F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")
    return F.coalesce(day(published), F.concat(F.lit("~"), day(collected), F.lit(" (first seen)")), F.lit("date unknown"))


def takeaway(impact: str = "impact", why: str = "why_it_matters", summary: str = "summary") -> Column:
    """The first of impact, reason and summary that says something."""
    return F.coalesce(filled(impact, why, summary), F.lit(""))
