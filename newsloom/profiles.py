"""Profiles as data: sources, keyword tiers, rules and labels.  Operators take a profile, never a profile's name.

Everything here is a small dimension; a profile turns into literal arrays and maps, so that gates stay inside one
projection of the articles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """One source of a profile; ``kind`` names the reader that serves it."""

    id: str
    name: str = ""
    kind: str = "rss"
    url: str = ""
    extra_urls: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("en",)
    link_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    tier: int = 2
    year_templated: bool = False
    allow_pdf: bool = False
    prefer_feed_content: bool = False
    title_class: str = ""
    date_class: str = ""
    date_formats: tuple[str, ...] = ()
    numbered_urls: bool = False

    @property
    def allow_undated(self) -> bool:
        """Feeds may carry undated items; list pages may not."""
        return self.kind == "rss"


@dataclass(frozen=True)
class TitleRule:
    """A tag for titles of sources with a prefix that match a case-insensitive pattern."""

    source_prefix: str
    pattern: str
    tag: str


@dataclass(frozen=True)
class EntityRule:
    """A bonus for articles of one source that name an entity, and more with a context word."""

    source_id: str
    entities: tuple[tuple[str, tuple[str, ...]], ...]
    context_keywords: tuple[str, ...] = ()
    entity_bonus: int = 1
    context_bonus: int = 1
    max_bonus: int = 2


@dataclass(frozen=True)
class Section:
    """A part of a memo: narrative, stories, grouped_stories, watchlist or citations."""

    id: str
    title: str
    kind: str
    max_items: int | None = None
    category_ids: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """All that one tracker needs to know about its domain."""

    id: str
    sources: tuple[Source, ...] = ()
    tiers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    noisy: frozenset[str] = frozenset()
    high_priority_tiers: tuple[str, ...] = ()
    title_rules: tuple[TitleRule, ...] = ()
    entity_rules: tuple[EntityRule, ...] = ()
    boilerplate: tuple[str, ...] = ()
    cross_language_pairs: tuple[tuple[str, str], ...] = ()
    sections: tuple[Section, ...] = ()
    category_sections: dict[str, str] = field(default_factory=dict)
    source_labels: dict[str, str] = field(default_factory=dict)
    signal_labels: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    fallback_narrative: str = "No narrative is available for this report."
    default_watchlist: tuple[str, ...] = ()
    recency_hours: int = 72
    category_field: str = "category"
    signal_field: str = "signal"
    similarity: float = 0.82
    default_tier: int = 2

    def general(self) -> list[str]:
        """The union of all tiers without repeats of case, in order."""
        seen: dict[str, str] = {}
        for words in self.tiers.values():
            for w in words:
                seen.setdefault(w.lower(), w)
        return list(seen.values())


def sources_table(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """The sources of all profiles as a dimension, in order."""
    rows = [
        (p.id, s.id, s.name, s.kind, s.url, list(s.extra_urls), list(s.link_patterns), list(s.exclude_patterns), list(s.allowed_domains), s.tier, s.id in p.noisy, s.allow_undated, s.year_templated, s.allow_pdf, s.prefer_feed_content, s.title_class, s.date_class, list(s.date_formats), s.numbered_urls, k)
        for p in profiles
        for k, s in enumerate(p.sources)
    ]
    return spark.createDataFrame(
        rows,
        "profile_id string, source string, name string, kind string, url string, extra_urls array<string>, link_patterns array<string>, exclude_patterns array<string>, allowed_domains array<string>, tier int, is_noisy boolean, allow_undated boolean, "
        "year_templated boolean, allow_pdf boolean, prefer_feed_content boolean, title_class string, date_class string, date_formats array<string>, numbered_urls boolean, source_ord int",
    )


def keywords_table(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """(profile_id, tier, keyword, ord) of all profiles."""
    rows = [(p.id, tier, w, k) for p in profiles for tier, words in p.tiers.items() for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "profile_id string, tier string, keyword string, ord int")


def for_profiles(df: DataFrame, profiles: list[Profile], step: Callable[[DataFrame, Profile], DataFrame]) -> DataFrame:
    """One step for many profiles in one job: the results with a profile_id column."""
    out = None
    for p in profiles:
        own = step(df, p).withColumn("profile_id", F.lit(p.id))
        out = own if out is None else out.unionByName(own)
    return out
