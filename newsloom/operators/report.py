"""Memos as rows: story blocks and whole reports are string columns, so thousands render in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import display_date, filled, looked_up, relevance_label, takeaway
from newsloom.profiles import Profile, Section

STORY_FIELDS = ("takeaway", "date", "url", "signal", "relevance")
#: Items of a section that states no limit of its own.
LIMITS = {"stories": 7, "grouped_stories": 5, "citations": 10}
# Names of the parts of a memo; a profile replaces any of them.
LABELS = {"report_title": "Executive Memo", "signal": "Signal", "entity": "Entity", "impact": "Impact", "suggested_action": "Suggested action", "sources_line": ""}


def base_sections(narrative: str = "Executive Summary", stories: int = 7, citations: int = 10, extra: tuple[Section, ...] = (), replace: tuple[Section, ...] | None = None) -> tuple[Section, ...]:
    """The usual parts of a memo; extra ones follow the stories, and ``replace`` stands for all of them."""
    if replace is not None:
        return replace
    return (
        Section("executive_summary", narrative, "narrative"),
        Section("top_stories", "Top Stories", "stories", stories),
        *extra,
        Section("watchlist", "Watchlist", "watchlist"),
        Section("citations", "Source Citations", "citations", citations),
    )


def _label(p: Profile, name: str) -> str:
    return p.labels.get(name, LABELS[name])


def story_block(p: Profile, number: Column, fields: tuple[str, ...], tz: str = "Asia/Hong_Kong") -> Column:
    """A story's lines as one string; lines without content are left out."""
    bold = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    meta = [bold("Source", looked_up(F.col("source"), p.source_labels))]
    if "signal" in fields:
        meta.append(bold(_label(p, "signal"), looked_up(F.coalesce("signal", F.lit("")), p.signal_labels)))
    if "relevance" in fields:
        meta.append(bold("Relevance", relevance_label(F.col("relevance_score").cast("string"))))
    if "entity" in fields:
        meta.append(bold(_label(p, "entity"), filled("entity")))
    lines = [F.concat(F.lit("### "), number.cast("string"), F.lit(". "), F.col("title")), F.concat(F.lit("- "), F.concat_ws(" | ", *meta))]
    item = lambda value: F.concat(F.lit("- "), value)
    if "takeaway" in fields:
        lines.append(item(F.nullif(takeaway(), F.lit(""))))
    for name in ("impact", "suggested_action"):
        if name in fields:
            lines.append(item(bold(_label(p, name), filled(name))))
    date, link = bold("Date", display_date(F.col("published_at"), F.col("collected_at"), tz)), F.concat(F.lit("[Read more]("), F.col("url"), F.lit(")"))
    last = [date] * ("date" in fields) + [link] * ("url" in fields)
    if last:
        lines.append(item(F.concat_ws(" | ", *last)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def citation_line(p: Profile, tz: str = "Asia/Hong_Kong") -> Column:
    return F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(") — "), looked_up(F.col("source"), p.source_labels), F.lit(", "), display_date(F.col("published_at"), F.col("collected_at"), tz))


def _ordered(lines: DataFrame, key: list[str], name: str) -> DataFrame:
    """Lines of each report joined in order."""
    return lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias(name))


def memo_markdown(reports: DataFrame, items: DataFrame, citations: DataFrame, p: Profile, report_key: list[str], order: str = "rank", tz: str = "Asia/Hong_Kong") -> DataFrame:
    """(report key, body) for each report.

    ``reports`` carries generated_at, the four lineage columns, narrative and watchlist (null or empty: the profile's);
    ``items`` and ``citations`` carry the report key and their order.  An item's section holds its analysis category.
    """
    place = lambda limit: F.row_number().over(Window.partitionBy(*report_key).orderBy(order))
    out = reports
    parts: list[Column] = []
    for k, s in enumerate(p.sections):
        head = F.lit(f"## {s.title}\n")
        if s.kind == "narrative":
            parts += [head, F.coalesce(filled("narrative"), F.lit(p.fallback_narrative)), F.lit("")]
            continue
        if s.kind == "watchlist":
            own = F.when(F.size(F.coalesce("watchlist", F.array().cast("array<string>"))) > 0, F.col("watchlist")).otherwise(F.array(*map(F.lit, p.default_watchlist)).cast("array<string>"))
            parts += [head, F.nullif(F.array_join(F.transform(own, lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit("")), F.lit("")]
            continue
        limit = s.max_items or LIMITS[s.kind]
        chosen = citations if s.kind == "citations" else items
        if s.kind == "grouped_stories":
            wanted = sorted({*s.category_ids, *(c for c, sid in p.category_sections.items() if sid == s.id)})
            category = F.coalesce(filled("analysis_category", "category"), F.lit(""))
            chosen = chosen.where(category.isin(*wanted) if wanted else F.lit(False))
        chosen = chosen.withColumn("_n", place(limit)).where(F.col("_n") <= limit)
        line = citation_line(p, tz) if s.kind == "citations" else story_block(p, F.col("_n"), s.fields or STORY_FIELDS, tz)
        out = out.join(_ordered(chosen.select(*report_key, "_n", line.alias("_line")), report_key, f"_part{k}"), report_key, "left")
        if s.kind == "citations":
            parts += [head, F.col(f"_part{k}"), F.lit("")]
        else:
            parts += [head, F.coalesce(F.col(f"_part{k}"), F.lit("_No items in this section._\n"))]
    generated = F.date_format(F.from_utc_timestamp("generated_at", tz), "yyyy-MM-dd HH:mm")
    zone = p.labels.get("zone", "HK time")
    top = F.concat_ws(
        "\n", F.lit(f"# {_label(p, 'report_title')}\n"), F.concat(F.lit("**Generated:** "), generated, F.lit(f" {zone}")),
        F.concat(F.lit("**Scoring LLM:** "), F.col("scoring_provider"), F.lit(" / "), F.col("scoring_model")), F.concat(F.lit("**Analysis LLM:** "), F.col("analysis_provider"), F.lit(" / "), F.col("analysis_model")),
        F.lit(f"**Profile:** {p.id}"), F.lit(f"**Summary style:** {p.labels.get('summary_style', 'base')}"), F.lit(f"**Sources:** {_label(p, 'sources_line')}\n"),
    )
    return out.select(*report_key, F.concat_ws("\n", top, *parts, F.lit("---")).alias("body"))
