"""Model replies: JSON in prose or fences to typed columns with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import filled


def extract_json(reply: Column) -> Column:
    """The JSON object of a reply: a fence is stripped; else the outermost braces count."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def _object(reply: Column, names: list[str]) -> Column:
    return F.from_json(extract_json(reply), ", ".join(f"`{n}` string" for n in dict.fromkeys(names)))


def parse_score(reply: str = "reply", title: str = "title", source: str = "source", category_field: str = "category", signal_field: str = "signal") -> list[Column]:
    """Columns of a score; relevance_score is null where the reply has to be rejected.

    Missing and null fields get their defaults; a score may be a number or a string that is one.
    """
    o = _object(F.col(reply), ["relevance_score", category_field, signal_field, "confidence", "summary", "why_it_matters", "source_citation"])
    get = lambda name, default: F.coalesce(o[name], default if isinstance(default, Column) else F.lit(default))
    score = F.when(o["relevance_score"].isNull() & extract_json(F.col(reply)).isNotNull() & o.isNotNull(), F.lit(0)).otherwise(F.coalesce(o["relevance_score"].try_cast("int"), o["relevance_score"].try_cast("double").try_cast("int")))
    return [
        score.alias("relevance_score"),
        get(category_field, "other").alias("category"),
        get(signal_field, "unclear").alias("signal"),
        get("confidence", "low").alias("confidence"),
        get("summary", "").alias("summary"),
        get("why_it_matters", "").alias("why_it_matters"),
        get("source_citation", F.concat(F.col(title), F.lit(" ("), F.col(source), F.lit(")"))).alias("source_citation"),
    ]


def parse_analysis(reply: str = "reply", category: str = "category", why: str = "why_it_matters", summary: str = "summary") -> list[Column]:
    """Columns of an analysis; every field that the reply lacks falls back to the scored item."""
    o = _object(F.col(reply), ["category", "entity", "impact", "suggested_action"])
    return [
        F.coalesce(filled(o["category"], F.col(category)), F.lit("other")).alias("category"),
        F.coalesce(filled(o["entity"]), F.lit("n/a")).alias("entity"),
        F.coalesce(filled(o["impact"], F.col(why), F.col(summary)), F.lit("")).alias("impact"),
        F.coalesce(filled(o["suggested_action"]), F.lit("Monitor only")).alias("suggested_action"),
    ]
