"""Joins and reads over articles, scores and analyses; lineage is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schemas import LINEAGE_KEY


def need_lineage(**parts: str | None) -> None:
    """Reads never mix models: every part must be given."""
    if missing := [k for k, v in parts.items() if not v]:
        raise ValueError(f"lineage is incomplete: {', '.join(missing)}")


def in_sources(column: str, source_ids: list[str] | None) -> Column:
    """None does not filter; an empty list leaves nothing."""
    return F.lit(True) if source_ids is None else F.col(column).isin(*source_ids) if source_ids else F.lit(False)


def unscored(articles: DataFrame, scores: DataFrame, provider: str, model: str, source_ids: list[str] | None = None) -> DataFrame:
    """Articles without a score by exactly this model."""
    need_lineage(provider=provider, model=model)
    own = scores.where((F.col("provider") == provider) & (F.col("model") == model)).select("article_id")
    return articles.where(in_sources("source", source_ids)).join(own, "article_id", "left_anti")


def canonical_order() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("collected_at").desc(), F.col("article_id")]


def read_articles(articles: DataFrame) -> DataFrame:
    """The corpus in canonical order."""
    return articles.orderBy(*canonical_order())


def skip_known(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items whose content hash is new; runs before anything expensive."""
    return items.join(articles.select("content_hash"), "content_hash", "left_anti")


def exclude_scored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (article_id, provider, model) that have no score yet."""
    return candidates.join(scores.select("article_id", "provider", "model"), ["article_id", "provider", "model"], "left_anti")


_FROM_ARTICLE = ["article_id", "source", "title", "url", "published_at", "collected_at"]


def scored_articles(scores: DataFrame, articles: DataFrame) -> DataFrame:
    """Scores with their articles' fields; the summary is the score's."""
    return scores.join(articles.select(*_FROM_ARTICLE), "article_id")


def lineage_filter(scored: DataFrame, provider: str, model: str, source_ids: list[str] | None = None, min_relevance: int | None = None, recency_hours: int | None = None, as_of: str | None = None) -> DataFrame:
    """One model's scored articles, by source, threshold and age of the effective time."""
    need_lineage(provider=provider, model=model)
    out = scored.where((F.col("provider") == provider) & (F.col("model") == model)).where(in_sources("source", source_ids))
    if min_relevance is not None:
        out = out.where(F.col("relevance_score") >= min_relevance)
    if recency_hours is not None:
        edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(recency_hours))
        out = out.where(F.coalesce("published_at", "collected_at") >= edge)
    return out


def tracker_query(items: DataFrame, profile_id: str, limit: int = 100, **equal: str | None) -> DataFrame:
    """Tracker rows of a profile, newest change first; optional equalities; missing lineage and owner read as empty."""
    out = items.where(F.col("profile_id") == profile_id)
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    for name in ("owner", "entity", "impact", "suggested_action", "category"):
        out = out.withColumn(name, F.coalesce(name, F.lit("")))
    return out.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def lookup_analyses(analyses: DataFrame, ids: DataFrame, profile_id: str, scoring_provider: str, scoring_model: str, analysis_provider: str, analysis_model: str) -> DataFrame:
    """Stored analyses of a set of ids under one lineage, nulls read as defaults."""
    parts = {"profile_id": profile_id, "scoring_provider": scoring_provider, "scoring_model": scoring_model, "analysis_provider": analysis_provider, "analysis_model": analysis_model}
    need_lineage(**parts)
    out = analyses
    for name, value in parts.items():
        out = out.where(F.col(name) == value)
    out = out.join(ids.select("article_id"), "article_id", "left_semi")
    for name, default in (("category", "other"), ("entity", "n/a"), ("impact", ""), ("suggested_action", "Monitor only"), ("model_raw", "")):
        out = out.withColumn(name, F.coalesce(name, F.lit(default)))
    return out


def split_cached(items: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with a stored analysis, items without)."""
    ids = cached.select("article_id")
    return items.join(ids, "article_id", "left_semi"), items.join(ids, "article_id", "left_anti")


def cached_and_new(cached: DataFrame, new: DataFrame) -> DataFrame:
    """Union in which a new analysis wins over a stored one."""
    both = cached.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*LINEAGE_KEY).orderBy(F.col("_new").desc(), F.col("analyzed_at").desc()))
    return both.withColumn("_k", last).where("_k = 1").drop("_k", "_new")


def merge_analysis(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """Items with entity, impact and action; a non-empty analysis category replaces the item's."""
    own = analyses.select("article_id", F.col("category").alias("analysis_category"), "entity", "impact", "suggested_action")
    out = items.join(own, "article_id", "left")
    return out.withColumn("category", F.coalesce(F.nullif("analysis_category", F.lit("")), "category"))


def related_items(items: DataFrame, batch_key: list[str], order: str = "rank", k: int = 8) -> DataFrame:
    """Each item with ``related``: the first k others of its batch in order.

    Only a batch's first k + 1 items can be related to anything, so no batch is gathered as a whole.
    """
    fields = ["article_id", "title", "source", "category", "relevance_score"]
    place = F.row_number().over(Window.partitionBy(*batch_key).orderBy(order))
    head = items.select(*batch_key, order, *fields).withColumn("_k", place).where(F.col("_k") <= k + 1)
    lists = head.groupBy(*batch_key).agg(F.array_sort(F.collect_list(F.struct("_k", *fields))).alias("_head"))
    others = F.slice(F.filter("_head", lambda x: x["article_id"] != F.col("article_id")), 1, k)
    return items.join(lists, batch_key, "left").withColumn("related", others).drop("_head")


def attach_section(items: DataFrame, sections: DataFrame, category_map: DataFrame) -> DataFrame:
    """One row for each item and grouped section that takes its category, listed by the section or mapped to it.

    ``sections``: section_id, max_items, category_ids; ``category_map``: category, section_id.  Both are small.
    """
    listed = sections.select("section_id", "max_items", F.explode("category_ids").alias("category"))
    mapped = category_map.join(sections.select("section_id", "max_items"), "section_id").select("section_id", "max_items", "category")
    wanted = listed.unionByName(mapped).distinct()
    return items.join(F.broadcast(wanted), "category")


def pivot_models(scored: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """One row for each article that any of the models scored, with each model's score, signal, confidence, summary.

    Of several rows of one article and model the latest by scored_at counts (where rows have it), then the greatest.
    """
    late = F.col("scored_at") if "scored_at" in scored.columns else F.lit(None).cast("timestamp")
    keyed = scored.withColumn("_m", F.concat_ws("__", "provider", "model"))
    names = [f"{p}__{m}" for p, m in models]
    parts = {"score": "relevance_score", "signal": "signal", "confidence": "confidence", "summary": "summary"}
    return keyed.where(F.col("_m").isin(*names)).groupBy("article_id", "title", "url").pivot("_m", names).agg(*(F.max_by(F.col(c), F.struct(late, F.col("relevance_score"), F.col(c))).alias(n) for n, c in parts.items()))
