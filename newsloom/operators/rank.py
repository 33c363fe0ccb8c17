"""Ranking, quotas and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.gate import gated, prioritized
from newsloom.operators.similarity import dedupe_near, dedupe_scored, diversify
from newsloom.profiles import Profile

#: Production limits: per noisy source, noisy sources together, and altogether.
PER_SOURCE, NOISY_TOTAL, TOTAL = 3, 5, 25


def effective_time(published: str = "published_at", other: str = "collected_at") -> Column:
    return F.coalesce(F.col(published), F.col(other))


def rank_order(as_of: str) -> list[Column]:
    """Priority, then date (undated counts as now), then the order in which unscored articles come."""
    now = F.lit(as_of).cast("timestamp")
    return [F.col("priority").desc(), F.coalesce("published_at", now).desc(), F.col("published_at").desc_nulls_last(), F.col("collected_at").desc(), F.col("article_id")]


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered in a global order, without a window over all rows in one task.

    Rows are range-partitioned by the order; the partitions' sizes (one small row each) give the offsets.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = ordered.checkpoint()
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_p", "_at", "_before")


def source_quotas(ranked: DataFrame, order: str | Column = "rank", per_source: int = PER_SOURCE, noisy_total: int = NOISY_TOTAL, total: int = TOTAL) -> DataFrame:
    """In rank order at most ``per_source`` rows of each noisy source, ``noisy_total`` of all noisy ones, ``total`` rows.

    Each step is a top-k: per source, over the noisy survivors, and over all; no window spans all rows.
    """
    noisy = ranked.where("is_noisy").withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(order))).where(F.col("_k") <= per_source).drop("_k")
    noisy = noisy.orderBy(order).limit(noisy_total)
    return ranked.where("NOT is_noisy").unionByName(noisy).orderBy(order).limit(total)


def ranked_candidates(articles: DataFrame, p: Profile, as_of: str) -> DataFrame:
    """Gate, priority and global rank."""
    return with_rank(prioritized(gated(articles, p), p), rank_order(as_of))


def rank_for_scoring(articles: DataFrame, p: Profile, as_of: str, **limits) -> DataFrame:
    """The articles to score: gated, ranked, near-duplicates merged, quotas applied; ``slot`` is the final order."""
    return source_quotas(dedupe_near(ranked_candidates(articles, p, as_of), p), "slot", **limits)


def top_scored(scored: DataFrame, min_relevance: int = 40, limit: int = 15) -> DataFrame:
    """Best scored articles: relevance, then effective time, then id."""
    return scored.where(F.col("relevance_score") >= min_relevance).orderBy(*scored_order()).limit(limit)


def scored_order() -> list[Column]:
    return [F.col("relevance_score").desc(), effective_time().desc(), F.col("article_id")]


def top_scored_per_report(scored: DataFrame, report_key: list[str], min_relevance: int = 40, limit: int = 15) -> DataFrame:
    """The same for many reports at once, with ``rank`` inside the report."""
    rank = F.row_number().over(Window.partitionBy(*report_key).orderBy(*scored_order()))
    return scored.where(F.col("relevance_score") >= min_relevance).withColumn("rank", rank).where(F.col("rank") <= limit)


def recent_scored_fallback(scored: DataFrame, report_key: list[str], min_relevance: int = 40, limit: int = 15, fallback_limit: int = 10) -> DataFrame:
    """Top rows of each report; a report without any above the threshold gets its best rows regardless."""
    top = top_scored_per_report(scored, report_key, min_relevance, limit)
    qualified = scored.where(F.col("relevance_score") >= min_relevance).select(*report_key).distinct()
    rest = top_scored_per_report(scored.join(qualified, report_key, "left_anti"), report_key, -(1 << 31), fallback_limit)
    return top.unionByName(rest)


def summary_items(scored: DataFrame, p: Profile, report_key: list[str], order: str = "rank") -> tuple[DataFrame, DataFrame]:
    """(stories, citations) of one report's ranked rows: the diverse choice, or else plain dedupe; and 15 citations."""
    stories = diversify(scored, p, report_key, order)
    spare = dedupe_scored(scored, p, order, 12).join(stories.select(*report_key).distinct(), report_key, "left_anti")
    return stories.unionByName(spare), dedupe_scored(scored, p, order, 15)


def section_rank(items: DataFrame, report_key: list[str], order: str = "rank", section: str = "section_id", limit: str = "max_items") -> DataFrame:
    """Items of each section in order, up to the section's own limit."""
    place = F.row_number().over(Window.partitionBy(*report_key, section).orderBy(order))
    return items.withColumn("section_rank", place).where(F.col("section_rank") <= F.col(limit))


def first_seen(items: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return items.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
