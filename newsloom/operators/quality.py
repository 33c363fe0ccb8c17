"""Aggregates for quality assurance: counts, distributions, staleness, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS = 7


def corpus_stats(articles: DataFrame, scores: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One row: articles, score rows, and articles that are new in this run."""
    counts = [articles.agg(F.count("*").alias("articles")), scores.agg(F.count("*").alias("scores"))]
    if new is not None:
        counts.append(new.agg(F.count_if("is_new").alias("new_articles")))
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def articles_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source")


def items_per_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source", "kind").agg(F.count("*").alias("n"))


def scores_by_model(scores: DataFrame) -> DataFrame:
    return scores.groupBy("provider", "model").agg(F.count("*").alias("n")).orderBy("provider", "model")


def distinct_models(scores: DataFrame) -> DataFrame:
    return scores.select("provider", "model").distinct().orderBy("provider", "model")


def score_distribution(scores: DataFrame) -> DataFrame:
    """Per model: least, greatest and mean score (one decimal)."""
    s = F.col("relevance_score")
    return scores.groupBy("provider", "model").agg(F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.round(F.avg(s), 1).alias("mean_score"))


def label_histogram(scores: DataFrame, fields: tuple[str, ...] = ("confidence", "signal")) -> DataFrame:
    """Long form: per model, field and label the number of rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in fields)))
    long = scores.select("provider", "model", pairs.alias("x")).select("provider", "model", "x.field", "x.label")
    return long.groupBy("provider", "model", "field", "label").agg(F.count("*").alias("n"))


def label_maps(scores: DataFrame) -> DataFrame:
    """The same as one map for each model and field."""
    return label_histogram(scores).groupBy("provider", "model", "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days between a time and ``as_of``; null for an undated row."""
    return F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(ts)) / 86400)


def staleness(scored: DataFrame, as_of: str, days: int = STALE_DAYS) -> DataFrame:
    """Per model: rows older than ``days``, undated rows (unknown, not stale), and all rows."""
    age = age_days(F.col("published_at"), as_of)
    return scored.groupBy("provider", "model").agg(F.count_if(age > days).alias("stale"), F.count_if(age.isNull()).alias("undated"), F.count("*").alias("total"))


def missing_dates(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_if(F.col("published_at").isNull()).alias("undated"), F.count("*").alias("total"))


def scored_listing(scored: DataFrame, as_of: str) -> DataFrame:
    """Scored articles by model and relevance, with their age."""
    out = scored.withColumn("age_days", age_days(F.col("published_at"), as_of))
    return out.orderBy("provider", "model", F.col("relevance_score").desc(), "article_id")


def report_totals(items: DataFrame, report_key: list[str]) -> DataFrame:
    """Per report: articles, best score (0 without any) and stories."""
    return items.groupBy(*report_key).agg(F.count("*").alias("article_count"), F.coalesce(F.max("relevance_score"), F.lit(0)).alias("top_score"), F.count_if("is_story").alias("story_count"))


def model_coverage(frozen: DataFrame, models: DataFrame, scores: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per model over a frozen set: attempted, scored now, skipped (scored before) and failed.

    ``scores`` are those before the run; ``attempts`` are this run's tries (article_id, provider, model, ok).
    """
    key = ["article_id", "provider", "model"]
    items = frozen.select("article_id").distinct()
    had = scores.select(*key).distinct().join(items, "article_id", "left_semi")
    done = attempts.where("ok").select(*key).distinct().join(items, "article_id", "left_semi").join(had, key, "left_anti")
    per = had.groupBy("provider", "model").agg(F.count("*").alias("skipped"))
    ok = done.groupBy("provider", "model").agg(F.count("*").alias("scored"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = models.select("provider", "model").distinct().join(per, ["provider", "model"], "left").join(ok, ["provider", "model"], "left")
    attempted = F.lit(items.count()) - none("skipped")
    return out.select("provider", "model", attempted.alias("attempted"), none("scored").alias("scored"), none("skipped").alias("skipped"), (attempted - none("scored")).alias("failed"))


def daily_source_counts(events: DataFrame, time: str, source: str) -> DataFrame:
    """Rows per day and source; the batch twin of the streaming counts."""
    return events.groupBy(F.date_trunc("day", F.col(time)).alias("day"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
