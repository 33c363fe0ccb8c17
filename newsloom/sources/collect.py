"""All sources as one article table, and snapshots of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import enrich_published_at
from newsloom.operators.gate import within_recency
from newsloom.operators.merge import insert_new_articles
from newsloom.operators.rank import first_seen
from newsloom.operators.scored import skip_known
from newsloom.sources.pages import fill_from_metadata

#: Readers by kind: (spark, sources of this kind) -> (articles, rejected rows or None).
Reader = Callable[[SparkSession, DataFrame], tuple[DataFrame, DataFrame | None]]


def union_sources(spark: SparkSession, sources: DataFrame, readers: dict[str, Reader]) -> tuple[DataFrame | None, DataFrame | None]:
    """(articles, rejected) of all kinds that have a reader; other kinds are skipped.

    A reader that raises (a folder that is missing, say) does not stop the others: its sources are among the rejected
    rows, with the error as ``_corrupt``.  If all readers raise there are no articles (None).
    """
    rows, rejected = None, None
    for kind, reader in readers.items():
        listed = sources.where(F.col("kind") == kind)
        try:
            own, bad = reader(spark, listed)
        except Exception as error:
            own, bad = None, listed.select("source", F.lit(f"{type(error).__name__}: {error}").alias("_corrupt"))
        if own is not None:
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if bad is not None:
            rejected = bad if rejected is None else rejected.unionByName(bad, allowMissingColumns=True)
    return rows, rejected


def newest_keys(as_of: str) -> list[Column]:
    """Newest first; undated rows count as now."""
    return [F.coalesce("published_at", F.lit(as_of).cast("timestamp")).desc(), F.col("content_hash")]


def collect_order(articles: DataFrame, as_of: str) -> DataFrame:
    return articles.orderBy(*newest_keys(as_of))


def collect(items: DataFrame, articles: DataFrame, sources: DataFrame, hours: int, as_of: str, metadata: DataFrame | None = None) -> DataFrame:
    """New items ready to insert: dates from texts, known ones out, metadata for what is still undated, recency, first seen.

    The expensive side (page metadata) only meets items that are new and undated.
    """
    items = items.withColumn("published_at", enrich_published_at(F.col("published_at"), F.col("title"), F.col("summary"), F.col("raw_excerpt")))
    items = skip_known(items, articles)
    if metadata is not None:
        undated = F.col("published_at").isNull()
        items = items.where(~undated).unionByName(fill_from_metadata(items.where(undated), metadata), allowMissingColumns=True)
    allowed = F.broadcast(sources.select("source", "allow_undated"))
    items = within_recency(items.join(allowed, "source", "left"), hours, as_of, allow_undated=F.col("allow_undated")).drop("allow_undated")
    items = first_seen(items, "content_hash", [F.col("source_ord"), F.col("url")])
    return insert_new_articles(articles, items.withColumn("collected_at", F.lit(as_of).cast("timestamp")))


def freeze_corpus(ranked: DataFrame, path: str) -> DataFrame:
    """A ranked candidate set written once and read by every model's run."""
    ranked.write.mode("errorifexists").parquet(path)
    return ranked.sparkSession.read.parquet(path)


def write_side_by_side(pivoted: DataFrame, path: str) -> None:
    """The models' results side by side as CSV with a header."""
    pivoted.write.mode("overwrite").option("header", True).csv(path)
