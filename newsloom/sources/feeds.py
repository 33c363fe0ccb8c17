"""Landed feed files (RSS and Atom) to article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_feed_date
from newsloom.functions.text import BODY_CHARS, EXCERPT_CHARS, SUMMARY_CHARS, content_hash, filled, strip_html
from newsloom.operators.gate import feed_entry_allowed

_RSS = "title string, link string, pubDate string, `dc:date` string, description string, `content:encoded` string, _corrupt string"
_ATOM = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, content string, _corrupt string"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema)
    return reader.load(path).withColumn("_file", F.col("_metadata.file_path"))


#: The source in a file's path: the file's name, or a folder ``source=...``.
BY_NAME, BY_FOLDER = r"([^/]+?)(?:\.[^./]*)?$", r"/source=([^/]+)/"


def read_feed_items(spark: SparkSession, path: str, sources: DataFrame, source_in_path: str = BY_NAME) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected entries) of the feed files under ``path``; a file is named after its source (``<source>.xml``),
    or ``source_in_path`` says where its path has it.

    Entries need a title and a url, and must pass their source's patterns.  The first date that parses counts; the
    summary is the feed's full text where the source prefers it and the feed has it.  Entries that cannot be parsed go
    to the rejected ones instead of failing the job.
    """
    rss = _read(spark, path, "item", _RSS)
    rss = rss.select("_file", "_corrupt", "title", "link", parse_feed_date(F.col("pubDate"), F.col("`dc:date`")).alias("published_at"), F.col("description").alias("text"), F.col("`content:encoded`").alias("body"))
    atom = _read(spark, path, "entry", _ATOM)
    href = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"], F.get("link", 0)["_href"])
    atom = atom.select("_file", "_corrupt", "title", href.alias("link"), parse_feed_date(F.col("published"), F.col("updated")).alias("published_at"), F.col("summary").alias("text"), F.col("content").alias("body"))
    both = rss.unionByName(atom).withColumn("source", F.regexp_extract("_file", source_in_path, 1))
    # Spark parses a record only if some column besides the corrupt one is asked for
    rejected = both.where("_corrupt IS NOT NULL AND length(coalesce(title, '')) >= 0").select("source", "_corrupt")
    rows = both.where("_corrupt IS NULL").withColumn("title", F.trim("title")).withColumn("url", F.trim("link")).where("title <> '' AND url <> ''")
    rows = rows.join(F.broadcast(sources.where("kind = 'rss'").select("source", "exclude_patterns", "link_patterns", "prefer_feed_content", "source_ord")), "source")
    rows = rows.where(feed_entry_allowed(F.col("url"), F.col("title"), F.col("exclude_patterns"), F.col("link_patterns")))
    body = F.when(F.col("prefer_feed_content"), F.substring(strip_html(F.col("body")), 1, BODY_CHARS))
    rows = rows.withColumn("summary", F.coalesce(filled(body), F.substring(strip_html(F.col("text")), 1, SUMMARY_CHARS), F.lit("")))
    out = rows.select("source", F.lit("rss").alias("kind"), "source_ord", "title", "url", "published_at", "summary", content_hash().alias("content_hash"), F.substring("summary", 1, EXCERPT_CHARS).alias("raw_excerpt"))
    return out, rejected
