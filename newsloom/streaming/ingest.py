"""Incremental collection with Structured Streaming; each stream has a batch twin that shares its transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text import content_hash
from newsloom.operators.gate import within_recency
from newsloom.operators.inference import Infer, score
from newsloom.operators.keyed import KeyedTable
from newsloom.operators.merge import insert_new_articles
from newsloom.operators.rank import rank_for_scoring
from newsloom.operators.scored import unscored
from newsloom.profiles import Profile


def read_items(spark: SparkSession, path: str, schema: str, format_: str = "parquet", **options: str) -> DataFrame:
    """A stream of landed item files."""
    return spark.readStream.format(format_).schema(schema).options(**options).load(path)


def event_time() -> Column:
    return F.coalesce("published_at", "collected_at")


def dedupe_stream(items: DataFrame, delay: str = "72 hours") -> DataFrame:
    """The first row of each content hash inside the watermark; the keyed merge stays the guard beyond it."""
    hashed = items if "content_hash" in items.columns else items.withColumn("content_hash", content_hash())
    timed = hashed.withColumn("event_ts", event_time()).withWatermark("event_ts", delay)
    return timed.dropDuplicatesWithinWatermark(["content_hash"])


def recency_stream(items: DataFrame, hours: int, as_of: str) -> DataFrame:
    """Late items are dropped by the stateless recency rule; event_ts carries a watermark of the same length."""
    timed = items.withColumn("event_ts", event_time()).withWatermark("event_ts", f"{hours} hours")
    allowed = F.col("allow_undated") if "allow_undated" in items.columns else F.lit(True)
    return within_recency(timed, hours, as_of, allow_undated=allowed)


def source_counts(items: DataFrame, time: str, source: str) -> DataFrame:
    """Rows per day and source over tumbling windows; works on streams and on tables."""
    return items.groupBy(F.window(time, "1 day").alias("w"), F.col(source).alias("source")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "source", "n")


def source_counts_stream(items: DataFrame, time: str, source: str, delay: str = "72 hours") -> DataFrame:
    return source_counts(items.withWatermark(time, delay), time, source)


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of appended batches (one folder for each), if there is none yet."""
    spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").partitionBy("batch").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of a table, less those of batch ``before`` and later ones."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def append_batch(rows: DataFrame, path: str, schema: str, batch: int) -> None:
    """Write one batch; a batch that runs again replaces its own rows and no others."""
    names = rows.sparkSession.createDataFrame([], schema).columns
    rows.select(*names).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def new_rows(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key the table lacks.

    The table's keys (no other columns) meet the keys of this batch, and only those that it knows go on.
    """
    known = table.select(*key).join(rows.select(*key).distinct(), key, "left_semi").distinct()
    return rows.join(known, key, "left_anti")


def ingest_stream(items: DataFrame, path: str, schema: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append the stream's new articles, batch by batch, to the table at ``path``; ends when all landed files are read.

    Only new rows are written.  Articles that the table has (by content hash) and repeats inside a batch are left out.
    """
    def merge(batch: DataFrame, number: int) -> None:
        before = read_table(batch.sparkSession, path, schema, number)
        fresh = new_rows(prepare(batch) if prepare else batch, before, ["content_hash"])
        append_batch(insert_new_articles(before.select("content_hash", "article_id").limit(0), fresh).where("is_new"), path, schema, number)

    create_table(items.sparkSession, path, schema)
    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_keyed(items: DataFrame, table: KeyedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """``ingest_stream`` into a table that is keyed by content_hash: a batch meets only the partitions that hold its keys,
    and the table's keys are not shuffled.  A batch that runs again adds only the rows that it had not added."""
    def add(batch: DataFrame, number: int) -> None:
        fresh = table.new_rows(prepare(batch) if prepare else batch)
        known = table.read(batch.sparkSession).select("content_hash", "article_id").limit(0)
        table.append(insert_new_articles(known, fresh).where("is_new"))

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_pending(articles: DataFrame, path: str, schema: str, infer: Infer, p: Profile, provider: str, model: str, as_of: str, run: int, **limits) -> None:
    """Rank all articles that this model has not scored, score the best of them and append the scores as batch ``run``.

    What a run leaves (quotas, near-duplicates of what it takes) comes back in the next one.  A run that is repeated with
    its number replaces its own rows.
    """
    spark = articles.sparkSession
    known = spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") != run).drop("batch")
    todo = unscored(articles, known, provider, model)
    new, _ = score(rank_for_scoring(todo, p, as_of, **limits), known, infer, p, provider, model, as_of)
    append_batch(new, path, schema, run)


def score_stream(articles: DataFrame, path: str, schema: str, infer: Infer, p: Profile, provider: str, model: str, as_of: str, checkpoint: str, **limits) -> StreamingQuery:
    """Keep the stream's articles beside the scores (``path``-articles), and score the best unscored ones with each batch.

    Each batch ranks the whole backlog: articles that earlier batches left unscored compete with the new ones, and quotas
    and near-duplicates count over all of them.  Articles whose id is known are passed over; a repeated batch changes
    nothing.  ``score_pending`` over ``stream_articles`` goes on with the backlog when no new articles come.
    """
    kept, columns = f"{path.rstrip('/')}-articles", _ddl(articles)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = new_rows(batch, read_table(spark, kept, columns, number), ["article_id"]).dropDuplicates(["article_id"])
        append_batch(fresh, kept, columns, number)
        score_pending(read_table(spark, kept, columns), path, schema, infer, p, provider, model, as_of, number, **limits)

    create_table(articles.sparkSession, path, schema)
    create_table(articles.sparkSession, kept, columns)
    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_articles(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The articles that ``score_stream`` has kept beside the scores at ``path``; ``like`` has their columns."""
    return read_table(spark, f"{path.rstrip('/')}-articles", _ddl(like))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
