"""Model stages as Spark jobs.  The model is an injected function; one for tests ships here.

``infer(prompts) -> replies`` gets a list of prompts and returns as many replies (None where a call failed).  It runs
inside tasks, so the number of partitions is the number of calls at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.functions.replies import extract_json, parse_analysis, parse_score
from newsloom.functions.text import filled
from newsloom.operators.scored import need_lineage, related_items, unscored
from newsloom.profiles import Profile
from newsloom.tables import ensure_checkpoints

Infer = Callable[[list[str]], list[str | None]]

#: Prompt templates are data; these name every field that a stage offers.
SCORE_PROMPT = "Rate this item for {profile}.\nSource: {source}\nTitle: {title}\nLink: {url}\nDate: {published}\nText: {text}"
ANALYSIS_PROMPT = "Assess this rated item.\nTitle: {title}\nSource: {source}\nLink: {url}\nDate: {published}\nCategory: {category}\nSignal: {signal}\nRating: {relevance}\nConfidence: {confidence}\nSummary: {summary}\nReason: {why}\nOther items:\n{related}"
STORY_PROMPT = "- [{relevance}] {title} ({source})\n  {category} | {signal} | {confidence}\n  {summary}\n  {why}"


def filled_prompt(template: str, **fields: Column) -> Column:
    """The template with its {fields} replaced by columns; null reads as an empty text."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _published() -> Column:
    return F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("unknown"))


def score_prompt(p: Profile, template: str = SCORE_PROMPT) -> Column:
    text = F.coalesce(filled("summary", "raw_excerpt"), F.lit("(none)"))
    return filled_prompt(template, profile=F.lit(p.id), source=F.col("source"), title=F.col("title"), url=F.col("url"), published=_published(), text=text)


def analysis_prompt(template: str = ANALYSIS_PROMPT) -> Column:
    """The prompt of an item that carries ``related`` (an array of rated items)."""
    line = lambda r: F.concat(F.lit("- ["), F.coalesce(r["relevance_score"].cast("string"), F.lit("")), F.lit("] "), F.coalesce(r["title"], F.lit("")), F.lit(" ("), F.coalesce(r["source"], F.lit("")), F.lit(")"))
    related = F.coalesce(filled(F.array_join(F.transform("related", line), "\n")), F.lit("(none)"))
    return filled_prompt(
        template, title=F.col("title"), source=F.col("source"), url=F.col("url"), published=_published(), category=F.col("category"), signal=F.col("signal"),
        relevance=F.col("relevance_score"), confidence=F.col("confidence"), summary=F.col("summary"), why=F.col("why_it_matters"), related=related,
    )


def _ask(infer: Infer, prompts: list[str]) -> list[str | None]:
    """The model's replies; a batch that raises is tried in single calls, and a call that raises gives None."""
    try:
        replies = infer(prompts)
        if len(replies) != len(prompts):
            raise ValueError("one reply for each prompt is needed")
        return replies
    except Exception:
        return [None] if len(prompts) == 1 else [r for p in prompts for r in _ask(infer, [p])]


@dataclass(frozen=True)
class ReplyLog:
    """Where tasks keep replies as they come (a folder that all machines share), and the model that gave them."""

    path: str
    model: str

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/model={hashlib.sha256(self.model.encode()).hexdigest()[:16]}"

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, reply) of this model; a key is the SHA-256 of a prompt.  One row for a key, though a call that was in
        flight when its machine was lost may have been made, and logged, twice."""
        spark.createDataFrame([], "key string, reply string").write.mode("ignore").parquet(self.folder)
        return spark.read.schema("key string, reply string").parquet(self.folder).groupBy("key").agg(F.min("reply").alias("reply"))

    def compact(self, spark: SparkSession, path: str) -> ReplyLog:
        """The same log in few files in a new folder; tasks write a file for each batch of calls."""
        self.read(spark).write.parquet(ReplyLog(path, self.model).folder)
        return ReplyLog(path, self.model)


def _log_replies(prompts: DataFrame, infer: Infer, log: ReplyLog, batch: int) -> None:
    """Ask for (key, prompt) rows and write a file for each batch of calls, before the next batch is asked.

    Rows are sorted in their partitions, so a task that runs again makes the same batches, finds those that are written
    and goes on after them.  Failed calls are not logged.
    """
    folder = log.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        rows = (part for b in batches for part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        while part := list(islice(rows, batch)):
            name = f"{root}/batch-{hashlib.sha256(''.join(k for k, _ in part).encode()).hexdigest()}.parquet"
            if store.get_file_info(name).type == fs.FileType.NotFound:
                got = [(k, r) for (k, _), r in zip(part, _ask(infer, [p for _, p in part]), strict=True) if r is not None]
                if got:  # a batch that failed as a whole leaves no file, so that it can come again
                    hidden = f"{root}/_{uuid.uuid4().hex}"  # readers pass over it until it has its name
                    pq.write_table(pa.table({"key": pa.array([k for k, _ in got], pa.string()), "reply": pa.array([r for _, r in got], pa.string())}), hidden, filesystem=store)
                    store.move(hidden, name)
            yield pa.RecordBatch.from_pydict({"asked": pa.array([len(part)], pa.int64())})

    prompts.sortWithinPartitions("key").mapInArrow(run, "asked long").agg(F.sum("asked")).collect()


def with_replies(df: DataFrame, infer: Infer, prompt: str = "prompt", calls_at_once: int | None = None, batch: int = 32, log: ReplyLog | None = None) -> DataFrame:
    """Rows with ``reply``; a batch whose call raises is tried row by row, and a row that raises has a null reply.

    With a log, equal prompts are asked once, prompts that the log has are not asked, and replies are kept as they come:
    after a lost machine, a failed job or in a later run only what has no reply is asked (failed calls included).
    """
    if log is not None:
        spark = df.sparkSession
        keyed = df.withColumn("_key", F.sha2(F.col(prompt), 256))
        todo = keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
        todo = todo.join(log.read(spark).select("key"), "key", "left_anti")
        _log_replies(todo.repartition(calls_at_once, "key") if calls_at_once else todo.repartition("key"), infer, log, batch)
        return keyed.join(log.read(spark).withColumnRenamed("key", "_key"), "_key", "left").select(*df.columns, "reply")
    column = df.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_ask(infer, part.column(column).to_pylist()), pa.string())], names=[*b.schema.names, "reply"])

    rows = df.repartition(calls_at_once) if calls_at_once else df
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("reply", StringType())]))


def score(candidates: DataFrame, scores: DataFrame, infer: Infer, p: Profile, provider: str, model: str, now: str, calls_at_once: int | None = None, log: ReplyLog | None = None) -> tuple[DataFrame, DataFrame]:
    """(new scores, dead letters) for candidates that this model has not scored; failing rows are dropped to the latter.

    The model is called once: its replies are kept in the shared folder, and both results read them.
    """
    need_lineage(provider=provider, model=model)
    todo = unscored(candidates, scores, provider, model).withColumn("prompt", score_prompt(p))
    replied = with_replies(todo, infer, calls_at_once=calls_at_once, log=log)
    parsed = replied.select("article_id", *parse_score(category_field=p.category_field, signal_field=p.signal_field), F.col("reply").alias("model_raw"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(now).cast("timestamp").alias("scored_at"))
    ensure_checkpoints(candidates.sparkSession)
    parsed = parsed.checkpoint()
    return parsed.where("relevance_score IS NOT NULL"), parsed.where("relevance_score IS NULL").select("article_id", "provider", "model", "model_raw")


def dry_run(candidates: DataFrame, scores: DataFrame, provider: str, model: str) -> DataFrame:
    """How many candidates would be scored."""
    return unscored(candidates, scores, provider, model).agg(F.count("*").alias("to_score"))


def analyze(items: DataFrame, infer: Infer, p: Profile, lineage: dict[str, str], now: str, batch_key: list[str], order: str = "rank", context: Callable[[DataFrame], DataFrame] | None = None, calls_at_once: int | None = None, log: ReplyLog | None = None) -> DataFrame:
    """Analyses of items with up to eight related ones as context; a failing row falls back to its scoring fields."""
    need_lineage(**lineage)
    ready = (context or (lambda df: related_items(df, batch_key, order)))(items).withColumn("prompt", analysis_prompt())
    fields = ["article_id", "category", "why_it_matters", "summary", "prompt"]
    replied = with_replies(ready.select(*fields), infer, calls_at_once=calls_at_once, log=log)
    return replied.select(
        "article_id", F.lit(p.id).alias("profile_id"), *(F.lit(lineage[k]).alias(k) for k in ("scoring_provider", "scoring_model", "analysis_provider", "analysis_model")),
        *parse_analysis(), F.when(extract_json(F.col("reply")).isNotNull(), F.col("reply")).otherwise(F.lit("")).alias("model_raw"), F.lit(now).cast("timestamp").alias("analyzed_at"),
    )


def narrate(items: DataFrame, infer: Infer, p: Profile, report_key: list[str], order: str = "rank", most: int = 12, template: str = STORY_PROMPT, log: ReplyLog | None = None) -> DataFrame:
    """(report key, narrative, watchlist) for each report from its first items; a failure gives the profile's texts."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*report_key).orderBy(order))
    story = filled_prompt(template, relevance=F.col("relevance_score"), title=F.col("title"), source=F.col("source"), category=F.col("category"), signal=F.col("signal"), confidence=F.col("confidence"), summary=F.col("summary"), why=F.col("why_it_matters"))
    lines = items.withColumn("_n", place).where(F.col("_n") <= most).select(*report_key, "_n", story.alias("_line"))
    prompts = lines.groupBy(*report_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n\n").alias("prompt"))
    replied = with_replies(prompts, infer, log=log)
    o = F.from_json(extract_json(F.col("reply")), "executive_summary string, watchlist array<string>")
    return replied.select(
        *report_key, F.coalesce(filled(o["executive_summary"]), F.lit(p.fallback_narrative)).alias("narrative"),
        F.when(F.size(F.coalesce(o["watchlist"], F.array().cast("array<string>"))) > 0, o["watchlist"]).otherwise(F.array(*map(F.lit, p.default_watchlist)).cast("array<string>")).alias("watchlist"),
    )


def rule_based_infer(prompts: list[str]) -> list[str | None]:
    """A deterministic stand-in for a model: the score is the prompt's length modulo 101."""
    return [json.dumps({"relevance_score": len(x) % 101, "category": "other", "signal": "unclear", "confidence": "low", "summary": x[:40], "why_it_matters": "", "entity": "n/a", "impact": "length %d" % len(x), "executive_summary": "%d characters" % len(x), "watchlist": []}) for x in prompts]
