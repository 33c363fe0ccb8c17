"""Keyed merges.  Each takes a snapshot and changes and gives the new snapshot; storage is the caller's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schemas import LINEAGE_KEY, SCORE_KEY


def insert_new_articles(articles: DataFrame, items: DataFrame) -> DataFrame:
    """The items with their article_id and is_new; known content hashes keep their id, new ones get one.

    A new id is a hash of the content hash, so it needs no counter and no sort; the first of equal new items inserts.
    """
    known = articles.select("content_hash", F.col("article_id").alias("known_id"))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("collected_at", "url"))
    out = items.join(known, "content_hash", "left").withColumn("_k", first)
    new_id = F.xxhash64("content_hash").bitwiseAND(F.lit((1 << 63) - 1))
    return out.withColumn("article_id", F.coalesce("known_id", new_id)).withColumn("is_new", F.col("known_id").isNull() & (F.col("_k") == 1)).drop("known_id", "_k")


def last_wins(current: DataFrame, changes: DataFrame, key: list[str], time: str) -> DataFrame:
    """Union in which the latest row of each key stays; at equal times the change wins, and of several changes the one
    with the greatest other columns, in their order."""
    both = current.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)))
    others = [F.col(c).desc_nulls_last() for c in current.columns if c not in (*key, time)]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc(), F.col("_c").desc(), *others))
    return both.withColumn("_k", last).where("_k = 1").drop("_k", "_c")


def upsert_scores(scores: DataFrame, changes: DataFrame) -> DataFrame:
    return last_wins(scores, changes, SCORE_KEY, "scored_at")


def upsert_analyses(analyses: DataFrame, changes: DataFrame) -> DataFrame:
    """Last write wins on the lineage key; rows without full lineage are refused."""
    bad = " OR ".join(f"coalesce({c}, '') = ''" for c in LINEAGE_KEY[1:])
    return last_wins(analyses, changes.where(f"NOT ({bad})"), LINEAGE_KEY, "analyzed_at")


#: What an analysis refreshes in a tracker row; owner, status, id and created_at belong to people and stay.
REFRESHED = ["item_date", "source", "category", "title", "summary", "relevance_score", "entity", "impact", "suggested_action", "original_link"]


def merge_tracker(tracker: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Tracker rows merged with analysed items.

    New keys start without an owner as 'pending'; known ones get the analysis columns and updated_at.  The date of an
    item is its publication, else when it was collected.  Of several items with one key the latest by analyzed_at (where
    they have it) counts, and of equally late ones the one with the greatest columns in the order of REFRESHED.
    """
    at = F.lit(now).cast("timestamp")
    c = changes.withColumn("item_date", F.coalesce("published_at", "collected_at")).withColumn("original_link", F.col("url"))
    late = F.col("analyzed_at") if "analyzed_at" in c.columns else F.lit(None).cast("timestamp")
    c = c.groupBy(*LINEAGE_KEY).agg(F.max(F.struct(late.alias("late"), *REFRESHED)).alias("_last"))
    c = c.select(*LINEAGE_KEY, F.lit(True).alias("_hit"), *(F.col(f"_last.{x}").alias(f"_{x}") for x in REFRESHED))
    both = tracker.withColumn("_old", F.lit(True)).join(c, LINEAGE_KEY, "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    new_id = F.xxhash64(*LINEAGE_KEY).bitwiseAND(F.lit((1 << 63) - 1))
    return both.select(
        F.coalesce("id", new_id).alias("id"), *LINEAGE_KEY, *(F.when(hit, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in REFRESHED),
        "owner", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("created_at", at).alias("created_at"), F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*tracker.columns)


def apply_actions(tracker: DataFrame, actions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(tracker with people's owner and status changes, rejected actions).

    Null fields change nothing; an action for an unknown id or without any field is rejected.  Several actions on one id
    are one: each field takes its latest value by acted_at (where actions have it), else the greatest.
    """
    empty = F.col("owner").isNull() & F.col("status").isNull()
    at = F.col("acted_at") if "acted_at" in actions.columns else F.lit(None).cast("timestamp")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value"))))["value"]
    once = actions.where(~empty).groupBy("id").agg(last("owner").alias("new_owner"), last("status").alias("new_status"))
    out = tracker.join(once, "id", "left")
    touched = F.col("new_owner").isNotNull() | F.col("new_status").isNotNull()
    updated = F.when(touched, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    changed = out.withColumn("updated_at", updated).withColumn("owner", F.coalesce("new_owner", "owner")).withColumn("status", F.coalesce("new_status", "status")).drop("new_owner", "new_status")
    a = actions.select("id", F.col("owner").alias("new_owner"), F.col("status").alias("new_status"))
    unknown = a.join(tracker.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown id"))
    nothing = a.where("new_owner IS NULL AND new_status IS NULL").join(tracker.select("id"), "id", "left_semi").withColumn("reason", F.lit("no field to change"))
    return changed, unknown.unionByName(nothing)


def run_lifecycle(events: DataFrame) -> DataFrame:
    """One row for each run from its start and finish events; a run without a finish is still running."""
    finish = F.col("event") == "finish"
    last = lambda c: F.max_by(F.when(finish, F.col(c)), F.when(finish, F.col("ts")))
    return events.groupBy("run_id").agg(
        F.max_by("trigger_type", F.when(~finish, F.col("ts"))).alias("trigger_type"),
        F.min(F.when(~finish, F.col("ts"))).alias("started_at"),
        F.max(F.when(finish, F.col("ts"))).alias("finished_at"),
        F.coalesce(last("status"), F.lit("running")).alias("status"),
        last("source_count").alias("source_count"),
        last("story_count").alias("story_count"),
        F.coalesce(last("email_sent"), F.lit(False)).alias("email_sent"),
        last("error_message").alias("error_message"),
    )


def evolve_scores(old: DataFrame, columns: list[str], former: dict[str, str] | None = None, provider: str = "legacy", model: str = "legacy") -> DataFrame:
    """Score rows of an older layout in the canonical one.

    Missing provider and model get constants; a column falls back to the one that ``former`` names; columns that the
    layout lacks are null.
    """
    has, former, constants = set(old.columns), former or {}, {"provider": provider, "model": model}

    def filled_from(name: str) -> Column:
        found = [F.col(c) for c in (name, former.get(name)) if c in has] + [F.lit(v) for k, v in constants.items() if k == name]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return old.select(*(filled_from(c).alias(c) for c in columns))


def expire_reports(runs: DataFrame, days: int, as_of: str) -> DataFrame:
    """Reports of the retention period; zero or less keeps all."""
    if days <= 0:
        return runs
    return runs.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def append_summary_runs(reports: DataFrame) -> DataFrame:
    """Report rows ready to append: the four lineage columns fall back to provider and model."""
    for role in ("scoring", "analysis"):
        for part in ("provider", "model"):
            reports = reports.withColumn(f"{role}_{part}", F.coalesce(f"{role}_{part}", part))
    return reports.withColumn("run_date", F.to_date("generated_at"))


def write_summary_runs(reports: DataFrame, path: str) -> None:
    """Append report rows, partitioned by profile and day."""
    append_summary_runs(reports).write.mode("append").partitionBy("profile_id", "run_date").parquet(path)


def latest_report(runs: DataFrame) -> DataFrame:
    """The newest successful report of each profile, lineage filled in."""
    good = append_summary_runs(runs.where("status = 'success'")).drop("run_date")
    return good.groupBy("profile_id").agg(F.max_by(F.struct(*good.columns), F.struct("generated_at", "run_id")).alias("r")).select("r.*")
