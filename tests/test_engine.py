"""Gates, merges, model stages, memos and streams on small rows."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions.replies import parse_score
from newsloom.operators import gate, inference, keyed, many_profiles, merge, rank, scored
from newsloom.plans.views import AS_OF, PROFILE, PROFILES, analyses_v, articles_v, scores_v
from newsloom.profiles import EntityRule, Profile, Source, TitleRule, for_profiles
from newsloom.schemas import SCORES, TRACKER
from newsloom.sources.collect import freeze_corpus
from newsloom.streaming import ingest

GATE = Profile(
    "g", sources=(Source("official", tier=4),), noisy=frozenset({"noise"}), tiers={"direct": ("usdjpy",), "strong": ("boj", "rate"), "weak": ("forex",)}, high_priority_tiers=("strong",),
    title_rules=(TitleRule("boj", "statement", "boj_macro"),), entity_rules=(EntityRule("official", (("Acme", ("acme corp",)),), ("storage",), 1, 1, 2),),
)
ART = "article_id long, source string, title string, summary string, raw_excerpt string, published_at timestamp, collected_at timestamp"


def art(k, source, title, summary=""):
    return (k, source, title, summary, None, None, datetime(2024, 1, 1))


def test_gate_and_priority(spark):
    rows = [art(1, "noise", "Forex forex today"), art(2, "noise", "USDJPY jumps"), art(3, "noise", "BoJ rate news"), art(4, "boj_news", "A Statement on things"), art(5, "other", "nothing"), art(6, "official", "Acme Corp storage", None)]
    got = {r["article_id"]: r for r in gate.prioritized(gate.annotate(spark.createDataFrame(rows, ART), GATE), GATE).collect()}
    assert {k: r["keyword_hits"] for k, r in got.items()} == {1: [], 2: ["usdjpy"], 3: ["boj", "rate"], 4: ["boj_macro"], 5: [], 6: []}
    # the tag itself holds a strong keyword; a noisy source loses one point
    assert {k: r["priority"] for k, r in got.items()} == {1: 1, 2: 4, 3: 8, 4: 1 + 2 + 3 + 2, 5: 2, 6: 4 + 2}
    assert got[6]["boost_signals"] == ["source_boost:official", "entity:Acme", "entity_context:storage"]
    assert sorted(r["article_id"] for r in gate.gated(spark.createDataFrame(rows, ART), GATE).collect()) == [2, 3, 4, 5, 6]
    both = for_profiles(spark.createDataFrame(rows, ART), [GATE, PROFILE], gate.annotate)
    assert both.groupBy("profile_id").count().count() == 2


def test_many_profiles_equal_one_by_one(spark, sf_dir):
    articles = articles_v(spark, sf_dir).select(*(c.split()[0] for c in ART.split(", ")))
    odd = [art(-1, "src1", None, None), art(-2, None, "rate oil", ""), art(-3, "src16", "", ""), art(-4, "elsewhere", "rate"), art(-5, "src4", "OIL Rate " * 3000)]
    articles = articles.unionByName(spark.createDataFrame(odd + odd[:1], ART))
    columns = ["article_id", "profile_id", "keyword_hits", "prefilter_hit", "tier", "is_noisy", "boost", "boost_signals", "priority"]
    show = lambda df: sorted(map(repr, df.select(*columns).collect()))
    one = lambda df, p: gate.prioritized(gate.gated(df.where(F.col("source").isin(many_profiles.listed_sources(p))), p), p)
    # sources that a profile only names as noisy have its default tier in both
    got = many_profiles.prioritized_profiles(articles, PROFILES)
    assert got.columns == ["profile_id", *articles.columns, *columns[2:]]
    assert show(got) == show(for_profiles(articles, PROFILES, one))
    assert many_profiles.prioritized_profiles(articles.limit(0), PROFILES).count() == 0


def test_title_rules_have_ascii_words(spark):
    """Java 17 takes letters beyond ASCII for parts of words, RE2 and later Javas do not."""
    p = Profile("w", sources=(Source("s"),), title_rules=(TitleRule("s", r"\b(ou|y)\b", "word"), TitleRule("s", r"^k\\b|x\Bz", "other"), TitleRule("s", "école", "school")))
    titles = ["Anaieux éé èçou éç.", "ÉÉOU!!", "you", "çyç", "ou", "K\\b", "xz", "x z", "L'ÉCOLE", None]
    rows = spark.createDataFrame([art(k, "s", t) for k, t in enumerate(titles)], ART)
    want = [["word"], ["word"], [], ["word"], ["word"], ["other"], ["other"], [], ["school"], []]
    assert [r["keyword_hits"] for r in gate.annotate(rows, p).orderBy("article_id").collect()] == want
    # no hit is an empty list here, as there
    assert [r["keyword_hits"] for r in many_profiles.prioritized_profiles(rows, [p]).orderBy("article_id").collect()] == want


def test_many_profiles_scan_once(spark, sf_dir):
    many = [replace(PROFILES[k % 3], id=f"p{k}") for k in range(200)]
    got = many_profiles.prioritized_profiles(articles_v(spark, sf_dir), many)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sizes = {r["profile_id"]: r["count"] for r in got.groupBy("profile_id").count().collect()}
    assert len(sizes) == 200 and all(n == sizes[f"p{int(p[1:]) % 3}"] for p, n in sizes.items())
    with pytest.raises(ValueError):
        many_profiles.prioritized_profiles(articles_v(spark, sf_dir), [PROFILE, PROFILE])


def test_many_profiles_empty_words(spark):
    p = Profile("e", sources=(Source("s"),), tiers={"direct": ("",), "strong": ("İx",)}, entity_rules=(EntityRule("s", (("Any", ("",)),)),))
    rows = spark.createDataFrame([art(1, "s", "abc"), art(2, "s", None, None), art(3, "s", "İX")], ART)
    columns = ["article_id", "keyword_hits", "boost", "priority"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (many_profiles.prioritized_profiles(rows, [p]), gate.prioritized(gate.gated(rows, p), p)))
    assert got == want
    assert many_profiles.prioritized_profiles(rows, [Profile("none", sources=(Source("s"),))]).count() == 3


def test_recency_edges(spark):
    as_of = "2024-01-10 00:00:00"
    rows = [(1, None), (2, datetime(2024, 1, 7)), (3, datetime(2024, 1, 6, 23, 59, 59)), (4, datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "id int, published_at timestamp")
    assert [r["id"] for r in gate.within_recency(df, 72, as_of).collect()] == [2, 4]
    assert [r["id"] for r in gate.within_recency(df, 72, as_of, allow_undated=F.lit(True)).collect()] == [1, 2, 4]


def test_lineage_is_mandatory(spark, sf_dir):
    s, a = scores_v(spark, sf_dir), articles_v(spark, sf_dir)
    with pytest.raises(ValueError):
        scored.unscored(a, s, "", "m0")
    assert scored.unscored(a, s, "p0", "m0", []).count() == 0
    assert scored.lineage_filter(scored.scored_articles(s, a), "p0", "m1").count() == 0


def test_insert_ignores_repeats(spark):
    known = spark.createDataFrame([(7, "h1")], "article_id long, content_hash string")
    items = spark.createDataFrame([("h1", "u", datetime(2024, 1, 1)), ("h2", "u", datetime(2024, 1, 1)), ("h2", "v", datetime(2024, 1, 2))], "content_hash string, url string, collected_at timestamp")
    got = sorted((r["content_hash"], r["url"], r["is_new"], r["article_id"] == 7) for r in merge.insert_new_articles(known, items).collect())
    assert got == [("h1", "u", False, True), ("h2", "u", True, False), ("h2", "v", False, False)]


def test_tracker_keeps_human_columns(spark, sf_dir):
    items = scored.scored_articles(scores_v(spark, sf_dir), articles_v(spark, sf_dir)).where("provider = 'p0'").drop("category", "provider", "model").join(analyses_v(spark, sf_dir).drop("model_raw"), "article_id").limit(1)
    first = merge.merge_tracker(spark.createDataFrame([], TRACKER), items, "2024-01-01")
    (row,) = first.collect()
    assert (row["owner"], row["status"]) == (None, "pending")
    actions = spark.createDataFrame([(row["id"], "ann", None), (row["id"] + 1, "bob", None), (row["id"], None, None)], "id long, owner string, status string")
    changed, rejected = merge.apply_actions(first, actions, "2024-01-02")
    assert sorted(r["reason"] for r in rejected.collect()) == ["no field to change", "unknown id"]
    again = merge.merge_tracker(spark.createDataFrame(changed.collect(), TRACKER), items.withColumn("impact", F.lit("new")), "2024-01-03").first()
    assert (again["owner"], again["impact"], again["created_at"], again["updated_at"], again["id"]) == ("ann", "new", datetime(2024, 1, 1), datetime(2024, 1, 3), row["id"])
    assert scored.tracker_query(changed, "demo", owner="ann").count() == 1 and scored.tracker_query(changed, "x").count() == 0


@pytest.mark.parametrize(
    ("reply", "score", "category"),
    [('```json\n{"relevance_score": 85, "category": "fx"}\n```', 85, "fx"), ('Sure: {"relevance_score": "85"} ok', 85, "other"), ("{}", 0, "other"), ('{"relevance_score": null}', 0, "other"), ('{"relevance_score": "high"}', None, "other"), ("no", None, "other"), (None, None, "other")],
)
def test_reply_forms(spark, reply, score, category):
    row = spark.createDataFrame([(reply, "t", "s")], "reply string, title string, source string").select(*parse_score()).first()
    assert (row["relevance_score"], row["category"], row["source_citation"]) == (score, category, "t (s)")


def test_model_stages(spark):
    def flaky(prompts):
        if any("Title: boom" in p for p in prompts):
            raise RuntimeError("down")
        return inference.rule_based_infer(prompts)

    rows = [(1, "s", "boom", "u", "", None, None, datetime(2024, 1, 1)), (2, "s", "fine", "u", "x", None, None, datetime(2024, 1, 1)), (3, "s", "known", "u", "x", None, None, datetime(2024, 1, 1))]
    arts = spark.createDataFrame(rows, "article_id long, source string, title string, url string, summary string, raw_excerpt string, published_at timestamp, collected_at timestamp")
    have = spark.createDataFrame([(3, "p", "m")], "article_id long, provider string, model string")
    good, bad = inference.score(arts, have, flaky, PROFILE, "p", "m", AS_OF, 2)
    assert [r["article_id"] for r in good.collect()] == [2] and [r["article_id"] for r in bad.collect()] == [1]
    assert inference.dry_run(arts, have, "p", "m").first()[0] == 2
    items = arts.withColumn("category", F.lit("c")).withColumn("why_it_matters", F.lit("w")).withColumn("rank", F.col("article_id")).withColumn("signal", F.lit("")).withColumn("relevance_score", F.lit(1)).withColumn("confidence", F.lit("low"))
    lineage = dict.fromkeys(("scoring_provider", "scoring_model", "analysis_provider", "analysis_model"), "x")
    got = {r["article_id"]: (r["category"], r["impact"][:6], r["entity"]) for r in inference.analyze(items.where("article_id < 3"), flaky, PROFILE, lineage, AS_OF, ["source"]).collect()}
    assert got[2][0] == "c" or got[2][0] == "other"
    assert got[1] == ("c", "w", "n/a")
    story = inference.narrate(items, lambda ps: [None for _ in ps], PROFILE, ["source"]).first()
    assert (story["narrative"], story["watchlist"]) == (PROFILE.fallback_narrative, ["Next release"])


def test_rank_is_independent_of_partitions(spark, sf_dir):
    a = articles_v(spark, sf_dir)
    one, seven = ([tuple(r) for r in rank.rank_for_scoring(a.repartition(n), PROFILE, AS_OF).select("article_id", "slot").orderBy("slot").collect()] for n in (1, 7))
    assert one == seven and len(one) == 25


def test_frozen_set_and_report_rows(spark, sf_dir, tmp_path):
    frozen = freeze_corpus(gate.gated(articles_v(spark, sf_dir), PROFILE).select("article_id"), str(tmp_path / "frozen"))
    assert frozen.count() > 0
    runs = spark.createDataFrame([("p", "r1", datetime(2024, 1, 2), "success", "x", "y", None, None, "z", None)], "profile_id string, run_id string, generated_at timestamp, status string, provider string, model string, scoring_provider string, scoring_model string, analysis_provider string, analysis_model string")
    for _ in range(2):
        merge.write_summary_runs(runs, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == 2 and back.first()["scoring_model"] == "y" and back.first()["analysis_provider"] == "z"


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    items = articles_v(spark, sf_dir).drop("article_id")
    for k in range(2):  # the same items land twice
        items.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = ingest.read_items(spark, str(tmp_path / "in/*"), items._jdf.schema().toDDL(), maxFilesPerTrigger="1")
    columns = "article_id bigint, " + items._jdf.schema().toDDL()
    path = str(tmp_path / "articles")
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest_stream(stream, path, columns, str(tmp_path / "ck")).awaitTermination()
    table = ingest.read_table(spark, path, columns)
    assert table.count() == items.select("content_hash").distinct().count()
    some = spark.createDataFrame(table.limit(3).collect(), table.schema)
    ingest.append_batch(some, path, columns, 1)  # a batch that runs again replaces its own rows
    assert ingest.read_table(spark, path, columns).count() == items.select("content_hash").distinct().count() + 3
    ingest.append_batch(some.limit(0), path, columns, 1)
    table = ingest.read_table(spark, path, columns)
    assert table.count() == items.select("content_hash").distinct().count()

    out = ingest.dedupe_stream(stream).select("content_hash").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    out.awaitTermination()
    assert spark.table("deduped").count() == items.select("content_hash").distinct().count()

    fresh = ingest.recency_stream(stream, 72, AS_OF).select("content_hash").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck3")).start()
    fresh.awaitTermination()
    assert spark.table("fresh").distinct().count() == gate.within_recency(items, 72, AS_OF, allow_undated=F.lit(True)).select("content_hash").distinct().count()

    counts = ingest.source_counts_stream(stream, "collected_at", "source").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck4")).start()
    counts.awaitTermination()
    last = spark.table("counts").groupBy("day", "source").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, ingest.source_counts(items.union(items), "collected_at", "source").collect()))

    table.coalesce(1).write.parquet(str(tmp_path / "ready"))
    ready = ingest.read_items(spark, str(tmp_path / "ready"), columns)
    ingest.score_stream(ready, str(tmp_path / "scores"), SCORES, inference.rule_based_infer, PROFILE, "p", "m", AS_OF, str(tmp_path / "ck5")).awaitTermination()
    assert ingest.read_table(spark, str(tmp_path / "scores"), SCORES).count() == 25


def test_backlog_of_the_scoring_stream(spark, sf_dir, tmp_path):
    """Two batches and a run without news: each takes the best of all that is unscored, as one list of runs would."""
    table = articles_v(spark, sf_dir).repartition(2, "article_id")
    table.write.parquet(str(tmp_path / "ready"))
    stream = ingest.read_items(spark, str(tmp_path / "ready"), ingest._ddl(table), maxFilesPerTrigger="1")
    out, args = str(tmp_path / "scores"), (SCORES, inference.rule_based_infer, PROFILE, "p", "m", AS_OF)
    ingest.score_stream(stream, out, *args, str(tmp_path / "ck")).awaitTermination()
    kept = ingest.stream_articles(spark, out, table)
    batches = spark.read.schema(f"{ingest._ddl(table)}, batch long").parquet(f"{out}-articles")
    assert kept.count() == table.count() and {r["batch"] for r in batches.select("batch").distinct().collect()} == {0, 1}
    ingest.score_pending(kept, out, *args, 2)
    ingest.score_pending(kept, out, *args, 2)  # repeated: the same rows
    got = {n: [r["article_id"] for r in spark.read.schema(f"{SCORES}, batch long").parquet(out).where(F.col("batch") == n).collect()] for n in range(3)}
    done = []
    for n in range(3):
        todo = batches.where(F.col("batch") <= n).drop("batch").where(~F.col("article_id").isin(done)) if done else batches.where(F.col("batch") <= n).drop("batch")
        best = [r["article_id"] for r in rank.rank_for_scoring(todo, PROFILE, AS_OF).select("article_id").collect()]
        assert sorted(best) == sorted(got[n]) and len(best) == 25
        done += best
    assert len(set(done)) == 75


def test_repeated_keys_in_changes(spark, sf_dir):
    """Changes that name a key twice give one row, whatever their order."""
    items = scored.scored_articles(scores_v(spark, sf_dir), articles_v(spark, sf_dir)).where("provider = 'p0'").drop("category", "provider", "model").join(analyses_v(spark, sf_dir).drop("model_raw"), "article_id").limit(1)
    twice = items.withColumn("impact", F.lit("late")).unionByName(items.withColumn("impact", F.lit("early")).withColumn("analyzed_at", F.col("analyzed_at") - F.expr("INTERVAL 1 DAY")))
    (row,) = merge.merge_tracker(spark.createDataFrame([], TRACKER), twice.repartition(2), "2024-01-01").collect()
    assert row["impact"] == "late"
    first = spark.createDataFrame([row], TRACKER)
    timed = spark.createDataFrame([(row["id"], "ann", None, 1), (row["id"], "bob", None, 2), (row["id"], None, "done", 1)], "id long, owner string, status string, acted_at int")
    (changed,) = merge.apply_actions(first, timed, "2024-01-02")[0].collect()
    assert (changed["owner"], changed["status"]) == ("bob", "done")
    assert merge.apply_actions(first, timed.drop("acted_at"), "2024-01-02")[0].count() == 1
    old = scores_v(spark, sf_dir).limit(1)
    tied = [old.withColumn("category", F.lit(c)) for c in ("c8", "c9", "c0")]
    got = merge.upsert_scores(old, tied[0].union(tied[1]).union(tied[2]).repartition(3)).collect()
    assert len(got) == 1 and got[0]["category"] == "c9"


def test_the_model_is_called_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def infer(prompts):
        with open(calls, "a") as f:
            f.write("x" * len(prompts))
        return inference.rule_based_infer(prompts)

    rows = [(k, "s", f"title {k}", "u", "", None, None, datetime(2024, 1, 1)) for k in range(5)]
    arts = spark.createDataFrame(rows, "article_id long, source string, title string, url string, summary string, raw_excerpt string, published_at timestamp, collected_at timestamp")
    good, bad = inference.score(arts, spark.createDataFrame([], "article_id long, provider string, model string"), infer, PROFILE, "p", "m", AS_OF, 1)
    assert good.count() == 5 and good.count() == 5 and bad.count() == 0 and calls.read_text() == "xxxxx"


def counted(folder, dies_at=None):
    """A model that notes each call in a folder, and once kills its worker at a call."""
    def infer(prompts):
        import os
        import uuid

        if dies_at is not None and len(os.listdir(folder)) >= dies_at and not os.path.exists(f"{folder}-died"):
            open(f"{folder}-died", "w").close()
            os._exit(1)
        if any("fails" in p for p in prompts):
            raise ValueError
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        return [f"re {p}" for p in prompts]

    return infer


def asked(folder):
    return sorted(p for f in folder.iterdir() for p in f.read_text().split("\n"))


def test_reply_log_goes_on_after_a_lost_worker(spark, tmp_path):
    calls, log = tmp_path / "calls", inference.ReplyLog(f"file://{tmp_path}/log", "m")
    calls.mkdir()
    rows = spark.range(400).select("id", F.concat(F.lit("p"), F.col("id") % 200).alias("prompt"))
    with pytest.raises(Exception, match="worker"):
        inference.with_replies(rows, counted(calls, dies_at=8), calls_at_once=3, batch=10, log=log)
    before = len(asked(calls))
    assert 80 <= before < 200
    got = inference.with_replies(rows, counted(calls), calls_at_once=5, batch=7, log=log)
    assert got.where("reply = concat('re ', prompt)").count() == 400
    # a batch that others had in flight when the job ended may be asked again; nothing that was written is
    assert len(set(asked(calls))) == 200 and len(asked(calls)) <= 200 + 2 * 10
    again = len(asked(calls))
    assert inference.with_replies(rows, counted(calls), log=log).where("reply IS NULL").count() == 0
    assert len(asked(calls)) == again
    small = log.compact(spark, f"file://{tmp_path}/small")
    assert sorted(small.read(spark).collect()) == sorted(log.read(spark).collect())
    assert inference.ReplyLog(log.path, "other").read(spark).count() == 0


def test_reply_log_asks_failed_calls_again(spark, tmp_path):
    calls, log = tmp_path / "calls", inference.ReplyLog(f"file://{tmp_path}/log", "m")
    calls.mkdir()
    rows = spark.createDataFrame([(1, "a"), (2, "b fails"), (3, None), (4, ""), (5, "a")], "id int, prompt string").coalesce(1)
    show = lambda df: {r["id"]: r["reply"] for r in df.collect()}
    assert show(inference.with_replies(rows, counted(calls), log=log)) == {1: "re a", 2: None, 3: None, 4: "re ", 5: "re a"}
    assert show(inference.with_replies(rows, counted(calls), log=log))[2] is None
    assert show(inference.with_replies(rows, lambda ps: [f"now {p}" for p in ps], log=log)) == {1: "re a", 2: "now b fails", 3: None, 4: "re ", 5: "re a"}
    assert asked(calls) == ["", "a"]
    assert inference.with_replies(rows.limit(0), counted(calls), log=log).count() == 0


def test_bucketed_merge(spark, tmp_path):
    table = keyed.KeyedTable(f"keyed_{tmp_path.name}", ("k", "m"), parts=16, buckets=4)
    schema = "k long, note string, m string, at timestamp"
    day = lambda d: d and datetime(2024, 1, d)
    old = spark.createDataFrame([(k, f"old{k}", "ab"[k % 2], day(5) if k % 7 else None) for k in range(300)], schema)
    table.create(old, str(tmp_path / "t"))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    rows = [(1, "late", "b", day(6)), (1, "latest", "b", day(7)), (2, "early", "a", day(4)), (3, "tie", "b", day(5)), (3, "tie2", "b", day(5)), (7, "x", "b", None), (4, None, "a", None), (900, "new", "a", day(1))]
    changes = spark.createDataFrame(rows, schema)
    show = lambda df: sorted(map(repr, df.select("k", "m", "note", "at").collect()))
    want = show(merge.last_wins(old, changes, ["k", "m"], "at"))
    step = lambda cur, new: keyed.latest(cur, new, table.key, "at")
    # only the changes are shuffled
    plan = step(table.touched(changes), changes)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = text[: text.index("FileScan")]
    assert "Bucketed: true" in text and "PartitionFilters: [part" in text and "Exchange" not in scan.split("SortMergeJoin")[-1]
    table.merge(changes.unionByName(spark.createDataFrame([(None, "no key", "a", day(9))], schema)), step)
    assert show(table.read(spark)) == want
    after = files()
    parts = {r["part"] for r in changes.select(table.part().alias("part")).collect()}
    kept = {f for f in before if int(f.split("part=")[1].split("/")[0]) not in parts}
    assert kept and all(after[f] == before[f] for f in kept) and not (before.keys() - kept) & after.keys()
    table.merge(changes.limit(0), step)
    assert show(table.read(spark)) == want
    probe = spark.createDataFrame([(1, "b"), (1, "a"), (901, "a")], "k long, m string")
    assert sorted(map(tuple, table.new_rows(probe).collect())) == [(1, "a"), (901, "a")]


def test_keyed_stream_adds_each_key_once(spark, tmp_path):
    table = keyed.KeyedTable(f"stream_{tmp_path.name}", ("content_hash",), parts=4, buckets=2)
    schema = "content_hash string, url string, collected_at timestamp"
    table.create(spark.createDataFrame([(1, "h0", "known", datetime(2024, 1, 1))], f"article_id long, {schema}"), str(tmp_path / "t"))
    for k, rows in enumerate([[("h0", "u"), ("h1", "a"), ("h1", "b")], [("h1", "c"), ("h2", "d")], []]):
        spark.createDataFrame([(*r, datetime(2024, 1, 2)) for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / "landed" / f"b{k}"))
    items = ingest.read_items(spark, str(tmp_path / "landed" / "*"), schema, maxFilesPerTrigger="1")
    for state in ("s", "s", "again"):
        ingest.ingest_keyed(items, table, str(tmp_path / state)).awaitTermination()
    assert sorted((r["content_hash"], r["url"]) for r in table.read(spark).collect() if r["content_hash"] != "h1") == [("h0", "known"), ("h2", "d")]
    assert table.read(spark).where("content_hash = 'h1'").count() == 1
