"""The engine's model over the test tables: the same expressions for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import content_hash
from newsloom.profiles import EntityRule, Profile, Section, Source, TitleRule
from newsloom.tables import read_table

AS_OF = "2024-01-31 00:00:00"
NOW = "2024-02-10 00:00:00"
MODELS = [("p0", "m0", 0), ("p1", "m1", 1), ("p2", "m2", 2)]

_TIERS = {**{f"src{k}": 4 for k in range(4)}, **{f"src{k}": 3 for k in range(4, 10)}, **{f"src{k}": 1 for k in range(16, 20)}}

PROFILE = Profile(
    id="demo",
    sources=tuple(Source(s, tier=t) for s, t in _TIERS.items()),
    tiers={"direct": ("license", "apache", "@"), "strong": ("rate", "oil", "tic"), "weak": ("the", "de")},
    noisy=frozenset(f"src{k}" for k in range(16, 20)),
    high_priority_tiers=("direct", "strong"),
    title_rules=(TitleRule("src1", r"\b(ou|y)\b", "license_like"), TitleRule("src", "^s", "s_title")),
    entity_rules=(EntityRule("src2", (("tion", ("tion", "ción")), ("ver", ("ver",))), ("oil", "rate"), 1, 2, 2), EntityRule("src5", (("ment", ("ment",)),), ("rate",), 3, 2, 4)),
    boilerplate=("the", "and"),
    cross_language_pairs=(("src0", "src1"), ("src2", "src3")),
    sections=(
        Section("read", "Market Read", "narrative"),
        Section("top_stories", "Top Stories", "stories", 3),
        Section("grouped", "Grouped", "grouped_stories", 2, ("c1", "c2")),
        Section("watchlist", "Watchlist", "watchlist"),
        Section("citations", "Source Citations", "citations", 4),
    ),
    category_sections={"c3": "grouped"},
    source_labels={"src0": "Source Zero", "src1": "Source One"},
    signal_labels={"s0": "Up", "s1": "Down"},
    labels={"report_title": "Demo Memo", "sources_line": "all"},
    default_watchlist=("Next release",),
)

#: Profiles that share sources and words with PROFILE, in other tiers and with other rules.
PROFILES = [
    PROFILE,
    Profile(
        id="markets", sources=tuple(Source(f"src{k}", tier=k % 3 + 1) for k in range(8)), noisy=frozenset({"src4", "src5", "src6", "src7", "src11"}),
        tiers={"direct": ("price", "bank"), "strong": ("rate", "The", "ment"), "weak": ("oil", "de", "en")}, high_priority_tiers=("direct", "weak"), default_tier=4,
        title_rules=(TitleRule("src0", r"\b(la|the)\b", "article_word"), TitleRule("src", "e$", "ends_in_e")),
        entity_rules=(EntityRule("src1", (("Rate", ("rate", "taux")), ("Ion", ("ion",))), ("price", "Bank"), 2, 1, 3), EntityRule("src1", (("Ment", ("ment",)),), (), 1, 1, 2)),
    ),
    Profile(id="energy", sources=tuple(Source(f"src{k}") for k in (2, 6, 13, 16)), tiers={"strong": ("oil", "grid", "ver"), "extra": ("Oil", "tion")}, high_priority_tiers=("extra", "missing")),
]


def articles_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(read_table(spark, sf_dir, "documents"))


def articles_of(d: DataFrame) -> DataFrame:
    """Documents as articles: the start of the first line is the title, the whole text the summary."""
    published = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.pmod(F.col("doc_id") * 37, F.lit(43200)).cast("int"))
    out = d.select(
        F.col("doc_id").alias("article_id"), "source",
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 13 != 0, published).alias("published_at"),
        F.col("text").alias("summary"), F.substring("text", 1, 300).alias("raw_excerpt"),
        (F.lit("2024-01-31").cast("timestamp") + F.make_dt_interval(secs=(F.col("doc_id") % 86400).cast("decimal(18,6)"))).alias("collected_at"),
    )
    return out.withColumn("content_hash", content_hash())


def models_v(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "provider string, model string, k int")


def each_model() -> Column:
    """One row for each model, as a column that explodes."""
    return F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model"), F.lit(k).alias("k")) for p, m, k in MODELS))).alias("m")


def scores_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", "source")
    labels = read_table(spark, sf_dir, "labels")
    x = d.select("*", each_model()).select("doc_id", "n_chars", "text", "source", "m.*").where((F.col("doc_id") + F.col("k")) % 3 != 0).join(labels, "doc_id", "left")
    return x.select(
        F.col("doc_id").alias("article_id"), "provider", "model", ((F.col("doc_id") * 31 + 17 * F.col("k") + F.col("n_chars")) % 101).cast("int").alias("relevance_score"),
        F.concat(F.lit("c"), (F.col("doc_id") % 9).cast("string")).alias("category"), F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("signal"),
        F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low").otherwise("medium").alias("confidence"),
        F.substring("text", 1, 80).alias("summary"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("why "), F.col("doc_id").cast("string"))).alias("why_it_matters"),
        F.col("source").alias("source_citation"), F.lit("").alias("model_raw"),
        (F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(secs=(F.col("doc_id") % 1000 + F.col("k")).cast("decimal(18,6)"))).alias("scored_at"),
    )


def analyses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of the more relevant articles by model p0/m0."""
    s = scores_v(spark, sf_dir).where("provider = 'p0' AND relevance_score >= 50")
    return s.select(
        "article_id", F.lit("demo").alias("profile_id"), F.col("provider").alias("scoring_provider"), F.col("model").alias("scoring_model"), F.lit("a0").alias("analysis_provider"), F.lit("b0").alias("analysis_model"),
        F.when(F.col("article_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), (F.col("article_id") % 7).cast("string"))).alias("category"), F.concat(F.lit("e"), (F.col("article_id") % 11).cast("string")).alias("entity"),
        F.when(F.col("article_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("impact "), F.col("article_id").cast("string"))).alias("impact"), F.lit("Monitor only").alias("suggested_action"), F.lit("").alias("model_raw"),
        (F.lit("2024-02-02").cast("timestamp") + F.make_dt_interval(secs=(F.col("article_id") % 500).cast("decimal(18,6)"))).alias("analyzed_at"),
    )


#: The same views as common table expressions.
SQL_VIEWS = """
articles_v AS (
    SELECT *, sha256(concat_ws('|', source, title, url)) AS content_hash FROM (
    SELECT doc_id AS article_id, source, substring(split_part(text, chr(10), 1), 1, 120) AS title, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
           CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 43200) END AS published_at,
           text AS summary, substring(text, 1, 300) AS raw_excerpt, TIMESTAMP '2024-01-31' + to_seconds(doc_id % 86400) AS collected_at FROM documents)),
models_v(provider, model, k) AS (VALUES ('p0', 'm0', 0), ('p1', 'm1', 1), ('p2', 'm2', 2)),
scores_v AS (
    SELECT d.doc_id AS article_id, provider, model, CAST((d.doc_id * 31 + 17 * k + n_chars) % 101 AS INTEGER) AS relevance_score, 'c' || (d.doc_id % 9) AS category, 's' || (d.doc_id % 4) AS signal,
           CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' ELSE 'medium' END AS confidence, substring(text, 1, 80) AS summary,
           CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'why ' || d.doc_id END AS why_it_matters, source AS source_citation, '' AS model_raw,
           TIMESTAMP '2024-02-01' + to_seconds(d.doc_id % 1000 + k) AS scored_at
    FROM documents d CROSS JOIN models_v LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE (d.doc_id + k) % 3 <> 0),
scored_v AS (SELECT s.*, a.source, a.title, a.url, a.published_at, a.collected_at FROM scores_v s JOIN articles_v a USING (article_id)),
analyses_v AS (
    SELECT article_id, 'demo' AS profile_id, provider AS scoring_provider, model AS scoring_model, 'a0' AS analysis_provider, 'b0' AS analysis_model,
           CASE WHEN article_id % 4 = 0 THEN '' ELSE 'c' || (article_id % 7) END AS category, 'e' || (article_id % 11) AS entity,
           CASE WHEN article_id % 10 = 0 THEN '' ELSE 'impact ' || article_id END AS impact, 'Monitor only' AS suggested_action, '' AS model_raw,
           TIMESTAMP '2024-02-02' + to_seconds(article_id % 500) AS analyzed_at
    FROM scores_v WHERE provider = 'p0' AND relevance_score >= 50)"""
