"""Registered queries of the engine's own operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.functions.replies import parse_analysis, parse_score
from newsloom.operators import gate, greedy, inference, many_profiles, merge, quality, rank, ratio_join, report, scored, similarity
from newsloom.plans.views import AS_OF, MODELS, NOW, PROFILE, PROFILES, SQL_VIEWS, analyses_v, articles_v, each_model, models_v, scores_v
from newsloom.profiles import keywords_table, sources_table
from newsloom.sources import pages as page_source
from newsloom.streaming.ingest import source_counts
from newsloom.tables import ensure_checkpoints, fresh_dir, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; SQL may use the views of SQL_VIEWS."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {SQL_VIEWS} {sql}"
        return f

    return add


def shown(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def listed(array: str | Column) -> Column:
    return F.array_join(array, "|")


def scored_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored.scored_articles(scores_v(spark, sf_dir), articles_v(spark, sf_dir))


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_BLOB = "array_to_string(list_filter([title, summary, raw_excerpt], lambda x: x IS NOT NULL AND x <> ''), ' ')"
_HITS = lambda words: f"list_filter([{', '.join(repr(w) for w in words)}], lambda k: contains(lower(blob), lower(k)))"
_GENERAL = PROFILE.general()

# ---- text and dates -----------------------------------------------------------------------------------------------


@query("SELECT article_id, content_hash FROM articles_v")
def content_hash(spark, sf_dir):
    return articles_v(spark, sf_dir).select("article_id", "content_hash")


#: Letters, marks and digits beyond ASCII count as parts of words: they become a capital, which no lower-cased text has,
#: as the boundaries of this SQL's patterns only know ASCII; all else beyond ASCII becomes a dash first.
_WORDLY = r"regexp_replace(regexp_replace(lower({}), '[^\x00-\x7F\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]', '-', 'g'), '[^\x00-\x7F]', 'Q', 'g')"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(" + _WORDLY + r", '\b(the|and)\b', ' ', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT article_id, {_NORM.format('title')} AS norm_title, {_NORM.format(_BLOB)} AS norm_blob FROM articles_v")
def normalize_text(spark, sf_dir):
    a = articles_v(spark, sf_dir)
    return a.select("article_id", text.normalize_text(F.col("title"), PROFILE.boilerplate).alias("norm_title"), text.normalize_text(text.text_blob(), PROFILE.boilerplate).alias("norm_blob"))


@query(r"""SELECT doc_id AS article_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9&.-]{2,}'), lambda x: lower(x)), lambda x: NOT list_contains(['bess','energy','fip','grid','mwh','mw','news','ppa','project'], x)))), '|') AS identifiers,
array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)(\d+(?:\.\d+)?)\s*(?:mw|mwh|gw|gwh)', 1))), '|') AS capacities FROM documents""")
def identifiers_capacities(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("article_id"), listed(F.array_sort(text.latin_identifiers(F.col("text")))).alias("identifiers"), listed(F.array_sort(text.capacity_values(F.col("text")))).alias("capacities"))


@query(r"""SELECT article_id, array_to_string(list_filter([title, summary, raw_excerpt], lambda x: x IS NOT NULL AND x <> ''), ' ') AS blob, CASE WHEN contains(title, '<') THEN trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE trim(title) END AS plain FROM articles_v""")
def text_blob(spark, sf_dir):
    return articles_v(spark, sf_dir).select("article_id", text.text_blob().alias("blob"), text.strip_html(F.col("title")).alias("plain"))


_D = "substr(CAST(ts AS VARCHAR), 1, 10)"
_ISO = "CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR)"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE {_ISO} || ' 00:00:00' END AS parsed FROM events")
def parse_dates(spark, sf_dir):
    """Dates of events written in four ways and as an impossible date, parsed back."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts")
    day = lambda f: F.date_format("ts", f)
    kind = F.col("event_id") % 5
    written = F.when(kind == 0, F.concat(F.lit("Report of "), day("MMMM d, yyyy"), F.lit(" and more"))).when(kind == 1, F.concat(F.lit("発表 "), day("yyyy年M月d日"))).when(kind == 2, F.concat(F.lit("at "), day("yyyy/M/d"))).when(kind == 3, F.concat(F.lit("x"), day("yyMMdd"), F.lit("j.pdf"))).otherwise(F.lit("2026-13-40"))
    return e.select("event_id", shown(dates.parse_date_text(written)).alias("parsed"))


@query(f"SELECT article_id, {_TS.format('published_at')} AS published, CASE WHEN published_at IS NOT NULL THEN strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d') ELSE '~' || strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d') || ' (first seen)' END AS shown_date FROM articles_v")
def display_date(spark, sf_dir):
    return articles_v(spark, sf_dir).select("article_id", shown("published_at").alias("published"), text.display_date(F.col("published_at"), F.col("collected_at")).alias("shown_date"))


@query("SELECT article_id, provider, CASE WHEN relevance_score >= 80 THEN 'High' WHEN relevance_score >= 60 THEN 'Medium' ELSE 'Low' END AS label FROM scores_v")
def relevance_label(spark, sf_dir):
    return scores_v(spark, sf_dir).select("article_id", "provider", text.relevance_label(F.col("relevance_score").cast("string")).alias("label"))


@query("SELECT event_id, ts IS NOT NULL AND isodow(ts + INTERVAL 8 HOUR) < 6 AS business FROM events")
def business_days(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(dates.business_day(F.col("ts"), "Asia/Hong_Kong"), F.lit(False)).alias("business"))


# ---- gates and priorities -----------------------------------------------------------------------------------------

_G = f"""
, g0 AS (SELECT *, {_BLOB} AS blob, source IN ('src16','src17','src18','src19') AS is_noisy,
     CASE WHEN source IN ('src0','src1','src2','src3') THEN 4 WHEN source IN ('src4','src5','src6','src7','src8','src9') THEN 3 WHEN source IN ('src16','src17','src18','src19') THEN 1 ELSE 2 END AS tier FROM articles_v),
g1 AS (SELECT *, {_HITS(PROFILE.tiers['direct'])} AS direct, {_HITS(PROFILE.tiers['strong'])} AS strong, {_HITS(PROFILE.tiers['weak'])} AS weak, {_HITS(_GENERAL)} AS general FROM g0),
g2 AS (SELECT *, CASE WHEN len(direct) > 0 THEN direct WHEN len(strong) >= 2 THEN strong WHEN len(general) > 0 AND len(weak) = 0 THEN general WHEN len(general) > len(weak) THEN list_filter(general, lambda x: NOT list_contains(weak, x)) ELSE [] END AS noisy_hits,
     CASE WHEN len(general) > 0 THEN general WHEN starts_with(source, 'src1') AND regexp_matches(title, '(?i)\\b(ou|y)\\b') THEN ['license_like'] WHEN regexp_matches(title, '(?i)^s') THEN ['s_title'] ELSE [] END AS plain_hits FROM g1),
g3 AS (SELECT *, CASE WHEN is_noisy THEN noisy_hits ELSE plain_hits END AS hits FROM g2),
g4 AS (SELECT *, len(hits) > 0 AS hit, lower(array_to_string(hits, ' ')) AS joined,
     CASE WHEN source = 'src2' THEN CASE WHEN contains(lower(blob), 'tion') OR contains(lower(blob), 'ción') OR contains(lower(blob), 'ver') THEN least(1 + CASE WHEN contains(lower(blob), 'oil') OR contains(lower(blob), 'rate') THEN 2 ELSE 0 END, 2) ELSE 0 END
          WHEN source = 'src5' THEN CASE WHEN contains(lower(blob), 'ment') THEN least(3 + CASE WHEN contains(lower(blob), 'rate') THEN 2 ELSE 0 END, 4) ELSE 0 END ELSE 0 END AS boost FROM g3),
g5 AS (SELECT *, len(hits) + tier + 3 * CAST(contains(joined, 'license') OR contains(joined, 'apache') OR contains(joined, '@') AS INT) + 3 * CAST(contains(joined, 'rate') OR contains(joined, 'oil') OR contains(joined, 'tic') AS INT) + 2 * CAST(hit AS INT) AS base FROM g4),
g AS (SELECT *, CAST(CASE WHEN is_noisy THEN greatest(0, base - 1) ELSE base END + boost AS INTEGER) AS priority FROM g5)
"""


@query(_G + "SELECT article_id, array_to_string(direct, '|') AS direct, array_to_string(strong, '|') AS strong, array_to_string(weak, '|') AS weak, array_to_string(general, '|') AS general FROM g")
def keyword_hits(spark, sf_dir):
    found = gate.tier_hits(articles_v(spark, sf_dir), PROFILE)
    return found.select("article_id", *(listed(f"_{tier}").alias(tier) for tier in ("direct", "strong", "weak", "general")))


@query(_G + "SELECT article_id, t.tier, array_to_string(t.hits, '|') AS hits FROM g, LATERAL (VALUES ('direct', direct), ('strong', strong), ('weak', weak)) t(tier, hits) WHERE len(t.hits) > 0")
def keyword_hits_wide(spark, sf_dir):
    found = gate.keyword_hits_wide(articles_v(spark, sf_dir), keywords_table(spark, [PROFILE]))
    return found.select("article_id", "tier", listed("hits").alias("hits"))


@query(_G + "SELECT article_id, array_to_string(noisy_hits, '|') AS hits FROM g WHERE is_noisy")
def noisy_gate(spark, sf_dir):
    a = articles_v(spark, sf_dir).where(gate.is_noisy(F.col("source"), PROFILE))
    return gate.tier_hits(a, PROFILE).select("article_id", listed(gate.noisy_hits(*map(F.col, gate.TIER_COLUMNS))).alias("hits"))


@query(_G + "SELECT article_id, hit AS prefilter_hit, array_to_string(hits, '|') AS hits, tier, is_noisy FROM g")
def prefilter(spark, sf_dir):
    return gate.annotate(articles_v(spark, sf_dir), PROFILE).select("article_id", "prefilter_hit", listed("keyword_hits").alias("hits"), "tier", "is_noisy")


@query(_G + "SELECT article_id, boost FROM g WHERE boost > 0")
def entity_boost(spark, sf_dir):
    return gate.entity_boost(articles_v(spark, sf_dir), PROFILE).where("boost > 0").select("article_id", "boost")


@query(_G + "SELECT article_id, priority FROM g WHERE hit OR NOT is_noisy")
def priority_rank(spark, sf_dir):
    return gate.prioritized(gate.gated(articles_v(spark, sf_dir), PROFILE), PROFILE).select("article_id", "priority")


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of literals in SQL."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


_RULES = ", ".join([
    _rows("listed", "profile_id, source, tier, is_noisy", [(p.id, s, {x.id: x.tier for x in p.sources}.get(s, p.default_tier), s in p.noisy) for p in PROFILES for s in many_profiles.listed_sources(p)]),
    _rows("words", "profile_id, tier, ord, word", [(p.id, t, k, w) for p in PROFILES for t, own in [*p.tiers.items(), ("general", p.general())] for k, w in enumerate(own)]),
    _rows("high", "profile_id, tier", [(p.id, t) for p in PROFILES for t in p.high_priority_tiers]),
    _rows("titles", "profile_id, ord, prefix, pattern, tag", [(p.id, k, r.source_prefix, r.pattern, r.tag) for p in PROFILES for k, r in enumerate(p.title_rules)]),
    _rows("entities", "profile_id, source, ord, entity_bonus, context_bonus, max_bonus, k, name, alias", [(p.id, r.source_id, n, r.entity_bonus, r.context_bonus, r.max_bonus, k, name, a) for p in PROFILES for n, r in enumerate(p.entity_rules) for k, (name, aliases) in enumerate(r.entities) for a in aliases]),
    _rows("contexts", "profile_id, ord, k, word", [(p.id, n, k, w) for p in PROFILES for n, r in enumerate(p.entity_rules) for k, w in enumerate(r.context_keywords)]),
])
_ALL_GATES = f""", {_RULES},
a AS (SELECT article_id, source, title, lower({_BLOB}) AS low FROM articles_v), l AS (SELECT a.*, profile_id, tier, is_noisy FROM a JOIN listed USING (source)),
h AS (SELECT article_id, l.profile_id, list(w.word ORDER BY w.ord) FILTER (w.tier = 'direct') AS direct, list(w.word ORDER BY w.ord) FILTER (w.tier = 'strong') AS strong, list(w.word ORDER BY w.ord) FILTER (w.tier = 'weak') AS weak, list(w.word ORDER BY w.ord) FILTER (w.tier = 'general') AS general
      FROM l JOIN words w ON w.profile_id = l.profile_id AND contains(l.low, lower(w.word)) GROUP BY ALL),
t AS (SELECT article_id, l.profile_id, arg_min(tag, ord) AS tag FROM l JOIN titles r ON r.profile_id = l.profile_id AND starts_with(l.source, r.prefix) AND regexp_matches(l.title, '(?i)' || r.pattern) GROUP BY ALL),
e AS (SELECT article_id, x.profile_id, x.ord, arg_min(name, k) AS name, any_value(entity_bonus) AS eb, any_value(context_bonus) AS cb, any_value(max_bonus) AS mb, any_value(low) AS low FROM l JOIN entities x ON x.profile_id = l.profile_id AND x.source = l.source AND contains(l.low, lower(x.alias)) GROUP BY ALL),
c AS (SELECT article_id, e.profile_id, e.ord, arg_min(word, k) AS word FROM e JOIN contexts w ON w.profile_id = e.profile_id AND w.ord = e.ord AND contains(e.low, lower(w.word)) GROUP BY ALL),
b AS (SELECT article_id, profile_id, sum(least(eb + CASE WHEN word IS NULL THEN 0 ELSE cb END, mb)) AS boost, string_agg('entity:' || name || coalesce('|entity_context:' || word, ''), '|' ORDER BY ord) AS signals FROM e LEFT JOIN c USING (article_id, profile_id, ord) GROUP BY ALL),
f AS (SELECT l.article_id, l.profile_id, tier, is_noisy, coalesce(direct, []) AS direct, coalesce(strong, []) AS strong, coalesce(weak, []) AS weak, coalesce(general, []) AS general, tag FROM l LEFT JOIN h USING (article_id, profile_id) LEFT JOIN t USING (article_id, profile_id)),
g AS (SELECT *, array_to_string(CASE WHEN is_noisy THEN CASE WHEN len(direct) > 0 THEN direct WHEN len(strong) >= 2 THEN strong WHEN len(general) > 0 AND len(weak) = 0 THEN general WHEN len(general) > len(weak) THEN list_filter(general, lambda x: NOT list_contains(weak, x)) ELSE [] END
      WHEN len(general) > 0 THEN general WHEN tag IS NOT NULL THEN [tag] ELSE [] END, '|') AS hits FROM f),
n AS (SELECT article_id, g.profile_id, count(DISTINCT w.tier) AS high FROM g JOIN high USING (profile_id) JOIN words w ON w.profile_id = g.profile_id AND w.tier = high.tier AND contains(lower(replace(hits, '|', ' ')), lower(w.word)) GROUP BY ALL),
p AS (SELECT *, CASE WHEN hits = '' THEN 0 ELSE len(string_split(hits, '|')) + 2 END + tier + 3 * coalesce(high, 0) AS base FROM g LEFT JOIN n USING (article_id, profile_id) LEFT JOIN b USING (article_id, profile_id) WHERE hits <> '' OR NOT is_noisy)
SELECT article_id, profile_id, hits, tier, is_noisy, coalesce(signals, '') AS signals, CAST(CASE WHEN is_noisy THEN greatest(0, base - 1) ELSE base END + coalesce(boost, 0) AS INTEGER) AS priority FROM p"""


@query(_ALL_GATES)
def profile_gates(spark, sf_dir):
    """Hits, tiers, boosts and priorities of three profiles, from one scan of the articles."""
    out = many_profiles.prioritized_profiles(articles_v(spark, sf_dir).select("article_id", "source", "title", "summary", "raw_excerpt"), PROFILES)
    signals = F.array_join(F.filter("boost_signals", lambda s: ~s.startswith("source_boost:")), "|")
    return out.select("article_id", "profile_id", listed("keyword_hits").alias("hits"), "tier", "is_noisy", signals.alias("signals"), "priority")


_RANKED = _G + f", ranked AS (SELECT *, row_number() OVER (ORDER BY priority DESC, coalesce(published_at, TIMESTAMP '{AS_OF}') DESC, published_at DESC NULLS LAST, collected_at DESC, article_id) AS rank FROM g WHERE hit OR NOT is_noisy)"


@query(_RANKED + " SELECT article_id, priority, rank FROM ranked")
def global_rank(spark, sf_dir):
    ensure_checkpoints(spark)
    return rank.ranked_candidates(articles_v(spark, sf_dir), PROFILE, AS_OF).select("article_id", "priority", F.col("rank").cast("long").alias("rank"))


@query(_RANKED + """, q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k FROM ranked WHERE is_noisy) WHERE k <= 3),
q2 AS (SELECT article_id, source, rank FROM (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM q1) WHERE n <= 5 UNION ALL SELECT article_id, source, rank FROM ranked WHERE NOT is_noisy)
SELECT article_id, source FROM q2 ORDER BY rank LIMIT 25""")
def source_quotas(spark, sf_dir):
    """A top-k report: the quotas are the feature."""
    ready = gate.prioritized(gate.gated(articles_v(spark, sf_dir), PROFILE), PROFILE)
    place = F.struct(-F.col("priority"), -F.unix_micros(F.coalesce("published_at", F.lit(AS_OF).cast("timestamp"))), F.col("published_at").isNull(), -F.unix_micros("collected_at"), F.col("article_id"))
    return rank.source_quotas(ready.withColumn("place", place), F.col("place")).select("article_id", "source")


@query()
def rank_for_scoring(spark, sf_dir):
    ensure_checkpoints(spark)
    return rank.rank_for_scoring(articles_v(spark, sf_dir), PROFILE, AS_OF).select("article_id", "source", "priority", "slot")


@query(f"SELECT article_id FROM articles_v WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR OR (published_at IS NULL AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9', 'src16', 'src17', 'src18', 'src19'))")
def recency_filter(spark, sf_dir):
    dims = sources_table(spark, [PROFILE]).select("source", "allow_undated")
    return gate.within_recency(articles_v(spark, sf_dir).join(F.broadcast(dims), "source", "left"), 72, AS_OF, allow_undated=F.col("allow_undated")).select("article_id")


@query("SELECT text_key AS content, min(article_id) AS article_id FROM (SELECT md5(title) AS text_key, article_id FROM articles_v) GROUP BY text_key")
def first_seen(spark, sf_dir):
    a = articles_v(spark, sf_dir).withColumn("content", F.md5("title"))
    return rank.first_seen(a, "content", ["article_id"]).select("content", "article_id")


# ---- pages --------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages""")
def page_links(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), F.col("url").alias("page_url"), "html", F.lit("").alias("title_class"), F.lit("").alias("date_class"))
    return page_source.page_links(p).select(F.col("source").cast("long").alias("page_id"), "href", "title")


_ANCHORS = r"anchors AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS title FROM pages)"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    every = lambda k: F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    return p.select("page_id", F.col("url").alias("page_url"), F.explode(F.arrays_zip(every(1).alias("href"), every(2).alias("title"))).alias("a")).select("page_id", "page_url", "a.*")


@query(f", {_ANCHORS} SELECT page_id, href, regexp_extract(page_url, '^([a-zA-Z]+://[^/?#]*)', 1) || href AS resolved FROM anchors WHERE (contains(href, '/t') OR contains(href, '/o')) AND NOT contains(href, 'on')")
def link_filter(spark, sf_dir):
    a = _anchors(spark, sf_dir).withColumn("resolved", text.resolve_url(F.col("href"), F.col("page_url")))
    words = lambda *w: F.array(*map(F.lit, w))
    keep = gate.link_allowed(F.col("href"), F.col("href"), words("on", ".pdf"), words("/t", "/o"), F.lit(True)) & gate.domain_allowed(F.col("resolved"), F.col("page_url"), words())
    return a.where(keep).select("page_id", "href", "resolved")


@query(f", {_ANCHORS} SELECT page_id, href, title FROM anchors WHERE length(trim(title)) >= 8 AND NOT regexp_matches(lower(trim(title)), '^(view all|more|next|prev|previous|一覧|戻る)')")
def title_gate(spark, sf_dir):
    return _anchors(spark, sf_dir).where(gate.title_gate(F.col("title"))).select("page_id", "href", "title")


@query("SELECT c_custkey, unnest(['https://s' || c_nationkey || '.example.com/2024/list', 'https://s' || c_nationkey || '.example.com/more']) AS page_url FROM customer")
def source_urls(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    host = F.concat(F.lit("https://s"), F.col("c_nationkey").cast("string"), F.lit(".example.com/"))
    s = c.select("c_custkey", F.concat(host, F.lit("{year}/list")).alias("url"), F.array(F.concat(host, F.lit("more"))).alias("extra_urls"), F.lit(True).alias("year_templated"))
    return gate.expand_source_urls(s, AS_OF).select("c_custkey", "page_url")


@query("SELECT page_id, count(*) AS n FROM pages WHERE NOT contains(url, 'ads-track') AND (contains(url, '/en/') OR contains(url, '/fr/')) GROUP BY page_id")
def feed_entries(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    ok = gate.feed_entry_allowed(F.col("url"), F.lit("a title"), F.array(F.lit("ads-track")), F.array(F.lit("/en/"), F.lit("/fr/")))
    return p.where(ok).groupBy("page_id").agg(F.count("*").alias("n"))


# ---- joins over scores --------------------------------------------------------------------------------------------


@query("SELECT article_id FROM articles_v WHERE article_id NOT IN (SELECT article_id FROM scores_v WHERE provider = 'p1' AND model = 'm1') AND source IN ('src0', 'src1', 'src17')")
def unscored_for_model(spark, sf_dir):
    return scored.unscored(articles_v(spark, sf_dir), scores_v(spark, sf_dir), "p1", "m1", ["src0", "src1", "src17"]).select("article_id")


@query("SELECT article_id FROM articles_v WHERE article_id % 3 <> 0")
def known_hash_skip(spark, sf_dir):
    a = articles_v(spark, sf_dir)
    return scored.skip_known(a, a.where("article_id % 3 = 0")).select("article_id")


@query("SELECT article_id, provider, model FROM articles_v CROSS JOIN models_v WHERE (article_id + k) % 3 = 0")
def exclude_scored(spark, sf_dir):
    plan = articles_v(spark, sf_dir).select("article_id", each_model()).select("article_id", "m.*")
    return scored.exclude_scored(plan, scores_v(spark, sf_dir)).select("article_id", "provider", "model")


@query(f"SELECT article_id, provider, relevance_score, title, {_TS.format('collected_at')} AS collected FROM scored_v")
def scored_articles(spark, sf_dir):
    return scored_v(spark, sf_dir).select("article_id", "provider", "relevance_score", "title", shown("collected_at").alias("collected"))


@query(f"SELECT article_id, relevance_score FROM scored_v WHERE provider = 'p0' AND model = 'm0' AND source IN ('src0', 'src5') AND relevance_score >= 30 AND coalesce(published_at, collected_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR")
def lineage_filter(spark, sf_dir):
    return scored.lineage_filter(scored_v(spark, sf_dir), "p0", "m0", ["src0", "src5"], 30, 240, AS_OF).select("article_id", "relevance_score")


@query("SELECT article_id, title, relevance_score FROM scored_v WHERE provider = 'p0' AND model = 'm0' AND relevance_score >= 40 ORDER BY relevance_score DESC, coalesce(published_at, collected_at) DESC, article_id LIMIT 15")
def top_scored(spark, sf_dir):
    """A top-k report."""
    return rank.top_scored(scored.lineage_filter(scored_v(spark, sf_dir), "p0", "m0")).select("article_id", "title", "relevance_score")


_FALL = """, r AS (SELECT *, row_number() OVER (PARTITION BY provider, source ORDER BY relevance_score DESC, coalesce(published_at, collected_at) DESC, article_id) AS k, max(relevance_score) OVER (PARTITION BY provider, source) AS best FROM scored_v)
SELECT provider, source, article_id, relevance_score, k AS rank FROM r WHERE (best >= 99 AND relevance_score >= 99 AND k <= 15) OR (best < 99 AND k <= 10)"""


@query(_FALL)
def recent_scored_fallback(spark, sf_dir):
    """A report for each model and source; those without a score of 99 fall back to their best ten."""
    return rank.recent_scored_fallback(scored_v(spark, sf_dir), ["provider", "source"], 99).select("provider", "source", "article_id", "relevance_score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT provider, model, article_id, relevance_score, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 86400) AS BIGINT) AS age_days FROM scored_v")
def scored_listing(spark, sf_dir):
    return quality.scored_listing(scored_v(spark, sf_dir), AS_OF).select("provider", "model", "article_id", "relevance_score", "age_days")


@query("SELECT article_id, coalesce(category, 'other') AS category, entity, coalesce(impact, '') AS impact FROM analyses_v")
def lookup_analyses(spark, sf_dir):
    return scored.lookup_analyses(analyses_v(spark, sf_dir), articles_v(spark, sf_dir), "demo", "p0", "m0", "a0", "b0").select("article_id", "category", "entity", "impact")


@query("SELECT article_id, article_id IN (SELECT article_id FROM analyses_v) AS cached FROM scores_v WHERE provider = 'p0'")
def split_cached(spark, sf_dir):
    hit, miss = scored.split_cached(scores_v(spark, sf_dir).where("provider = 'p0'"), analyses_v(spark, sf_dir))
    return hit.select("article_id", F.lit(True).alias("cached")).unionByName(miss.select("article_id", F.lit(False).alias("cached")))


@query("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'newer' ELSE category END AS category FROM analyses_v")
def cached_and_new(spark, sf_dir):
    a = analyses_v(spark, sf_dir)
    return scored.cached_and_new(a, a.where("article_id % 3 = 0").withColumn("category", F.lit("newer"))).select("article_id", "category")


_MERGED = "merged AS (SELECT s.article_id, coalesce(nullif(a.category, ''), s.category) AS category, a.category AS analysis_category, entity, impact, s.source, s.relevance_score, s.title FROM scored_v s LEFT JOIN analyses_v a USING (article_id) WHERE s.provider = 'p0')"


@query(f", {_MERGED} SELECT article_id, category, entity, impact FROM merged")
def merge_analysis(spark, sf_dir):
    return scored.merge_analysis(scored_v(spark, sf_dir).where("provider = 'p0'"), analyses_v(spark, sf_dir)).select("article_id", "category", "entity", "impact")


@query(""", h AS (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY article_id) AS k FROM scored_v WHERE provider = 'p0')
SELECT x.article_id, coalesce(array_to_string((SELECT list(article_id ORDER BY k) FROM (SELECT y.article_id, y.k FROM h y WHERE y.source = x.source AND y.k <= 9 AND y.article_id <> x.article_id ORDER BY y.k LIMIT 8)), '|'), '') AS related FROM h x""")
def related_items(spark, sf_dir):
    out = scored.related_items(scored_v(spark, sf_dir).where("provider = 'p0'"), ["source"], "article_id")
    return out.select("article_id", listed(F.transform("related", lambda r: r["article_id"].cast("string"))).alias("related"))


def _sections(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    s = spark.createDataFrame([("one", 2, ["c1", "c2"]), ("two", 5, ["c2", "c5"])], "section_id string, max_items int, category_ids array<string>")
    return s, spark.createDataFrame([("c3", "one"), ("c1", "one")], "category string, section_id string")


_SECT = f", {_MERGED}, w(category, section_id, max_items) AS (VALUES ('c1','one',2), ('c2','one',2), ('c3','one',2), ('c2','two',5), ('c5','two',5)), sect AS (SELECT m.*, section_id, max_items FROM merged m JOIN w USING (category))"


@query(_SECT + " SELECT article_id, section_id FROM sect")
def attach_section(spark, sf_dir):
    items = scored.merge_analysis(scored_v(spark, sf_dir).where("provider = 'p0'"), analyses_v(spark, sf_dir))
    return scored.attach_section(items, *_sections(spark)).select("article_id", "section_id")


@query(_SECT + ", z AS (SELECT *, row_number() OVER (PARTITION BY source, section_id ORDER BY article_id) AS section_rank FROM sect) SELECT source, section_id, article_id, section_rank FROM z WHERE section_rank <= max_items")
def section_rank(spark, sf_dir):
    items = scored.merge_analysis(scored_v(spark, sf_dir).where("provider = 'p0'"), analyses_v(spark, sf_dir))
    out = rank.section_rank(scored.attach_section(items, *_sections(spark)), ["source"], "article_id")
    return out.select("source", "section_id", "article_id", F.col("section_rank").cast("long").alias("section_rank"))


@query("SELECT article_id, title, url, " + ", ".join(f"max(CASE WHEN provider = '{p}' THEN {c} END) AS {p}__{m}_{n}" for p, m, _ in MODELS for n, c in (("score", "relevance_score"), ("signal", "signal"), ("confidence", "confidence"), ("summary", "summary"))) + " FROM scored_v GROUP BY article_id, title, url")
def model_side_by_side(spark, sf_dir):
    return scored.pivot_models(scored_v(spark, sf_dir), [(p, m) for p, m, _ in MODELS])


# ---- similarity ---------------------------------------------------------------------------------------------------


@query(f"""
, t AS (SELECT article_id, source, published_at, list_distinct(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9&.-]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains(['bess','energy','fip','grid','mwh','mw','news','ppa','project'], x))) AS names FROM articles_v WHERE published_at IS NOT NULL)
SELECT DISTINCT least(l.article_id, r.article_id) AS a, greatest(l.article_id, r.article_id) AS b FROM t l JOIN t r ON ((l.source = 'src0' AND r.source = 'src1') OR (l.source = 'src2' AND r.source = 'src3')) AND abs(epoch_us(l.published_at) - epoch_us(r.published_at)) <= 345600000000
WHERE len(list_intersect(l.names, r.names)) >= 2""")
def cross_language_pairs(spark, sf_dir):
    a = articles_v(spark, sf_dir)
    return similarity.cross_language_pairs(a, PROFILE, "article_id", title_col="title")


@query(r""", t AS (SELECT doc_id AS article_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents),
c AS (SELECT norm, min(article_id) AS class_id FROM t GROUP BY norm),
w AS (SELECT class_id, string_split(norm, ' ') AS w FROM c WHERE norm <> ''),
s AS (SELECT DISTINCT class_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
o AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.class_id < y.class_id GROUP BY x.class_id, y.class_id),
p AS (SELECT a, b FROM o JOIN n na ON na.class_id = a JOIN n nb ON nb.class_id = b WHERE shared >= 0.8 * (na.n + nb.n - shared)),
l AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY class_id)
SELECT article_id, class_id, coalesce(links, 0) AS links FROM t JOIN c USING (norm) LEFT JOIN l USING (class_id)""")
def shingle_jaccard_pairs(spark, sf_dir):
    """Each document with its class of equal normalised texts and the number of other classes that are similar: 0.8 of
    the five-word shingles of the whole texts."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), text.normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    return similarity.shingle_links(d).select("article_id", "class_id", "links")


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f""", t AS (SELECT {_NORMAL.format('title')} AS norm, min(article_id) AS id FROM articles_v GROUP BY 1 HAVING norm <> ''),
n AS (SELECT id, length(norm) AS size, unnest(string_split(norm, '')) AS c FROM t),
l AS (SELECT id, size, c, count(*) AS k FROM n GROUP BY id, size, c)
SELECT x.id AS a, y.id AS b FROM l x JOIN l y ON x.c = y.c AND x.id < y.id GROUP BY x.id, y.id, x.size, y.size HAVING 2 * sum(least(x.k, y.k)) >= 0.82 * (x.size + y.size) - 1e-9""")
def title_letter_pairs(spark, sf_dir):
    """Pairs of distinct titles whose letter counts allow the ratio: the first bound of ``similar_pairs``."""
    ensure_checkpoints(spark)
    titles = articles_v(spark, sf_dir).select(F.col("article_id").alias("id"), text.normalize_text(F.coalesce("title", F.lit(""))).alias("text")).where("text <> ''")
    return ratio_join.count_pairs(ratio_join.measured(titles.groupBy("text").agg(F.min("id").alias("id")), 0.82).checkpoint(), 0.82, grams=False)


@query()
def similar_article_pairs(spark, sf_dir):
    """All pairs that connect similar articles; a test compares all pairs of whole texts."""
    return similarity.similar_pairs(articles_v(spark, sf_dir).withColumn("ord", F.col("article_id")), PROFILE)


_WALK = f""", t AS (SELECT doc_id AS article_id, {_NORMAL.format('text')} AS norm FROM documents),
c AS (SELECT norm, min(article_id) AS class_id FROM t GROUP BY norm),
w AS (SELECT class_id, string_split(norm, ' ') AS w FROM c WHERE norm <> ''),
s AS (SELECT DISTINCT class_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
o AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.class_id < y.class_id GROUP BY x.class_id, y.class_id),
p AS (SELECT a, b FROM o JOIN n na ON na.class_id = a JOIN n nb ON nb.class_id = b WHERE shared >= 0.8 * (na.n + nb.n - shared)),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT class_id, class_id FROM c),
m AS (SELECT v.article_id AS ord, class_id, v.source, CASE WHEN v.source IN ('src0', 'src1', 'src2', 'src3') THEN 4 WHEN v.source IN ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 3 WHEN v.source IN ('src16', 'src17', 'src18', 'src19') THEN 1 ELSE 2 END AS tier,
      v.article_id % 5 AS priority, published_at AS dated FROM articles_v v JOIN t USING (article_id) JOIN c USING (norm)),
e AS (SELECT x.ord AS r, y.ord AS y FROM q JOIN m x ON x.class_id = q.a JOIN m y ON y.class_id = q.b AND y.ord < x.ord),
g AS (SELECT ord, tier, priority, dated, (SELECT list(y) FROM e WHERE r = ord) AS nb FROM m WHERE ord IN (SELECT r FROM e UNION SELECT y FROM e)),
k AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM g),
walk(k, reps) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(slot BIGINT, rep BIGINT, tier INTEGER, priority BIGINT, dated TIMESTAMP)[])
    UNION ALL
    SELECT k, CASE WHEN hit IS NULL THEN list_append(reps, own) WHEN tier > hit.tier OR (tier = hit.tier AND (priority > hit.priority OR (priority = hit.priority AND coalesce(dated > hit.dated, false)))) THEN list_transform(reps, lambda x: CASE WHEN x.slot = hit.slot THEN struct_update(own, slot := hit.slot) ELSE x END) ELSE reps END
    FROM (SELECT k.*, w.reps, list_filter(w.reps, lambda x: list_contains(coalesce(k.nb, []), x.rep))[1] AS hit, CAST({{'slot': ord, 'rep': ord, 'tier': tier, 'priority': priority, 'dated': dated}} AS STRUCT(slot BIGINT, rep BIGINT, tier INTEGER, priority BIGINT, dated TIMESTAMP)) AS own FROM walk w JOIN k ON k.k = w.k + 1)),
chosen AS (SELECT x.slot AS slot, x.rep AS article_id FROM (SELECT unnest(reps) AS x FROM walk WHERE k = (SELECT max(k) FROM walk)) UNION ALL SELECT ord, ord FROM m WHERE ord NOT IN (SELECT ord FROM g))
"""


def _jaccard_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, article_id): the walk in the order of ids, where texts with 0.8 of their five-word shingles are similar."""
    ensure_checkpoints(spark)
    tiers = F.create_map(*(F.lit(x) for s in PROFILE.sources for x in (s.id, s.tier)))
    rows = articles_v(spark, sf_dir).select(F.col("article_id").alias("ord"), "source", text.normalize_text(F.coalesce("summary", F.lit(""))).alias("text"), F.coalesce(tiers[F.col("source")], F.lit(PROFILE.default_tier)).alias("tier"), (F.col("article_id") % 5).cast("int").alias("priority"), F.unix_micros("published_at").alias("at"))
    keyed = rows.select("ord", F.sha2("text", 256).alias("key")).checkpoint()
    classes = keyed.groupBy("key").agg(F.min("ord").alias("cls")).checkpoint()
    texts = fresh_dir(spark, "texts")
    rows.join(classes.select(F.col("cls").alias("ord")), "ord", "left_semi").select(F.col("ord").alias("cls"), "text").write.parquet(texts)
    pairs = similarity.shingle_jaccard_pairs(spark.read.parquet(texts), 5, 0.8, "cls").select(F.col("a").alias("x"), F.col("b").alias("y")).checkpoint()
    members = keyed.join(classes, "key").select("ord", "cls").checkpoint()
    first = members.where("ord = cls").select(F.col("ord").alias("y"))
    return greedy.greedy_rounds(rows, greedy.linked_classes(members, pairs), first=first).select("slot", F.col("winner").alias("article_id"))


@query()
def jaccard_dedupe(spark, sf_dir):
    """Near-duplicates merged by the greedy walk, with better ones in their slots, over links that SQL can express."""
    return _jaccard_choice(spark, sf_dir)


@query()
def jaccard_ranking(spark, sf_dir):
    """The articles to score after that walk: at most 3 of each noisy source, 5 of all noisy ones, 25 altogether."""
    rows = articles_v(spark, sf_dir).select("article_id", "source", F.col("source").isin(*PROFILE.noisy).alias("is_noisy"))
    return rank.source_quotas(_jaccard_choice(spark, sf_dir).join(rows, "article_id"), "slot").select("slot", "article_id", "source")


ORACLE_SQL["jaccard_dedupe"] = f"WITH RECURSIVE {SQL_VIEWS} {_WALK} SELECT slot, article_id FROM chosen"
ORACLE_SQL["jaccard_ranking"] = f"""WITH RECURSIVE {SQL_VIEWS} {_WALK},
z AS (SELECT slot, article_id, source, source IN ('src16', 'src17', 'src18', 'src19') AS noisy FROM chosen JOIN articles_v USING (article_id)),
z1 AS (SELECT *, row_number() OVER (PARTITION BY source, noisy ORDER BY slot) AS a FROM z),
z2 AS (SELECT *, row_number() OVER (PARTITION BY noisy ORDER BY slot) AS b FROM z1 WHERE NOT noisy OR a <= 3)
SELECT slot, article_id, source FROM z2 WHERE NOT noisy OR b <= 5 ORDER BY slot LIMIT 25"""


@query()
def near_dup_dedupe(spark, sf_dir):
    ensure_checkpoints(spark)
    return similarity.dedupe_near(rank.ranked_candidates(articles_v(spark, sf_dir), PROFILE, AS_OF), PROFILE).select("article_id", "slot", "priority")


@query()
def diversified_stories(spark, sf_dir):
    """Per model: the 15 best scored articles, thinned to diverse stories."""
    top = rank.top_scored_per_report(scored_v(spark, sf_dir), ["provider"])
    return similarity.diversify(top, PROFILE, ["provider"]).select("provider", "article_id", "rank")


# ---- aggregates ---------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM articles_v) AS articles, (SELECT count(*) FROM scores_v) AS scores")
def corpus_stats(spark, sf_dir):
    return quality.corpus_stats(articles_v(spark, sf_dir), scores_v(spark, sf_dir))


@query("SELECT source, count(*) AS n FROM articles_v GROUP BY source")
def articles_by_source(spark, sf_dir):
    return quality.articles_by_source(articles_v(spark, sf_dir))


@query("SELECT event_type AS source, 'event' AS kind, count(*) AS n FROM events GROUP BY event_type")
def items_per_source(spark, sf_dir):
    return quality.items_per_source(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lit("event").alias("kind")))


@query("SELECT provider, model, count(*) AS n FROM scores_v GROUP BY provider, model")
def scores_by_model(spark, sf_dir):
    return quality.scores_by_model(scores_v(spark, sf_dir))


@query("SELECT DISTINCT provider, model FROM scores_v")
def distinct_models(spark, sf_dir):
    return quality.distinct_models(scores_v(spark, sf_dir))


@query("SELECT provider, model, min(relevance_score) AS min_score, max(relevance_score) AS max_score, round(avg(relevance_score), 1) AS mean_score FROM scores_v GROUP BY provider, model")
def score_distribution(spark, sf_dir):
    return quality.score_distribution(scores_v(spark, sf_dir))


@query("SELECT provider, model, 'confidence' AS field, confidence AS label, count(*) AS n FROM scores_v GROUP BY ALL UNION ALL SELECT provider, model, 'signal', signal, count(*) FROM scores_v GROUP BY ALL")
def label_histogram(spark, sf_dir):
    return quality.label_histogram(scores_v(spark, sf_dir))


@query(f", a AS (SELECT provider, model, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 86400) AS age FROM scored_v) SELECT provider, model, count(*) FILTER (age > 7) AS stale, count(*) FILTER (age IS NULL) AS undated, count(*) AS total FROM a GROUP BY provider, model")
def staleness(spark, sf_dir):
    return quality.staleness(scored_v(spark, sf_dir), AS_OF)


@query("SELECT count(*) FILTER (published_at IS NULL) AS undated, count(*) AS total FROM articles_v")
def missing_dates(spark, sf_dir):
    return quality.missing_dates(articles_v(spark, sf_dir))


@query("SELECT provider, source, count(*) AS article_count, coalesce(max(relevance_score), 0) AS top_score, count(*) FILTER (relevance_score >= 90) AS story_count FROM scored_v GROUP BY provider, source")
def report_totals(spark, sf_dir):
    return quality.report_totals(scored_v(spark, sf_dir).withColumn("is_story", F.col("relevance_score") >= 90), ["provider", "source"])


@query(""", f AS (SELECT article_id, provider, model, (article_id + k) % 3 <> 0 AS had, article_id % 4 <> 0 AS ok FROM articles_v CROSS JOIN models_v)
SELECT provider, model, count(*) FILTER (NOT had) AS attempted, count(*) FILTER (NOT had AND ok) AS scored, count(*) FILTER (had) AS skipped, count(*) FILTER (NOT had AND NOT ok) AS failed FROM f GROUP BY provider, model""")
def model_coverage(spark, sf_dir):
    frozen, models = articles_v(spark, sf_dir), models_v(spark)
    attempts = frozen.select("article_id", each_model()).select("article_id", "m.*").where((F.col("article_id") + F.col("k")) % 3 == 0).select("article_id", "provider", "model", (F.col("article_id") % 4 != 0).alias("ok"))
    return quality.model_coverage(frozen, models.drop("k"), scores_v(spark, sf_dir), attempts)


@query(f"SELECT {_TS.format(chr(39).join(['date_trunc(', 'day', ', ts)']))} AS day, event_type AS source, count(*) AS n FROM events GROUP BY ALL")
def daily_source_counts(spark, sf_dir):
    return quality.daily_source_counts(read_table(spark, sf_dir, "events"), "ts", "event_type").withColumn("day", shown("day"))


@query(f"SELECT {_TS.format(chr(39).join(['date_trunc(', 'day', ', ts)']))} AS day, event_type AS source, count(*) AS n FROM events GROUP BY ALL")
def windowed_source_counts(spark, sf_dir):
    """The stream's tumbling windows on a table."""
    return source_counts(read_table(spark, sf_dir, "events"), "ts", "event_type").withColumn("day", shown("day"))


# ---- keyed merges -------------------------------------------------------------------------------------------------


@query("SELECT article_id, content_hash, article_id % 2 <> 0 AS is_new FROM articles_v")
def insert_new_articles(spark, sf_dir):
    """Known articles keep their id; of new ones the flag counts (their ids are hashes)."""
    a = articles_v(spark, sf_dir)
    out = merge.insert_new_articles(a.where("article_id % 2 = 0"), a.withColumnRenamed("article_id", "given"))
    return out.select(F.when(F.col("is_new"), F.col("given")).otherwise(F.col("article_id")).alias("article_id"), "content_hash", "is_new")


@query(f"SELECT article_id, provider, model, CASE WHEN article_id % 4 = 0 THEN -1 ELSE relevance_score END AS relevance_score FROM scores_v")
def upsert_scores(spark, sf_dir):
    s = scores_v(spark, sf_dir)
    newer = s.where("article_id % 4 = 0").withColumn("relevance_score", F.lit(-1)).withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 1 DAY"))
    older = s.where("article_id % 4 = 1").withColumn("relevance_score", F.lit(-2)).withColumn("scored_at", F.col("scored_at") - F.expr("INTERVAL 1 DAY"))
    return merge.upsert_scores(s, newer.unionByName(older)).select("article_id", "provider", "model", "relevance_score")


@query("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'changed' ELSE impact END AS impact FROM analyses_v")
def upsert_analyses(spark, sf_dir):
    a = analyses_v(spark, sf_dir)
    newer = a.where("article_id % 3 = 0").withColumn("impact", F.lit("changed")).withColumn("analyzed_at", F.col("analyzed_at") + F.expr("INTERVAL 1 DAY"))
    return merge.upsert_analyses(a, newer).select("article_id", "impact")


def _tracker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_v(spark, sf_dir).where("provider = 'p0'").select("article_id", "source", "title", "summary", "relevance_score", "url", "published_at", "collected_at")
    return s.join(analyses_v(spark, sf_dir), "article_id")


def tracker_v(spark: SparkSession, items: DataFrame) -> DataFrame:
    """A tracker of analysed items with some human columns."""
    from newsloom.schemas import TRACKER

    base = merge.merge_tracker(spark.createDataFrame([], TRACKER), items, "2024-02-05 00:00:00")
    return base.withColumn("id", F.col("article_id")).withColumn("owner", F.when(F.col("article_id") % 8 == 0, F.lit("ann"))).withColumn("status", F.when(F.col("article_id") % 8 == 0, F.lit("done")).otherwise(F.col("status")))


_KNOWN = "coalesce(s.published_at < TIMESTAMP '2024-01-20', false)"
_TRACK = f"""SELECT a.article_id, {_TS.format('coalesce(s.published_at, s.collected_at)')} AS item_date, a.impact, CASE WHEN {_KNOWN} AND a.article_id % 8 = 0 THEN 'ann' END AS owner, CASE WHEN {_KNOWN} AND a.article_id % 8 = 0 THEN 'done' ELSE 'pending' END AS status,
CASE WHEN {_KNOWN} THEN '2024-02-05 00:00:00' ELSE '{NOW}' END AS created, '{NOW}' AS updated FROM analyses_v a JOIN scored_v s ON s.article_id = a.article_id AND s.provider = 'p0'"""


@query(_TRACK)
def merge_tracker(spark, sf_dir):
    """All analysed items go into a tracker that knows the older ones; each comes twice, once with an older analysis."""
    items = _tracker_items(spark, sf_dir)
    older = items.withColumn("impact", F.lit("outdated")).withColumn("analyzed_at", F.col("analyzed_at") - F.expr("INTERVAL 1 DAY"))
    out = merge.merge_tracker(tracker_v(spark, items.where("published_at < TIMESTAMP '2024-01-20'")), items.unionByName(older), NOW)
    return out.select("article_id", shown("item_date").alias("item_date"), "impact", "owner", "status", shown("created_at").alias("created"), shown("updated_at").alias("updated"))


@query(f"""SELECT article_id AS id, CASE WHEN article_id % 12 = 0 THEN 'bob' WHEN article_id % 8 = 0 THEN 'ann' END AS owner, CASE WHEN article_id % 8 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN article_id % 12 = 0 THEN '{NOW}' ELSE '2024-02-05 00:00:00' END AS updated FROM analyses_v""")
def apply_actions(spark, sf_dir):
    """Two actions on each twelfth row of a whole tracker; the later one counts."""
    t = tracker_v(spark, _tracker_items(spark, sf_dir))
    action = lambda who, at: t.where("id % 12 = 0").select("id", F.lit(who).alias("owner"), F.lit(None).cast("string").alias("status"), F.lit(at).alias("acted_at"))
    return merge.apply_actions(t, action("zoe", 1).unionByName(action("bob", 2)), NOW)[0].select("id", "owner", "status", shown("updated_at").alias("updated"))


@query("SELECT article_id AS id, 'ann' AS owner, impact FROM analyses_v WHERE article_id % 8 = 0 ORDER BY article_id LIMIT 50")
def tracker_query(spark, sf_dir):
    """A listing with a limit; all rows changed at the same time, so the id decides."""
    return scored.tracker_query(tracker_v(spark, _tracker_items(spark, sf_dir)), "demo", 50, status="done").select("id", "owner", "impact")


def run_events_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from events: one run for each user; event 0 of four starts it, event 3 ends it."""
    e = read_table(spark, sf_dir, "events").where("event_id % 4 IN (0, 3)")
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), F.lit("cron").alias("trigger_type"), F.when(F.col("event_id") % 4 == 0, "start").otherwise("finish").alias("event"), F.col("ts"),
        F.when(F.col("event_id") % 8 == 3, "success").otherwise("failed").alias("status"), F.col("event_id").cast("int").alias("source_count"), F.lit(2).alias("story_count"), F.lit(True).alias("email_sent"), F.lit(None).cast("string").alias("error_message"),
    )


@query(f"""SELECT CAST(user_id AS VARCHAR) AS run_id, coalesce(arg_max(CASE WHEN event_id % 8 = 3 THEN 'success' ELSE 'failed' END, ts) FILTER (event_id % 4 = 3), 'running') AS status, {_TS.format('min(ts) FILTER (event_id % 4 = 0)')} AS started, {_TS.format('max(ts) FILTER (event_id % 4 = 3)')} AS finished
FROM events WHERE event_id % 4 IN (0, 3) GROUP BY user_id""")
def run_lifecycle(spark, sf_dir):
    return merge.run_lifecycle(run_events_v(spark, sf_dir)).select("run_id", "status", shown("started_at").alias("started"), shown("finished_at").alias("finished"))


@query("SELECT article_id, 'legacy' AS provider, 'legacy' AS model, CASE WHEN article_id % 2 = 0 THEN category ELSE 'old' END AS category, signal FROM scores_v")
def evolve_scores(spark, sf_dir):
    old = scores_v(spark, sf_dir).select("article_id", F.when(F.col("article_id") % 2 == 0, F.col("category")).alias("category"), F.lit("old").alias("fx_channel"), F.col("signal").alias("likely_usdjpy_direction"))
    return merge.evolve_scores(old, ["article_id", "provider", "model", "category", "signal"], {"category": "fx_channel", "signal": "likely_usdjpy_direction"})


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY")
def expire_reports(spark, sf_dir):
    return merge.expire_reports(read_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at")), 30, "2024-02-20").select("event_id")


@query(f"""SELECT profile_id, run_id, provider AS scoring_provider FROM (SELECT event_type AS profile_id, event_id AS run_id, 'p' || (event_id % 3) AS provider, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 5 <> 0) WHERE k = 1""")
def latest_report(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    runs = e.select(F.col("event_type").alias("profile_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("generated_at"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("success").alias("status"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"), F.lit("m").alias("model"), none.alias("scoring_provider"), none.alias("scoring_model"), none.alias("analysis_provider"), none.alias("analysis_model"))
    return merge.latest_report(runs).select("profile_id", "run_id", "scoring_provider")


# ---- replies, prompts, memos --------------------------------------------------------------------------------------

_TAKE = "coalesce(nullif(why_it_matters, ''), nullif(summary, ''), '')"


@query(f"SELECT article_id, provider, {_TAKE} AS takeaway FROM scores_v")
def takeaway(spark, sf_dir):
    s = scores_v(spark, sf_dir).withColumn("impact", F.lit(""))
    return s.select("article_id", "provider", text.takeaway().alias("takeaway"))


def replies_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies around the score rows: fenced, in prose, with a string score, without fields, and no JSON at all."""
    s = scored_v(spark, sf_dir)
    full = F.to_json(F.struct("relevance_score", "category", "signal", F.col("why_it_matters")))
    kind = F.col("article_id") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here it is: "), full, F.lit(" as asked.")))
        .when(kind == 2, F.concat(F.lit('{"relevance_score": "'), F.col("relevance_score").cast("string"), F.lit('"}'))).when(kind == 3, F.lit("{}")).otherwise(F.lit("no idea"))
    )
    return s.withColumn("reply", reply)


@query("""SELECT article_id, provider, CASE article_id % 5 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE relevance_score END AS relevance_score, CASE WHEN article_id % 5 < 2 THEN category ELSE 'other' END AS category,
CASE WHEN article_id % 5 < 2 THEN signal ELSE 'unclear' END AS signal, 'low' AS confidence, title || ' (' || source || ')' AS source_citation FROM scored_v""")
def parse_score_json(spark, sf_dir):
    return replies_v(spark, sf_dir).select("article_id", "provider", *parse_score()).drop("summary", "why_it_matters")


@query("""SELECT article_id, provider, category, 'n/a' AS entity, CASE WHEN why_it_matters <> '' THEN why_it_matters ELSE summary END AS impact, 'Monitor only' AS suggested_action FROM scored_v""")
def parse_analysis_json(spark, sf_dir):
    return replies_v(spark, sf_dir).select("article_id", "provider", *parse_analysis())


_PROMPT = f"""'Rate this item for demo.' || chr(10) || 'Source: ' || source || chr(10) || 'Title: ' || title || chr(10) || 'Link: ' || url || chr(10) || 'Date: ' || coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || 'Z', 'unknown') || chr(10) || 'Text: ' || coalesce(nullif(summary, ''), nullif(raw_excerpt, ''), '(none)')"""


@query(f"SELECT article_id, {_PROMPT} AS prompt FROM articles_v")
def score_prompts(spark, sf_dir):
    return articles_v(spark, sf_dir).select("article_id", inference.score_prompt(PROFILE).alias("prompt"))


@query(f"SELECT article_id, CAST(length({_PROMPT}) % 101 AS INTEGER) AS relevance_score, provider FROM articles_v, (VALUES ('p0')) v(provider) WHERE article_id NOT IN (SELECT article_id FROM scores_v WHERE provider = 'p0')")
def score_stage(spark, sf_dir):
    """The scoring stage with the rule-based model over all unscored articles."""
    new, _ = inference.score(articles_v(spark, sf_dir), scores_v(spark, sf_dir), inference.rule_based_infer, PROFILE, "p0", "m0", NOW)
    return new.select("article_id", "relevance_score", "provider")


def _block(number: str) -> str:
    return f"""'### ' || {number} || '. ' || title || chr(10) || '- **Source:** ' || label || ' | **Signal:** ' || sig || ' | **Relevance:** ' || rel || chr(10) || CASE WHEN take <> '' THEN '- ' || take || chr(10) ELSE '' END || '- **Date:** ' || shown || ' | [Read more](' || url || ')' || chr(10)"""


_MEMO = f"""
, m AS (SELECT s.article_id, s.source, s.title, s.url, coalesce(nullif(a.category, ''), s.category) AS category, coalesce(nullif(a.category, ''), s.category) AS shown_category, row_number() OVER (PARTITION BY s.source ORDER BY relevance_score DESC, s.article_id) AS rank,
      CASE s.source WHEN 'src0' THEN 'Source Zero' WHEN 'src1' THEN 'Source One' ELSE s.source END AS label, CASE s.signal WHEN 's0' THEN 'Up' WHEN 's1' THEN 'Down' ELSE s.signal END AS sig,
      CASE WHEN relevance_score >= 80 THEN 'High' WHEN relevance_score >= 60 THEN 'Medium' ELSE 'Low' END AS rel, coalesce(nullif(a.impact, ''), nullif(s.why_it_matters, ''), nullif(s.summary, ''), '') AS take,
      CASE WHEN published_at IS NOT NULL THEN strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d') ELSE '~' || strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d') || ' (first seen)' END AS shown
      FROM scored_v s LEFT JOIN analyses_v a USING (article_id) WHERE s.provider = 'p0'),
st AS (SELECT source, string_agg({_block('rank')}, chr(10) ORDER BY rank) AS part FROM m WHERE rank <= 3 GROUP BY source),
gr AS (SELECT source, string_agg({_block('k')}, chr(10) ORDER BY k) AS part FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k FROM m WHERE shown_category IN ('c1', 'c2', 'c3')) WHERE k <= 2 GROUP BY source),
ci AS (SELECT source, string_agg('- [' || title || '](' || url || ') — ' || label || ', ' || shown, chr(10) ORDER BY rank) AS part FROM m WHERE rank <= 4 GROUP BY source)
SELECT s.source, array_to_string(['# Demo Memo' || chr(10), '**Generated:** 2024-02-10 08:00 HK time', '**Scoring LLM:** p0 / m0', '**Analysis LLM:** a0 / b0', '**Profile:** demo', '**Summary style:** base', '**Sources:** all' || chr(10),
  '## Market Read' || chr(10), 'No narrative is available for this report.', '', '## Top Stories' || chr(10), coalesce(st.part, '_No items in this section._' || chr(10)), '## Grouped' || chr(10), coalesce(gr.part, '_No items in this section._' || chr(10)),
  '## Watchlist' || chr(10), '- Next release', '', '## Source Citations' || chr(10), ci.part, '', '---'], chr(10)) AS body
FROM (SELECT DISTINCT source FROM m) s LEFT JOIN st USING (source) LEFT JOIN gr USING (source) LEFT JOIN ci USING (source)"""


@query(_MEMO)
def memo_markdown(spark, sf_dir):
    """One memo for each source, all in one job."""
    from pyspark.sql import Window

    items = scored.merge_analysis(scored_v(spark, sf_dir).where("provider = 'p0'"), analyses_v(spark, sf_dir))
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("relevance_score").desc(), "article_id")))
    lit = F.lit
    reports = items.select("source").distinct().select("source", lit(NOW).cast("timestamp").alias("generated_at"), lit("p0").alias("scoring_provider"), lit("m0").alias("scoring_model"), lit("a0").alias("analysis_provider"), lit("b0").alias("analysis_model"), lit("").alias("narrative"), lit(None).cast("array<string>").alias("watchlist"))
    return report.memo_markdown(reports, items, items, PROFILE, ["source"])


@query("SELECT article_id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, collected_at DESC, article_id) AS place FROM articles_v")
def canonical_order(spark, sf_dir):
    """All articles numbered in canonical order."""
    ensure_checkpoints(spark)
    return rank.with_rank(articles_v(spark, sf_dir), scored.canonical_order(), "place").select("article_id", F.col("place").cast("long").alias("place"))
