"""The gates of many profiles at once: one pass over the articles, whatever the number of profiles.

An automaton over the words of all profiles reads each text once.  What it finds goes to the profiles that list the
article's source, and all rules that differ by profile and source are a joined dimension, so that the plan has one scan
and does not grow with the number of profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.operators.gate import noisy_hits, title_pattern, with_lower
from newsloom.profiles import Profile

_ROLES = ("direct", "strong", "weak", "general", "words")
_FOUND = "array<struct<profile_id:string," + ",".join(f"{r}:array<string>" for r in _ROLES) + ">>"
_FOUND_ARROW = pa.list_(pa.struct([("profile_id", pa.string()), *((r, pa.list_(pa.string())) for r in _ROLES)]))


def listed_sources(p: Profile) -> list[str]:
    """The sources of a profile, and those that it only names as noisy."""
    return list(dict.fromkeys([*(s.id for s in p.sources), *sorted(p.noisy)]))


def source_rules(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """One row for each (profile_id, source): its tier, whether it is noisy, title rules and entity rules that fit it,
    and the words of the profile's high-priority tiers.  Compared words are lower-cased."""
    rows = []
    for p in profiles:
        tiers = {s.id: s.tier for s in p.sources}
        high = [list(p.tiers[t]) for t in p.high_priority_tiers if p.tiers.get(t)]
        for source in listed_sources(p):
            titles = [(title_pattern(r.pattern), r.tag) for r in p.title_rules if source.startswith(r.source_prefix)]
            own = [r for r in p.entity_rules if r.source_id == source]
            rules = [([(name, list(aliases)) for name, aliases in r.entities], list(r.context_keywords), r.entity_bonus, r.context_bonus, r.max_bonus) for r in own]
            rows.append((p.id, source, tiers.get(source, p.default_tier), source in p.noisy, titles, rules, high))
    entity = "struct<entities:array<struct<name:string,aliases:array<string>>>,contexts:array<string>,entity_bonus:int,context_bonus:int,max_bonus:int>"
    return spark.createDataFrame(
        rows, f"profile_id string, source string, tier int, is_noisy boolean, _titles array<struct<pattern:string,tag:string>>, _rules array<{entity}>, _high array<array<string>>"
    ).withColumn("_high", F.transform("_high", lambda words: F.transform(words, F.lower)))


def profile_hits(articles: DataFrame, profiles: list[Profile]) -> DataFrame:
    """The articles with profile_id, the hits of their tiers (direct, strong, weak, general) and the entity rules' words
    that they contain: one row for each profile that lists the article's source.

    Keywords keep their order and spelling; an empty one is in every text.  Articles of unlisted sources (null included)
    give no row.
    """
    spark = articles.sparkSession
    listed: dict[str, set[int]] = {}
    uses: list[tuple[str, int, int, int]] = []
    for k, p in enumerate(profiles):
        for source in listed_sources(p):
            listed.setdefault(source, set()).add(k)
        spoken = [w for r in p.entity_rules for words in (*(aliases for _, aliases in r.entities), r.context_keywords) for w in words]
        for role, words in enumerate([*(p.tiers.get(t, ()) for t in _ROLES[:3]), p.general(), dict.fromkeys(spoken)]):
            uses += [(w, k, role, at) for at, w in enumerate(words)]
    # as the texts are lower-cased by Spark, so are the words
    lower = dict(spark.createDataFrame([(w,) for w in {u[0] for u in uses}], "word string").select("word", F.lower("word")).collect())
    places: dict[str, dict[int, list[tuple[int, int, str]]]] = {}
    for word, k, role, at in uses:
        places.setdefault(lower[word], {}).setdefault(k, []).append((role, at, word))
    names = [p.id for p in profiles]
    at_source, at_lower = articles.columns.index("source"), len(articles.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in places:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for source, text in zip(batch.column(at_source).to_pylist(), batch.column(at_lower).to_pylist(), strict=True):
                wanted = listed.get(source, ())
                found = {word for _, word in automaton.iter(text)} if wanted and len(automaton) else set()
                hits: dict[int, list[tuple[int, int, str]]] = {k: [] for k in wanted}
                for word in found | ({""} & places.keys()):
                    for k in wanted & places[word].keys() if wanted else ():
                        hits[k] += places[word][k]
                out.append([{"profile_id": names[k]} | {name: [w for role, _, w in sorted(own) if role == r] for r, name in enumerate(_ROLES)} for k, own in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_lower], pa.array(out, _FOUND_ARROW)], names=[*batch.schema.names[:at_lower], "_found"])

    schema = StructType([*articles.schema.fields, *StructType.fromDDL(f"_found {_FOUND}").fields])
    return with_lower(articles).mapInArrow(run, schema).select(*articles.columns, F.inline("_found"))


def _entity_results(rules: str, words: str) -> Column:
    """(bonus, signals) of each entity rule that applies, in order; a rule applies if one of its aliases was found."""
    has = lambda w: F.array_contains(F.col(words), w)

    def result(r: Column) -> Column:
        entity = F.get(F.filter(r["entities"], lambda e: F.exists(e["aliases"], has)), 0)["name"]
        context = F.get(F.filter(r["contexts"], has), 0)
        bonus = F.least(r["entity_bonus"] + F.when(context.isNotNull(), r["context_bonus"]).otherwise(0), r["max_bonus"])
        signals = F.array_compact(F.array(F.concat(F.lit("source_boost:"), F.col("source")), F.concat(F.lit("entity:"), entity), F.concat(F.lit("entity_context:"), context)))
        return F.struct(entity.isNotNull().alias("applies"), bonus.alias("bonus"), signals.alias("signals"))

    return F.filter(F.transform(rules, result), lambda x: x["applies"])


def prioritized_profiles(articles: DataFrame, profiles: list[Profile]) -> DataFrame:
    """``prioritized(gated(articles, p), p)`` for the articles of each profile's sources, with its profile_id, in one scan.

    A row for each article and profile that lists its source, less misses of noisy sources.  The work beyond the one pass
    over the texts is the rows that come out.  Profiles need different ids; a source listed twice has its last tier.
    """
    if len({p.id for p in profiles}) < len(profiles):
        raise ValueError("profiles need different ids")
    out = profile_hits(articles, profiles).join(F.broadcast(source_rules(articles.sparkSession, profiles)), ["profile_id", "source"])
    tags = F.transform(F.filter("_titles", lambda r: F.rlike(F.col("title"), r["pattern"])), lambda r: r["tag"])
    ordinary = F.when(F.size("general") > 0, F.col("general")).otherwise(F.slice(tags, 1, 1))
    out = out.withColumn("keyword_hits", F.when(F.col("is_noisy"), noisy_hits(*map(F.col, _ROLES[:4]))).otherwise(ordinary))
    out = out.withColumn("prefilter_hit", F.size("keyword_hits") > 0).where(F.col("prefilter_hit") | ~F.col("is_noisy"))
    out = out.withColumn("_applied", _entity_results("_rules", "words")).withColumn("_joined", F.lower(F.array_join("keyword_hits", " ")))
    out = out.withColumn("boost", F.aggregate("_applied", F.lit(0), lambda s, r: s + r["bonus"])).withColumn("boost_signals", F.flatten(F.transform("_applied", lambda r: r["signals"])))
    high = F.size(F.filter("_high", lambda words: F.exists(words, lambda w: F.contains(F.col("_joined"), w))))
    base = F.size("keyword_hits") + F.col("tier") + 3 * high + F.when(F.col("prefilter_hit"), 2).otherwise(0)
    base = F.when(F.col("is_noisy"), F.greatest(F.lit(0), base - 1)).otherwise(base)
    out = out.withColumn("priority", (base + F.col("boost")).cast("int"))
    return out.select("profile_id", *articles.columns, "keyword_hits", "prefilter_hit", "tier", "is_noisy", "boost", "boost_signals", "priority")
