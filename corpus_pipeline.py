"""A corpus pipeline of five stages over ``documents``; each stage works on all rows that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of ``docs``.

Odd rows, in all stages: null ids and sources are values like any other, null and empty texts have no words; equal rows
are separate documents until the second stage keeps one of each group; columns of any name pass through to the last
stage; texts of any length are taken whole; an empty table, of documents, labels or benchmark, gives a result of its
columns (without labels, or with labels of no document, only the base rules judge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontaminate, mixing, quality, simhash, token_store
from newsloom.llm.queries import vocabulary
from newsloom.tables import fresh_dir, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the isolation forest go; so do null, empty and short texts (under 50 words)."""
    return quality.keep_good(docs, quality.fit_rules(docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id (null ids last, then by text)."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; texts without words and empty benchmarks take none away."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as its source's target asks for, none more than twice; texts without words are
    never taken, and rows with one source and id are taken alike."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids go to plane-shuffled files; the result is read back from them, one row for each document and copy, in the order
    of ids (null first); a text without tokens has the end id alone."""
    folder, shards = token_store.write_ids(docs, vocabulary("word_bpe_49k.json"))
    return token_store.read_ids(spark, folder, shards)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("token-ID output", token_ids),
]

#: The stages' models, fingerprints and tokenisers cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read by the next.

    An empty ``documents`` gives no rows; other odd rows are as the stages state.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
