"""Tables that are merged where they lie: partitioned by a hash of the key, and bucketed by it within.

A merge reads and rewrites only the partitions that its changes touch, and only the changes are shuffled: the table's
side of the join comes bucket by bucket.  Both are Spark's own mechanisms (bucketed tables, dynamic partition overwrite).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """A table by its name; ``parts`` and ``buckets`` stay as they were when it was made.

    A merge of few keys rewrites a share of the table that shrinks with ``parts``; a merge's tasks, and the files of a
    part, are ``buckets``.
    """

    name: str
    key: tuple[str, ...]
    parts: int = 64
    buckets: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame, path: str) -> None:
        """Write the table from rows with unique keys to a folder; one that exists by this name is an error."""
        placed = rows.withColumn("part", self.part()).repartition(self.buckets, *self.key)
        placed.write.format("parquet").option("path", path).partitionBy("part").bucketBy(self.buckets, *self.key).sortBy(*self.key).saveAsTable(self.name)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop("part")

    def touched(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the partitions that hold the keys of ``rows``; no others are read.  The driver gets the
        partitions' numbers, at most ``parts`` of them."""
        parts = [r["part"] for r in rows.select(self.part().alias("part")).distinct().collect()]
        return rows.sparkSession.table(self.name).where(F.col("part").isin(parts)).drop("part")

    def new_rows(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the table lacks."""
        return rows.join(self.touched(rows).select(*self.key), list(self.key), "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys are new to the table and unique."""
        columns = rows.sparkSession.table(self.name).columns
        rows.withColumn("part", self.part()).repartition(self.buckets, *self.key).select(*columns).write.insertInto(self.name)

    def merge(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched partitions by ``step(their rows, changes)``, whose keys must be keys of either.

        Changes without a whole key are left out.  Tasks write beside the table, and the partitions are exchanged when all
        are written: a lost executor costs its tasks, and a merge that fails before leaves the table as it was.
        """
        spark = changes.sparkSession
        whole = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key))
        merged = step(self.touched(whole), whole).withColumn("part", self.part())
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            merged.select(*spark.table(self.name).columns).write.insertInto(self.name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def latest(current: DataFrame, changes: DataFrame, key: tuple[str, ...], time: str) -> DataFrame:
    """``last_wins`` over rows with unique keys, as a join that leaves them where they are: the later row of each key, at
    equal times the change, and of several changes the one with the greatest other columns, in their order."""
    others = [c for c in current.columns if c not in (*key, time)]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc(), *(F.col(c).desc_nulls_last() for c in others)))
    new = changes.withColumn("_k", last).where("_k = 1").select(*key, F.struct(*(F.col(c) for c in (time, *others))).alias("_new"))
    old = current.select(*key, F.struct(*(F.col(c) for c in (time, *others))).alias("_old"))
    later = F.col("_old").isNull() | (F.col("_new").isNotNull() & F.coalesce(F.col("_new")[time] >= F.col("_old")[time], F.col("_old")[time].isNull()))
    both = old.join(new, list(key), "full_outer").withColumn("_row", F.when(later, F.col("_new")).otherwise(F.col("_old")))
    return both.select(*(c if c in key else F.col("_row")[c].alias(c) for c in current.columns))
