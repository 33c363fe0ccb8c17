"""Connected components of a sparse edge table, as Spark joins with checkpointed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.tables import ensure_checkpoints

#: Rows of a key above which they are not shuffled by it, and such keys up to which their table is broadcast (beyond
#: that, adaptive execution splits what is skewed).
HOT, MOST_BROADCAST = 128, 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of an undirected edge table; component is the least node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each node's larger neighbours are hung on
    its least neighbour, then its smaller ones.  A round is two grouped shuffles of the edge set, which only shrinks;
    the number of rounds grows with the logarithm of the longest chain.  The least neighbour comes from a partial
    aggregate.  It meets the links of its node by a join; nodes of more than HOT links are few, and theirs stay where
    they are while the least neighbours are broadcast, so no task gets all links of a node.

    Null endpoints, self links and repeated links are ignored; an empty table gives an empty result.
    """
    ensure_checkpoints(edges.sparkSession)
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = _state(links)
    for _ in range(max_rounds):
        links = _small_star(_large_star(links)).checkpoint()
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: each link leads from a node to its component's least node
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    larger = links.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u's larger neighbours
    return join_counted(larger, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to the least of these neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(links, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str = "n", hot: int = HOT) -> DataFrame:
    """The rows with their key's row of ``table``, less its column ``count``, which says how often the key is in rows.

    Rows of keys that are there more than ``hot`` times are not shuffled: their keys are few, and are broadcast.  The
    table is read more than once; a costly one should be written first.
    """
    often = table.where(F.col(count) > hot).drop(count)
    if not 0 < often.count() <= MOST_BROADCAST:
        return rows.join(table.drop(count), key)
    often = often.checkpoint()
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.where(F.col(count) <= hot).drop(count), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)
