"""SimHash near-duplicates: 64-bit fingerprints, and links within a small Hamming radius found with BK-trees.

Fingerprints that are equal collapse first.  Two fingerprints within radius r share at least one of r + 1 blocks of
bits, so a shard holds the distinct fingerprints with one block value, and one BK-tree is built for each shard.  Trees
travel to the queries of their shard through a shuffle.  This replaces a broadcast of all shards' trees, which together
are all fingerprints and grow with the corpus; a shard is all that its queries can match.  A shard that would be large is split again on the blocks of its other bits,
which is just as exact, so a group of similar texts cannot fill one task.  Each shard reports links as a forest (each
fingerprint to one earlier member of its cluster), so copies never expand into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.names import unused
from newsloom.operators.components import connected_components, join_counted
from newsloom.tables import ensure_checkpoints

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RADIUS, SHINGLE_WORDS, SEED = 3, 3, 42
#: Fingerprints of a shard above which it is split on its other bits.
SHARD_SIZE = 512
#: Rows of one fingerprint above which they are not shuffled by it.
HOT_COPIES = 1000
#: Ids are below this.
NAMELESS = 1 << 62


def fingerprint(text: str | None, words_in: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one whole text: a bit is set where over half of all shingle hashes (repeats counted) have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < words_in:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_in)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, fp, and the columns ``more``) for each row; fp is the fingerprint as a signed 64-bit integer, zero for a text without words or null."""
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), *part.columns[2:]], names=[id_col, "fp", *more])

    return docs.select(id_col, text_col, *more).mapInArrow(run, f"`{id_col}` {id_type}, fp long{types and ', '}{types}")


class BKTree:
    """A tree of distinct fingerprints; each child hangs on the edge of its Hamming distance to the parent.

    A search follows only the edges within the radius of the distance to the node (triangle inequality).
    """

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The number of the value's node, which is made unless the value is there."""
        if not self.values:
            self.values.append(value)
            self.edges.append({})
            return 0
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            if not d:
                return node
            child = self.edges[node].get(d)
            if child is None:
                self.edges[node][d] = len(self.values)
                self.values.append(value)
                self.edges.append({})
                return len(self.values) - 1
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        """The numbers of all nodes within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            todo += [child for edge, child in self.edges[node].items() if d - radius <= edge <= d + radius]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the clusters of a shard's distinct values, one fewer than each cluster has members."""
    tree, root, out = BKTree(), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for value in values:
        near = tree.near(value, radius)
        k = tree.add(value)
        if k == len(root):
            root.append(k)
        for other in near:
            a, b = top(k), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((value, tree.values[other]))
    return out


def _block(fp: Column, width: int, k: int) -> Column:
    return F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links (src, dst) between the nodes (own, fp) that join all pairs of fingerprints within the radius.

    ``nodes`` has each fingerprint once, with a number ``own`` that goes with it through the shards; src and dst are
    structs (own, fp), so no join by a fingerprint of many links is needed afterwards.
    """
    blocks = radius + 1
    width = 64 // blocks
    if width * blocks != 64 or width % blocks:
        raise ValueError("the radius must be 1 or 3")
    keyed = nodes.where("fp is not null").select("own", "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("fp"), width, k).alias("value")) for k in range(blocks)))).alias("key")).select("own", "fp", "key.block", "key.value")
    sizes = keyed.groupBy("block", "value").count()
    lone = keyed.join(sizes.where("count > 1"), ["block", "value"])
    # the other bits of a large shard, moved together, split it on blocks of their own: exact for the same reason
    narrow = (64 - width) // blocks
    others = F.coalesce(*(F.when(F.col("block") == k, (F.shiftrightunsigned("fp", width * (k + 1)) if k < blocks - 1 else F.lit(0).cast("long")) * F.lit(1 << (width * k) if k < blocks - 1 else 1) + F.col("fp").bitwiseAND(F.lit((1 << (width * k)) - 1))) for k in range(blocks)))
    small = lone.where(F.col("count") <= shard_size).select("own", "fp", "block", "value", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"))
    large = lone.where(F.col("count") > shard_size).select("own", "fp", "block", "value", others.alias("rest"))
    large = large.select("own", "fp", "block", "value", F.posexplode(F.array(*(_block(F.col("rest"), narrow, k) for k in range(blocks)))).alias("part", "sub"))

    def find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by shard; a shard may go on in the next batch
        key, held = None, {}

        def found() -> list[tuple[int, ...]]:
            pairs = shard_links(list(held), radius) if len(held) > 1 else []
            return [(held[a], a, held[b], b) for a, b in pairs]

        for batch in batches:
            out: list[tuple[int, ...]] = []
            for fp, number, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    out += found()
                    key, held = own, {}
                held[fp & 0xFFFFFFFFFFFFFFFF] = number & 0xFFFFFFFFFFFFFFFF
            yield _pairs(out)
        yield _pairs(found())

    shards = small.unionByName(large).repartition("block", "value", "part", "sub").sortWithinPartitions("block", "value", "part", "sub", "fp")
    found = shards.select("fp", "own", "block", "value", "part", "sub").mapInArrow(find_all, "a long, b long, c long, d long")
    end = lambda own, fp: F.struct(F.col(own).alias("own"), F.col(fp).alias("fp"))
    return found.select(end("a", "b").alias("src"), end("c", "d").alias("dst"))


def _pairs(found: list[tuple[int, ...]]) -> pa.RecordBatch:
    columns = np.array(found, dtype=np.uint64).reshape(-1, 4).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(columns[:, k]) for k in range(4)], names=["a", "b", "c", "d"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the least id that can be reached over links of at most ``radius`` differing bits.  Only ids and
    fingerprints are shuffled; the fingerprints are computed once and kept in the shared folder.

    Ids are whole numbers.  Null and empty texts have fingerprint zero and are linked like any other; null ids never count as the least id
    (a component of null ids alone has a null component_id); repeated rows stay; an empty table gives no rows.
    """
    found = _grouped(docs, radius, id_col, text_col)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, fp, the columns ``more``, component_id, group), for ids and ``more`` of other names; group is the component's least node and never null."""
    ensure_checkpoints(docs.sparkSession)
    prints = fingerprints(docs, id_col, text_col, *more).checkpoint()
    # a fingerprint stands for its documents under the least of their ids, so a component's least node is the answer;
    # one without any id stands under a number that is above all ids.  The fingerprint is part of the node, since
    # unrelated texts can have one id
    nodes = prints.groupBy("fp").agg(F.coalesce(F.min(id_col).cast("long"), F.lit(NAMELESS)).alias("own"), F.count("*").alias("n")).checkpoint()
    least = connected_components(links(nodes.drop("n"), radius), "src", "dst")
    of_print = nodes.select("fp", "n", F.struct("own", "fp").alias("own")).join(least, F.col("own") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "own").alias("_group")).checkpoint()
    component_id = F.when(F.col("_group.own") < NAMELESS, F.col("_group.own")).alias("component_id")
    return join_counted(prints, of_print, "fp", hot=HOT_COPIES).select(id_col, "fp", *more, component_id, F.col("_group").alias("group"))


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document for each near-duplicate group: that of the least id.

    Of the group's rows with that id one stays (the first by text).  Rows whose id is null stay only where their whole
    group has no id, one for each such group; unrelated texts under one id are groups of their own.
    """
    from pyspark.sql import Window

    key, group, copy = unused(docs, "_key", "_group", "_copy")
    # rows with one key have one id and one text (null and empty are linked anyway), and so one group
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))
    found = _grouped(keyed, radius, id_col, text_col, key)
    heads = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(key, F.col("group").alias(group)).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(text_col))
    return keyed.join(heads, key).withColumn(copy, rank).where(F.col(copy) == 1).select(*docs.columns)
