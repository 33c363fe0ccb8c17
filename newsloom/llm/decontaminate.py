"""Benchmark decontamination with suffix arrays over the training texts.

A shard is a run of documents inside a Spark task.  Its suffix array holds the word positions at which a match can
begin (those followed by enough words of the benchmark's vocabulary), sorted by the words that follow, and every
benchmark suffix is binary-searched in it.  Where a document is hit, its own suffixes are searched in turn among the
benchmark's sorted ones for the longest verbatim match and its place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of benchmark text in one block (each block is broadcast on its own), and bytes of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20

#: A-Z to a-z; digits, a-z and all bytes of multi-byte characters stay; every other ASCII byte to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text (null: none)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_order(stream: np.ndarray) -> np.ndarray:
    """The suffixes of a stream of numbers in order, by prefix doubling."""
    n = len(stream)
    rank, order, depth = stream.astype(np.int64), np.arange(n), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-depth] = rank[depth:] + 1 if depth < n else 0
        pair = rank * np.int64(max(int(after.max(initial=0)), 0) + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])] if n else order
        if not n or new[-1] == n - 1 or depth >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        depth *= 2


@dataclass
class TestSuffixes:
    """The windows and suffixes of a block of benchmark items, ready for binary search.

    Items of the same words are one group; a group without any id still counts as a hit.
    """

    vocabulary: dict[bytes, int]
    keys: np.ndarray  # distinct windows as big-endian word ids, padded with zeros
    sizes: np.ndarray  # words of each window
    holders: list[np.ndarray]  # of each window: the groups that hold it
    groups: list[list[str]]  # item ids with the same words
    stream: np.ndarray  # the groups' word ids one after the other, a zero after each
    _upper: np.ndarray = field(init=False)

    def __post_init__(self):
        upper = self.keys.view(np.uint8).reshape(len(self.keys), 4 * WINDOW).copy() if len(self.keys) else np.zeros((0, 4 * WINDOW), np.uint8)
        upper[np.arange(4 * WINDOW)[None, :] >= 4 * self.sizes[:, None]] = 255
        self._upper = upper.view(f"S{4 * WINDOW}").ravel()
        self._suffixes = suffix_order(self.stream)
        self._bytes = self.stream.astype(">u4").tobytes()
        group = np.cumsum(self.stream == 0) - (self.stream == 0)
        # a group's least id, as its place among all of them; groups without an id come first, as the empty text
        names = sorted({min(g, default="") for g in self.groups})
        place = {name: k for k, name in enumerate(names)}
        self._names, of_group = names, np.array([place[min(g, default="")] for g in self.groups], dtype=np.int64)
        self._name = of_group[group[self._suffixes]] if len(self.groups) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        same: dict[tuple, list[str]] = defaultdict(list)
        for item, text in items:
            if words := words_of(text):
                own = same[tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)]
                if item is not None and str(item) not in own:
                    own.append(str(item))
        holders: dict[tuple, list[int]] = defaultdict(list)
        for g, words in enumerate(same):
            size = min(WINDOW, len(words))
            for window in {words[at : at + size] for at in range(len(words) - size + 1)}:
                holders[window].append(g)
        table = np.zeros((len(holders), WINDOW), dtype=">u4")
        for k, window in enumerate(holders):
            table[k, : len(window)] = window
        stream = np.array([i for words in same for i in (*words, 0)], dtype=np.uint32)
        return cls(vocabulary, table.view(f"S{4 * WINDOW}").ravel(), np.array([len(w) for w in holders], dtype=np.int64), [np.array(g) for g in holders.values()], list(same.values()), stream)

    def longest(self, words: bytes) -> tuple[int, str]:
        """(words, least item id) of the longest start of a document's suffix, given as big-endian word ids, that
        occurs in an item; the id is empty where no such item has one."""
        size = len(words)
        start = lambda n: lambda s: self._bytes[4 * s : 4 * s + n]
        at = bisect_left(self._suffixes, words, key=start(size))
        best = 0
        for k in (at - 1, at):
            if 0 <= k < len(self._suffixes):
                own = start(size)(int(self._suffixes[k]))
                common = next((j for j in range(0, min(len(own), size), 4) if own[j : j + 4] != words[j : j + 4]), min(len(own), size))
                best = max(best, common // 4)
        n = 4 * best
        low, high = bisect_left(self._suffixes, words[:n], key=start(n)), bisect_right(self._suffixes, words[:n], key=start(n))
        return best, self._names[int(self._name[low:high].min())] if high > low else ""

    def search(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, windows) of all matches in a shard; ids: its word ids, 0 for unknown; ends: each document's end."""
        if not len(self.keys) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # known words from each position on, not past the document's end
        breaks = np.union1d(np.flatnonzero(ids == 0), ends)
        run = breaks[np.searchsorted(breaks, np.arange(len(ids)), side="right")] - np.arange(len(ids))
        run[ids == 0] = 0
        able = np.flatnonzero(run >= self.sizes.min())
        if not len(able):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.r_[ids, np.zeros(WINDOW, ids.dtype)]
        table = padded[able[:, None] + np.arange(WINDOW)[None, :]].astype(">u4")
        table[np.arange(WINDOW)[None, :] >= run[able][:, None]] = 0
        suffixes = table.view(f"S{4 * WINDOW}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array, sorted_suffixes = able[order], suffixes[order]
        low = np.searchsorted(sorted_suffixes, self.keys, side="left")
        high = np.searchsorted(sorted_suffixes, self._upper, side="right")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        windows = np.repeat(found, counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return array[np.repeat(low[found], counts) + inside], windows


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item string"


def _summary(n_words: int, spans: list[tuple[int, int]], items: set[str], longest: tuple[int, int, str] | None) -> dict:
    hit, end = 0, -1
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return {"n_words": n_words, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= n_words, "longest_words": longest[0] if longest else 0, "longest_start": longest[1] if longest else None, "longest_item": longest[2] if longest else None}


def judge_texts(texts: list[str | None], tests: Iterable[TestSuffixes]) -> list[dict]:
    """One summary for each text of a shard; the blocks of test suffixes are searched one after the other."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    longest: dict[int, tuple[int, int, str]] = {}
    for test in tests:
        get = test.vocabulary.get
        ids = np.fromiter((i for w in words for i in map(get, w, repeat(0))), dtype=np.uint32, count=int(lengths.sum()))
        positions, windows = test.search(ids, ends)
        if not len(positions):
            continue
        # hits in order of place, joined to spans; items once for each window of a document
        order = np.argsort(positions, kind="stable")
        positions, windows = positions[order], windows[order]
        docs = np.searchsorted(ends, positions, side="right")
        for key in np.unique(docs * np.int64(len(test.keys)) + windows).tolist():
            d, w = divmod(key, len(test.keys))
            for g in test.holders[w].tolist():
                items[d].update(test.groups[g])
        stops = positions + test.sizes[windows]
        reach = np.maximum.accumulate(stops)
        first = np.flatnonzero(np.r_[True, (positions[1:] > reach[:-1]) | (docs[1:] != docs[:-1])])
        stream = ids.astype(">u4").tobytes()
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(positions)], strict=True):
            d, stop = int(docs[a]), int(reach[b - 1])
            spans[d].append((int(positions[a] - starts[d]), int(stop - starts[d])))
            for p in np.unique(positions[a:b]).tolist():
                best = longest.get(d)
                if best is not None and stop - p < best[0]:
                    break  # no later match of this span is longer
                found, item = test.longest(stream[4 * p : 4 * stop])
                at = p - int(starts[d])
                if best is None or (-found, at, item) < (-best[0], *best[1:]):
                    longest[d] = (found, at, item)
    return [_summary(n, spans[d], items[d], longest.get(d)) for d, n in enumerate(lengths.tolist())]


def _shards(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SHARD_BYTES of text, one row at least."""
    sizes = [len(t) if t else 0 for t in batch.column(column).to_pylist()]
    begin, total = 0, 0
    for at, size in enumerate(sizes):
        if total and total + size > SHARD_BYTES:
            yield batch.slice(begin, at - begin)
            begin, total = at, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def load_tests(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list:
    """The benchmark as broadcast blocks of test suffixes.

    A benchmark is a stated query set; its size is counted first, and one of more than BLOCK_BYTES is cut by a hash of
    its items into blocks that are read and broadcast one after the other, each within that bound on average.  A worker
    holds one of them at a time (``alive``).
    """
    spark = benchmark.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    out = []
    for k in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == k)
        out.append(spark.sparkContext.broadcast(TestSuffixes.of([tuple(r.values()) for r in part.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toArrow().to_pylist()])))
    return out


def alive(tests: list) -> Iterator[TestSuffixes]:
    """The broadcast blocks, loaded one after the other; of several each is dropped before the next is loaded."""
    for test in tests:
        yield test.value
        if len(tests) > 1:
            vars(test).pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest
    verbatim match (longest_words, longest_start counted in words, longest_item).

    A narrow stage: documents are never shuffled.  Null or empty text has no words and is clean; items without words
    match nothing; an item id that is null is not listed; repeated rows and items count once for each row and id;
    either table may be empty; other columns are not read.
    """
    tests = load_tests(benchmark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _shards(batch, 1):
                found = judge_texts(part.column(1).to_pylist(), alive(tests))
                columns = pa.Table.from_pylist(found, schema=SUMMARY).combine_chunks().to_batches()[0].columns
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, *SUMMARY.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {COLUMNS}")


SUMMARY = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_words", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string())])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Null and empty texts stay; repeated rows and null ids are judged row for row; either table may be empty; other
    columns pass through under any name.
    """
    tests = load_tests(benchmark)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _shards(batch, column):
                found = judge_texts(part.column(column).to_pylist(), alive(tests))
                yield part.filter(pa.array([not f["contaminated"] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
