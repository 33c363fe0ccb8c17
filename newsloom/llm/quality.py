"""Quality rules: statistics of whole texts, fixed base rules, and an isolation forest over the statistics.

The forest (Liu et al., 2008) is fitted on the statistics of a bounded sample of the labelled rows that are marked
good; its score is high where random splits set a document apart early.  The threshold comes from labelled rows that
the forest has not seen: the least score that at most MAX_GOOD_LOSS of their good ones pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may take (both classes together), trees, rows of each tree, and the largest share of
#: good labelled rows that the threshold may reject.
SAMPLE_ROWS, TREES, TREE_ROWS, MAX_GOOD_LOSS = 8192, 100, 256, 0.002
MIN_WORDS = 50

BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?:;\"'()[]{}/\\=+-_@^~`"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that the forest sees; all are free of the text's length.
FEATURES = ["symbols_per_word", "repeat_share", "distinct_share", "chars_per_word", "upper_share", "digit_share", "mark_share", "dup_line_share", "top_word_share"]


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, end = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the ratios of FEATURES of one whole text; null is a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at exactly these six blanks
    n = len(words)
    if not n:
        return [0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    size = len(data)
    without = lambda drop: size - len(data.translate(None, drop))
    chars, symbols = len(text) - without(BLANKS), without(SYMBOLS)
    lines, dup, seen = 0, 0, set()
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line.strip(BLANKS):
                lines += 1
                dup += line in seen
                seen.add(line)
    else:
        lines = 1
    repeats = repeat_words(words)
    distinct = Counter(words)
    top = max(distinct.values())
    # the share of distinct words falls with the length of any prose; scaled to a common length (Heaps' law)
    features = [symbols / n, repeats / n, min(1.0, len(distinct) / n ** 0.9), chars / n, without(UPPER) / chars, without(DIGITS) / chars, without(MARKS) / chars, dup / lines, top / n]
    return [n, chars, symbols, dup, repeats], features


def base_failed(counts: list[int]) -> bool:
    """The fixed rules: too few words, or more than half of them in repeated 3-word windows."""
    return counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]


@dataclass
class Forest:
    """Isolation trees as arrays (column, split, left child; leaves have column -1 and their path length as split)."""

    column: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = float("inf")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1) of the rows of x."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                column = self.column[node]
                inner = column >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(column, 0)] < self.split[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            total += self.split[node]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def fit_forest(good: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Random isolation trees over samples of ``good``; a split goes past the sample's range at either end, so that
    values which no good row has are set apart too."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(good))
    deepest = int(np.ceil(np.log2(max(rows, 2)))) + 1
    column, split, left, right, roots = [], [], [], [], []
    low, high = good.min(axis=0), good.max(axis=0)
    margin = np.maximum(high - low, 0.2)

    def grow(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        node = len(column)
        column.append(-1)
        split.append(depth + _mean_path(len(x)))
        left.append(node)
        right.append(node)
        if depth >= deepest or len(x) <= 1:
            return node
        c = int(rng.integers(x.shape[1]))
        at = rng.uniform(lo[c], hi[c])
        column[node], split[node] = c, at
        below = x[:, c] < at
        hi_left, lo_right = hi.copy(), lo.copy()
        hi_left[c] = lo_right[c] = at
        left[node] = grow(x[below], lo, hi_left, depth + 1)
        right[node] = grow(x[~below], lo_right, hi, depth + 1)
        return node

    for _ in range(trees):
        roots.append(grow(good[rng.choice(len(good), rows, replace=False)], low - margin, high + margin, 0))
    return Forest(np.array(column), np.array(split), np.array(left), np.array(right), np.array(roots), max(_mean_path(rows), 1.0))


def calibrate(good: np.ndarray, bad: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The least score at which at most the given share of good rows is rejected, moved up into the gap towards the
    next bad row; without bad rows nothing is rejected."""
    if not len(bad):
        return float("inf")
    floor = np.quantile(good, 1.0 - max_good_loss, method="higher") if len(good) else 0.0
    above = bad[bad > floor]
    return float((floor + above.min()) / 2) if len(above) else float("inf")


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """Fit the forest and its threshold on at most ``sample_rows`` labelled rows, drawn by a hash of their ids.

    The forest grows on one half of the sample and the threshold is taken from the other; only where a half has no good
    row do both use all of them.  Only the sample's statistics reach the driver.  Labels with a null id or quality are
    left out; an id labelled twice with different values counts as bad; of documents that share an id the first rows
    count, up to the bound.  None if there is no good labelled row.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, *measure(t)) for q, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            found = [(q, f) for q, counts, f in found if not base_failed(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.float64()))], names=["q", "f"])

    # the bound holds for rows, too: repeated ids cannot pass it; the order makes the choice the same in every run
    rows = texts.select("_text", F.col("_quality").cast("long")).mapInArrow(stats, "q long, f array<double>").orderBy(F.xxhash64("q", "f"), "q", "f").limit(sample_rows).toArrow()
    good = np.array(rows.column("q").to_pylist()) > 0
    x = np.array(rows.column("f").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    if not good.any():
        return None
    fit, held = halves(good)
    forest = fit_forest(x[fit & good])
    scores = forest.scores(x)
    forest.threshold = calibrate(scores[held & good], scores[held & ~good])
    return forest


def halves(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the rows to fit on and of those to calibrate on: every second row of each class in the given order, or
    all rows for both if there are too few good ones."""
    second = np.zeros(len(good), dtype=bool)
    for own in (good, ~good):
        second[np.flatnonzero(own)[1::2]] = True
    if not (second & good).any():
        return np.ones(len(good), dtype=bool), np.ones(len(good), dtype=bool)
    return ~second, second


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 512) -> DataFrame:
    """One row for each row of ``docs``: id, the counts, base_failed, kept, anomaly (the forest's score).

    A narrow stage: no shuffle.  kept is false where the base rules fail, else true up to the forest's threshold.
    Null or empty text has no words and fails the base; ids may be null or repeat (row for row); an empty table gives
    no rows; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                counts, failed, scores, kept = _verdicts(part.column(1).to_pylist(), forest)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(failed), pa.array(kept, pa.bool_()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *COUNTS, "base_failed", "kept", "anomaly"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, forest: Forest | None, text_col: str = "text", rows_at_once: int = 512) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Null and empty texts fail the base and go; repeated rows and null ids are judged row for row; an empty table gives
    no rows; other columns pass through under any name.
    """
    at_col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                kept = _verdicts(part.column(at_col).to_pylist(), forest)[3]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _verdicts(texts: list, forest: Forest | None) -> tuple[list, list[bool], list[float | None], list[bool]]:
    found = [measure(t) for t in texts]
    counts = [c for c, _ in found]
    failed = [base_failed(c) for c in counts]
    if forest is None or not found:
        return counts, failed, [None] * len(found), [not f for f in failed]
    scores = forest.scores(np.array([f for _, f in found]))
    return counts, failed, scores.tolist(), [bool(not f and s <= forest.threshold) for f, s in zip(failed, scores, strict=True)]
