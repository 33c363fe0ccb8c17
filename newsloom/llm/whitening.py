"""Whitening of embeddings from exact integer moments.

Entries are put on a grid: x = floor(scale * entry).  The moments come from a bit-sliced scatter: a chunk's entries are
shifted to be non-negative, each dimension's bit planes are packed across rows into 64-bit words, and the cross-product
of two dimensions is the sum over their planes of 2^(a+b) times the number of ones in the AND of planes a and b.  Those
sums are whole numbers, so they are exact, and so is the centring (n * sum(x x') - S S'), whatever the order of rows and
tasks; the first rounding is the division before the eigenvectors are computed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.tables import fresh_dir

#: Rows of a chunk whose planes are made at once, tasks that add up the moments, and bits of a shifted entry up to which
#: 64-bit sums of a chunk can't overflow.
CHUNK_ROWS, ADDERS, NARROW_BITS = 16384, 32, 24
#: Part of the largest eigenvalue under which one counts as zero: its component can't be scaled to one.
ZERO = 1e-12


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """The exact sums and cross-products of the columns of a matrix of 64-bit integers, as Python integers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    shifted = x.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, so right for all 64-bit entries
    bits = np.array([int(m).bit_length() for m in shifted.max(axis=0)])
    planes, owner, place = [], [], []
    for a in range(int(bits.max(initial=0))):
        has = np.flatnonzero(bits > a)
        packed = np.packbits(((shifted[:, has] >> np.uint64(a)) & np.uint64(1)).astype(np.uint8), axis=0)
        words = np.zeros((len(has), -(-rows // 64) * 8), dtype=np.uint8)
        words[:, : packed.shape[0]] = packed.T
        planes.append(words.view(np.uint64))
        owner.append(has)
        place.append(np.full(len(has), a))
    sums, cross = np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
    if planes:
        plane, own, at = np.concatenate(planes), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(own, kind="stable")
        plane, own, at = plane[order], own[order], at[order]
        ones = np.zeros((len(plane), len(plane)), dtype=np.int64)
        for p in range(len(plane)):
            ones[p, p:] = ones[p:, p] = np.bitwise_count(plane[p:] & plane[p]).sum(axis=1, dtype=np.int64)
        present, first = np.unique(own, return_index=True)
        number = np.int64 if bits.max() <= NARROW_BITS else object
        weight = np.array([1 << int(a) for a in at], dtype=number)
        ones = ones.astype(number)
        sums[present] = np.add.reduceat(np.diagonal(ones) * weight, first).astype(object)
        cross[np.ix_(present, present)] = np.add.reduceat(np.add.reduceat(weight[:, None] * ones * weight, first, axis=0), first, axis=1).astype(object)
    base = low.astype(object)
    cross = cross + base[:, None] * sums + sums[:, None] * base + rows * (base[:, None] * base)
    return (sums + rows * base).tolist(), cross.tolist()


def add_moments(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    return {"n": a["n"] + b["n"], "s": [p + q for p, q in zip(a["s"], b["s"], strict=True)], "xx": [[p + q for p, q in zip(r, t, strict=True)] for r, t in zip(a["xx"], b["xx"], strict=True)]}


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n distinct vectors, their sums, unit components (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > ZERO * max(self.eigenvalues.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
        most = max((abs(s) for s in self.sums), default=0)
        wide = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + most
        kind = np.int64 if len(self.sums) * wide * wide < 1 << 63 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """The whitened components of rows; not a number where a component's eigenvalue is zero."""
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.eigenvalues, 1.0)), np.nan)
        return (centred / self.n).astype(np.float64) @ self.components / scale


def whitening_of(moments: dict, top: int) -> Whitening:
    """Centres the moments as integers, then takes the eigenvectors of the covariance (divisor n)."""
    n, s, dims = moments["n"], moments["s"], len(moments["s"])
    covariance = np.array([[(n * moments["xx"][i][j] - s[i] * s[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    return Whitening(n, s, vectors, np.maximum(values, 0.0), np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values)))


def on_grid(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and x (array of long) of the rows whose vector is not null or empty and holds only finite entries."""
    entries = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(entries.isNotNull() & (F.size(entries) > 0) & whole).select(F.col(f"`{id_col}`").alias("id"), F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[np.ndarray]:
    """The vectors of batches, CHUNK_ROWS at once."""
    held, n = [], 0
    for batch in batches:
        held.append(_matrix(batch.column(column), dims))
        n += len(held[-1])
        while n >= CHUNK_ROWS:
            rows = np.concatenate(held)
            yield np.ascontiguousarray(rows[:CHUNK_ROWS])
            held, n = [rows[CHUNK_ROWS:]], n - CHUNK_ROWS
    if n:
        yield np.ascontiguousarray(np.concatenate(held))


def _added(df: DataFrame, part: Callable[[np.ndarray], dict], add: Callable[[dict | None, dict], dict], dims: int) -> dict | None:
    """The sum of a figure over all chunks of x: one in each task, then in ADDERS tasks, the last few on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _chunks(batches, 0, dims):
            total = add(total, part(rows))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"figure": [json.dumps(total)]})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for figure in batch.column(0).to_pylist():
                total = add(total, json.loads(figure))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"figure": [json.dumps(total)]})

    total = None
    for row in df.select("x").mapInArrow(first, "figure string").repartition(ADDERS).mapInArrow(again, "figure string").collect():
        total = add(total, json.loads(row["figure"]))
    return total


def _add_products(a: dict | None, b: dict) -> dict:
    return b if a is None else {k: (np.array(a[k]) + np.array(b[k])).tolist() for k in b}


def identity_error(fit_list: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity (zero components left out)."""
    usable = np.flatnonzero(fitted.usable)
    if not len(usable):
        return 0.0

    def part(rows: np.ndarray) -> dict:
        z = fitted.project(fitted.centred(rows))[:, usable]
        return {"s": z.sum(axis=0).tolist(), "zz": (z.T @ z).tolist()}

    total = _added(fit_list, part, _add_products, len(fitted.sums))
    mean = np.array(total["s"]) / fitted.n
    return float(np.abs(np.array(total["zz"]) / fitted.n - np.outer(mean, mean) - np.eye(len(usable))).max())


def whiten(vectors: DataFrame, top: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row that stays and each of the first ``top`` components: id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    The transform is fitted on each distinct grid vector once (n of them, sums S), which is written to the shared folder
    and read again for the check.  deviation is the sum of (n * x - S)^2, exact; null beyond 64 bits.  whitened is
    (x - S/n) projected on the component, over the root of its eigenvalue; null where that is zero (vectors that don't
    vary in so many directions).  explained is the eigenvalue's part of the trace (0 if nothing varies).

    Rows go if their vector is null or empty or holds null or non-finite entries; also if its length is not the commonest
    among the distinct vectors (the shorter of equally common ones).  Entries beyond 64 bits on the grid take the nearest
    64-bit value.  Null and repeated ids stay, row for row.  A table without rows that stay gives none.  There are as
    many components as dimensions if those are fewer than ``top``.  Other columns are not read, so their names cannot
    clash.  The driver holds one covariance (dimensions squared), never vectors.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    grid = on_grid(vectors, id_col, vec_col, scale)
    folder = fresh_dir(spark, "whitening")
    grid.select("x").distinct().write.parquet(folder)
    fit_list = spark.read.parquet(folder)
    commonest = fit_list.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not commonest:
        return spark.createDataFrame([], schema)
    dims = commonest[0]["dims"]
    fit_list = fit_list.where(F.size("x") == dims)

    def moments(rows: np.ndarray) -> dict:
        sums, cross = scatter(rows)
        return {"n": len(rows), "s": sums, "xx": cross}

    fitted = whitening_of(_added(fit_list, moments, add_moments, dims), top)
    error, shown = identity_error(fit_list, fitted), len(fitted.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            centred = fitted.centred(_matrix(batch.column(1), dims))
            deviation = (centred * centred).sum(axis=1).tolist()
            z = fitted.project(centred)
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0).take(pa.array(np.repeat(np.arange(rows), shown))),
                "component": pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * shown, fitted.n, dtype=np.int64)),
                "deviation": pa.array([d if d < 1 << 63 else None for d in deviation for _ in range(shown)], pa.int64()),
                "whitened": pa.array(z.ravel(), mask=np.tile(~fitted.usable, rows)),
                "explained": pa.array(np.tile(fitted.explained, rows)),
                "identity_error": pa.array(np.full(rows * shown, error)),
            })

    return grid.where(F.size("x") == dims).mapInArrow(run, schema)
