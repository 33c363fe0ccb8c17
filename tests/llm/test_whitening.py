"""Bit-sliced moments against plain sums, and the operator against exact fractions."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import queries, whitening


def plain_moments(rows):
    cols = list(zip(*rows, strict=True))
    return [sum(c) for c in cols], [[sum(a * b for a, b in zip(p, q, strict=True)) for q in cols] for p in cols]


@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.one_of(st.integers(-40, 40), st.integers(-(2**63), 2**63 - 1)), min_size=d, max_size=d), min_size=1, max_size=150)))
@settings(max_examples=150, deadline=None)
def test_scatter_is_exact(rows):
    assert whitening.scatter(np.array(rows, dtype=np.int64)) == plain_moments(rows)


@pytest.mark.parametrize("bits", [1, 9, 24, 25, 40])
def test_scatter_of_many_rows(bits):
    rows = np.random.default_rng(bits).integers(-(1 << bits) // 2, (1 << bits) // 2, (whitening.CHUNK_ROWS, 3))
    rows[:, 2] = 7  # a dimension that doesn't vary
    assert whitening.scatter(rows) == plain_moments(rows.tolist())


def expected(rows, top=4):
    """(id, exact deviation) of each row that stays, n, sums, and the covariance's eigenvalues and vectors."""
    grid = [(i, tuple(min(max(math.floor(256 * c) if abs(256 * c) < 1e30 else int(math.copysign(1e30, c)), -(2**63)), 2**63 - 1) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(x) for x in {x for _, x in grid})
    dims = min(sizes, key=lambda d: (-sizes[d], d))
    grid = [(i, x) for i, x in grid if len(x) == dims]
    fit = {x for _, x in grid}
    n, (s, xx) = len(fit), plain_moments(list(fit))
    cov = np.array([[(n * xx[i][j] - s[i] * s[j]) / n**2 for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    return [(i, x, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in grid], n, s, values[::-1][:top], vectors[:, ::-1][:, :top], np.trace(cov)


def check(got, rows, top=4):
    want, n, s, values, vectors, trace = expected(rows, top)
    shown = len(values)
    assert len(got) == shown * len(want)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    for i, x, deviation in want:
        for k in range(shown):
            found = [r for r in by_id[i] if r["component"] == k + 1]
            assert found and all(r["n"] == n and r["explained"] == pytest.approx(values[k] / trace, rel=1e-9) and r["identity_error"] < 1e-9 for r in found)
            z = abs(sum((a - b / n) * v for a, b, v in zip(x, s, vectors[:, k], strict=True))) / math.sqrt(values[k])
            assert any(r["deviation"] == deviation and abs(r["whitened"]) == pytest.approx(z, rel=1e-6, abs=1e-7) for r in found)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


def test_odd_rows(spark):
    """Null, empty, non-finite and shorter vectors go; null and repeated ids and repeated vectors stay; columns may clash."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    rows += [(None, rows[0][1]), (3, rows[0][1]), (50, None), (51, []), (52, [1.0] * 5 + [None]), (53, [float("nan")] + [1.0] * 5), (54, [float("-inf")] + [1.0] * 5), (55, [1.0, 2.0]), (56, [-0.0] * 6), (57, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, x int, n int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(whitening.whiten(df.repartition(5)).collect(), rows)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("embedding IS NULL")).collect() == []


def test_directions_that_do_not_vary(spark):
    """A null where the eigenvalue is zero; fewer components than four in two dimensions; a single vector."""
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert len(got) == 30 and all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in got)
    one = whitening.whiten(line.limit(1)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 3
    assert whitening.whiten(line.selectExpr("vec_id", "slice(embedding, 1, 2) AS embedding")).count() == 20


def test_entries_beyond_64_bits(spark):
    """They take the nearest 64-bit value; a deviation that doesn't fit is null."""
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert len(got) == 6 and got[1, 1]["deviation"] is None
    small = sum((3 * a - b) ** 2 for a, b in zip((0, 128), (-1, 384), strict=True))
    assert got[3, 1]["deviation"] == small
