"""Whitening against NumPy's eigenvalues and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spawnlens.llm import queries, whitening
from spawnlens.llm.common import materialise, table


def rows_by_hand(vectors, scale=256, k=4):
    """vec_id, vector pairs -> n, sums, eigenvalues, deviations and absolute whitened values by plain arithmetic."""
    kept = [(i, tuple(math.floor(scale * float(c)) for c in v)) for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array(fit, float) - np.array([t / n for t in s])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        dev = sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
        w = [(np.array(x) - np.array([t / n for t in s])) @ u[:, c] / math.sqrt(e[c]) if e[c] > 1e-9 * e[0] else 0.0 for c in range(min(k, d))]
        out.setdefault(i, []).append((n, dev, w))
    return out, e / e.sum()


def test_query_equals_plain_arithmetic(spark, sf_dir):
    got = queries.op13_whitening(spark, sf_dir).collect()
    stored = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    want, share = rows_by_hand(stored)
    assert len(got) == 4 * sum(map(len, want.values()))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    signs = {}
    for r in got:
        n, dev, w = want[r["vec_id"]][0]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, dev)
        assert r["explained"] == pytest.approx(share[c], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(w[c]), abs=1e-7)
        if abs(w[c]) > 1e-3:
            signs.setdefault(c, set()).add(math.copysign(1, w[c] * r["whitened"]))
    assert all(len(x) == 1 for x in signs.values())  # one sign for all rows


def test_jacobi_finds_small_eigenvalues():
    # Graded matrices are where rotations keep what reductions to three diagonals lose.
    d = np.array([1.0, 1e-5, 1e-10, 1e-15])
    b = np.array([[1, 0.3, 0.2, 0.1], [0.3, 1, 0.3, 0.2], [0.2, 0.3, 1, 0.3], [0.1, 0.2, 0.3, 1]])
    a = d[:, None] * b * d[None, :]
    values, vectors = whitening.jacobi(a)
    # The product of the eigenvalues is the determinant, which is exact by the scaling.
    assert np.prod(values / np.array([1.0, 1e-10, 1e-20, 1e-30])) == pytest.approx(np.linalg.det(b), rel=1e-10)
    assert np.all(values > 0) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    for m in (np.diag([3.0, 3.0, 1.0]), np.zeros((2, 2)), np.array([[5.0]]), np.ones((4, 4))):
        values, vectors = whitening.jacobi(m)
        assert np.allclose(vectors * values @ vectors.T, m, atol=1e-12) and np.all(np.diff(values) <= 1e-12)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [3.0, 1.0, 0.0]), (2, [0.5, -1.0, 0.0]), (3, [1.0, 2.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 2.0]),
            (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 0.0, 1.0]), (9, [1.0, 2.0]), (10, [0.0, 1.0]), (11, [-0.0, -0.001, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y", 3) for i, v in rows], "vec_id long, embedding array<double>, x string, component string, n int")
    got = whitening.whiten(df, materialise).collect()
    three = [r for r in got if r["vec_id"] not in (9, 10)]
    want, share = rows_by_hand([r for r in rows if r[1] is None or len(r[1]) != 2])
    assert len(three) == 3 * 6 and {r["n"] for r in three} == {4}
    for r in three:
        n, dev, w = want[r["vec_id"]][0]
        assert int(r["deviation"]) == dev and abs(r["whitened"]) == pytest.approx(abs(w[r["component"] - 1]), abs=1e-9)
    assert all(r["whitened"] == 0 and r["explained"] == pytest.approx(0, abs=1e-12) for r in three if r["component"] == 3)  # a constant dimension
    two = [r for r in got if r["vec_id"] in (9, 10)]
    assert len(two) == 4 and {r["n"] for r in two} == {2}
    assert whitening.whiten(df.where(F.lit(False)), materialise).collect() == []
    assert whitening.whiten(df.where("vec_id IN (4, 5, 6, 7, 8)"), materialise).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(k, [float(k * 10**6), -float(k), 1e300 if k == 3 else 0.0]) for k in range(1, 9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), materialise).collect()
    x = {i: [min(2**31, math.floor(256 * c)) for c in v] for i, v in rows}
    s = [sum(v[j] for v in x.values()) for j in range(3)]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, sum((8 * c - t) ** 2 for c, t in zip(v, s, strict=True))) for i, v in x.items()}
