"""Whitening of embeddings by cyclic Jacobi rotations.

Vectors become whole numbers, floor(scale * c). The fit list is each distinct vector once. One pass sums it by dimension, a second sums the products of
the centred vectors: each task adds up the matrix of its own rows, and the matrices are added by entry on the cluster. The driver holds
the d x d matrix only, and turns it by Jacobi rotations, row by row over all pairs of dimensions, until no entry beside the diagonal is left
that changes the diagonal in double precision; this keeps small eigenvalues accurate. Eigenvalues are sorted, and the whitening matrix, d x k, is
broadcast to the scoring of all vectors. A third pass measures the whitened fit list's covariance.

Results for odd input: vectors that are null, empty, or hold null or non-finite entries are left out. Entries beyond 2^31 after scaling count as 2^31,
since a squared deviation of such would not be a number of 64 bits. Vectors of different lengths are fitted apart, each length by its own list, so
`n` is the list's of that length; lengths are a few properties of the models that made the vectors, and are listed on the driver. Repeated
rows are put out each, with their own id, null ids included, and stand in the fit list once. Directions without variance (constant dimensions, fewer vectors than dimensions)
are whitened to 0 and left out of identity_error. Eigenvectors have their largest entry positive. Other columns are not
read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, tidy

SCALE, COMPONENTS = 256, 4
#: Largest absolute value of a scaled entry; most rotations of each pair; least eigenvalue, of the largest, that counts as variance.
LARGEST, SWEEPS, VARIANCE = 2**31, 60, 1e-13


def scaled(vector: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * c) for each entry, as longs within LARGEST."""
    return F.transform(vector, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))).cast("long"))


def usable(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))


def rows_of(vectors: pa.Array) -> np.ndarray:
    """A matrix of the vectors of a batch, all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors of the fit list, and their exact sums by dimension."""
    each = [F.sum(F.col("x")[k].cast("decimal(20,0)")).alias(f"s{k}") for k in range(d)]
    found = fit.agg(F.count("*").alias("n"), *each).first()
    return found["n"], [int(found[f"s{k}"] or 0) for k in range(d)]


def _products(fit: DataFrame, d: int, centred: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """The sum over the fit list of the products of the k columns that centred() gives, a symmetric k x k matrix."""
    bounded_batches(fit.sparkSession)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = centred(rows_of(batch.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    rows = fit.select("x").mapInArrow(tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns, of a symmetric matrix, by cyclic Jacobi rotations.

    Each rotation makes one entry beside the diagonal vanish. An entry that is too small to change either of its diagonal entries is set to 0; it
    ends when all are. Rows and columns are turned together, and the diagonal is changed by the tangent of the angle, not recomputed.
    """
    a = np.array(matrix, float)
    d = len(a)
    v = np.eye(d)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                x = a[p, q]
                if x == 0.0:
                    continue
                if abs(x) <= 1e-17 * np.sqrt(abs(a[p, p]) * abs(a[q, q])):
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2.0 * x)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1.0 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * x, a[q, q] + t * x
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                vp = v[:, p].copy()
                v[:, p] = c * vp - s * v[:, q]
                v[:, q] = s * vp + c * v[:, q]
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values, v / np.linalg.norm(v, axis=0)


class Whitening:
    """What a fit list says: its size and sums, eigenvalues and eigenvectors of its covariance, and the error of the first `k` whitened components."""

    def __init__(self, n: int, sum_: list[int], values: np.ndarray, vectors: np.ndarray, k: int):
        self.n, self.sum, self.values, self.vectors, self.k = n, sum_, values, vectors, min(k, len(values))
        self.mean = np.array([s / n for s in sum_])
        self.error = 0.0
        e = values[: self.k]
        self.varies = e > VARIANCE * max(float(values[0]), 0.0)
        #: d x k: centred vectors times this are whitened.
        self.matrix = vectors[:, : self.k] * np.where(self.varies, 1.0 / np.sqrt(np.where(self.varies, e, 1.0)), 0.0)
        trace = float(np.sum(np.maximum(values, 0.0)))
        self.explained = [float(x) / trace if trace > 0 else 0.0 for x in np.maximum(e, 0.0)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum)^2, exact: in 64 bits where all sums fit, else by whole numbers of any size."""
        most = 2 * self.n * max(int(np.abs(x).max()), max(abs(s) for s in self.sum) // self.n + 1)
        if most < 2**31 and len(self.sum) * most**2 < 2**63:
            y = self.n * x.astype(np.int64) - np.array(self.sum, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        y = self.n * x.astype(object) - np.array(self.sum, object)
        return [int(r) for r in (y * y).sum(axis=1)]


def fit(vectors: DataFrame, d: int, k: int = COMPONENTS) -> Whitening:
    """Fits a list of distinct vectors, column x array<long>, all of length d. It is read three times."""
    n, total = sums(vectors, d)
    mean = np.array([s / n for s in total])
    values, turned = jacobi(_products(vectors, d, lambda x: x - mean, d) / n)
    found = Whitening(n, total, values, turned, k)
    cov = _products(vectors, d, found.whitened, found.k) / n
    varying = np.flatnonzero(found.varies)
    found.error = float(np.abs(cov[np.ix_(varying, varying)] - np.eye(len(varying))).max()) if len(varying) else 0.0
    return found


def whiten(vectors: DataFrame, materialise: Callable[[DataFrame, str], DataFrame], id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component up to k: id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    id_type = vectors.schema[id_col].dataType
    x = vectors.where(usable(vector_col)).select(F.col(id_col).alias("_id"), scaled(vector_col, scale).alias("x"))
    distinct = materialise(x.select("x").distinct(), "whitening-fit")
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for row in distinct.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():
        d = row["d"]
        of_length = lambda df, d=d: df.where(F.size("x") == d)
        out = out.unionByName(_applied(of_length(x), fit(of_length(distinct), d, k), schema))
    return out


def _applied(x: DataFrame, found: Whitening, schema: T.StructType) -> DataFrame:
    sent = x.sparkSession.sparkContext.broadcast(found)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        component = np.arange(1, w.k + 1, dtype=np.int32)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            rows = rows_of(batch.column(1))
            # A null for what 38 digits do not hold.
            deviation = pa.array([v if v < 10**38 else None for v in w.deviations(rows)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), w.k))
            columns = [batch.column(0).take(each), pa.array(np.tile(component, m)), pa.array(np.full(m * w.k, w.n)), deviation.take(each), pa.array(w.whitened(rows).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * w.k, w.error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return x.mapInArrow(tidy(run), schema)
