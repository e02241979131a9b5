"""Exact top-k search by distributed histogram selection.

Queries are taken in slices of bounded size. For a slice, every candidate is scored against every query; the scores are not kept but counted in
histograms, and each round narrows, for every query, the range in which its kth highest score lies, until the range is one score wide.
A last pass keeps scores above that value and, of the ties at it, the smallest ids. Tasks add up their own counts first and leave out bins
that cannot hold a kth score, so what is shuffled is at most about k rows for each query and task, however many vectors tie.

Results for odd input: vectors that are null, or hold null or non-finite components, and rows with a null id take no part; vectors of
different lengths have no score with one another; scores that do not fit in 64 bits are an error; an empty vector scores 0 with other empty ones. Repeated candidate rows are ranked each. If a
query id is repeated, its first row by vector counts. A candidate with the query's own id is left out. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Bytes of query vectors that one pass over the candidates serves; bins of a histogram at most; bytes of a task's histograms of all queries, if
#: these have LEAST bins; candidates and queries scored at once.
SLICE_BYTES, BINS, HISTOGRAM_BYTES, LEAST, ROWS, QUERIES = 8 << 20, 4096, 64 << 20, 64, 2048, 512
NONE = np.iinfo(np.int64).min


def integer_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each vector length, components floor(scale * x); rows that take no part are left out."""
    lists = vectors.cast(pa.list_(pa.float64()))
    ok = ~(np.asarray(ids.is_null()) | np.asarray(lists.is_null()))
    off = np.asarray(lists.offsets, dtype=np.int64)
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok &= (bad[off[1:]] - bad[off[:-1]]) == 0
    sizes = off[1:] - off[:-1]
    for d in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == d))
        got = np.floor(scale * flat[(off[rows][:, None] + np.arange(d)[None, :])]) if d else np.zeros((len(rows), 0))
        yield np.asarray(ids.take(pa.array(rows)).to_numpy(zero_copy_only=False), dtype=np.int64), got


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, in doubles while they are exact, else in Python integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T


class Slice:
    """Queries of one slice: by vector length, ids and matrices, and where each stands in the slice's state."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.parts = []
        for d in sorted({len(v) for v in vectors}):
            at = np.array([k for k, v in enumerate(vectors) if len(v) == d])
            for i in range(0, len(at), QUERIES):
                self.parts.append((d, at[i : i + QUERIES], np.array([vectors[k] for k in at[i : i + QUERIES]]).reshape(len(at[i : i + QUERIES]), d)))

    def scored(self, batches, scale) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, candidates' ids, scores with NONE where a candidate is the query itself)."""
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                for ids, matrix in integer_vectors(part.column(0), part.column(1), scale):
                    for d, at, queries in self.parts:
                        if d == matrix.shape[1]:
                            scores = products(queries, matrix)
                            scores[self.ids[at][:, None] == ids[None, :]] = NONE
                            yield at, ids, scores.astype(np.int64)


def slices(queries: DataFrame, id_col: str, vec_col: str, scale: float) -> Iterator[Slice]:
    """The query set in slices of at most SLICE_BYTES; only one is on the driver at a time."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    size, last = 0, None
    rows = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).orderBy(id_col, vec_col)
    for vec_id, v in rows.toLocalIterator():
        if vec_id == last or any(x is None for x in v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if not np.isfinite(x).all():
            continue
        last = vec_id
        ids.append(vec_id)
        vectors.append(np.floor(scale * x))
        size += 8 * (len(v) + 4)
        if size >= SLICE_BYTES:
            yield Slice(np.array(ids, dtype=np.int64), vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield Slice(np.array(ids, dtype=np.int64), vectors)


def _range(found: DataFrame, sl: Slice, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest and highest score and number of candidates of each query."""
    sent = found.sparkSession.sparkContext.broadcast(sl)

    def run(batches):
        s = sent.value
        n, lo, hi = np.zeros(len(s.ids), np.int64), np.full(len(s.ids), np.iinfo(np.int64).max), np.full(len(s.ids), NONE)
        for at, _, scores in s.scored(batches, scale):
            there = scores != NONE
            n[at] += there.sum(1)
            lo[at] = np.minimum(lo[at], np.where(there, scores, np.iinfo(np.int64).max).min(1))
            hi[at] = np.maximum(hi[at], scores.max(1))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(lo[at]), pa.array(hi[at])], names=["q", "n", "lo", "hi"])

    rows = found.mapInArrow(tidy(run), "q long, n long, lo long, hi long").groupBy("q").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    n, lo, hi = np.zeros(len(sl.ids), np.int64), np.zeros(len(sl.ids), np.int64), np.zeros(len(sl.ids), np.int64)
    at = np.asarray(rows["q"])
    n[at], lo[at], hi[at] = np.asarray(rows["n"]), np.asarray(rows["lo"]), np.asarray(rows["hi"])
    return n, lo, hi


def bins_of(queries: int) -> int:
    """Bins of each query's histogram."""
    return max(LEAST, min(BINS, HISTOGRAM_BYTES // (8 * max(1, queries))))


def _narrow(found: DataFrame, sl: Slice, scale: float, lo, width, need, bins_at_once: int) -> DataFrame:
    """Each query's bin of width scores from lo in which its need-th highest lies, the last bin being all above; a task leaves its bins below its own need-th out."""
    sent = found.sparkSession.sparkContext.broadcast((sl, lo, width, need))

    def run(batches):
        s, lo, width, need = sent.value
        counts: dict[int, np.ndarray] = {}
        for at, _, scores in s.scored(batches, scale):
            bins = np.where(scores < lo[at][:, None], -1, np.minimum((scores - lo[at][:, None]) // width[at][:, None], bins_at_once))
            for k, q in enumerate(at):
                if need[q]:
                    got = np.bincount(bins[k][bins[k] >= 0], minlength=bins_at_once + 1)
                    counts[q] = counts[q] + got if q in counts else got
        out: list[list[int]] = [[], [], [], []]
        for q, c in counts.items():
            above = np.cumsum(c[::-1])[::-1] - c
            at = np.flatnonzero((c > 0) & (above < need[q]))
            out[0] += [q] * len(at)
            out[1] += at.tolist()
            out[2] += c[at].tolist()
            out[3] += [int(need[q])] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["q", "bin", "n", "need"])

    # Dealt by query once, for the sums and for the running sums over them.
    counted = found.mapInArrow(tidy(run), "q long, bin long, n long, need long").repartition("q").groupBy("q", "bin", "need").agg(F.sum("n").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc())))
    return upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("q", "bin")


def _select(found: DataFrame, sl: Slice, scale: float, kth, k: int) -> DataFrame:
    """Of each task: scores of at least the kth, at most k of a query, ties to smaller ids."""
    sent = found.sparkSession.sparkContext.broadcast((sl, kth))

    def run(batches):
        s, kth = sent.value
        best: dict[int, list[tuple[int, int]]] = {}
        for at, ids, scores in s.scored(batches, scale):
            for r, q in enumerate(at):
                here = np.flatnonzero((scores[r] >= kth[q]) & (scores[r] != NONE))
                if len(here):
                    here = here[np.lexsort((ids[here], -scores[r][here]))[:k]]
                    best[q] = sorted(best.get(q, []) + list(zip((-scores[r][here]).tolist(), ids[here].tolist(), strict=True)))[:k]
        rows = [(int(s.ids[q]), v, -x) for q, got in best.items() for x, v in got]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return found.mapInArrow(tidy(run), "query_id long, vec_id long, score long")


def search(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), ties to the smaller id."""
    bounded_batches(candidates.sparkSession)
    found = candidates.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    parts = []
    for sl in slices(queries, id_col, vec_col, scale):
        n, lo, hi = _range(found, sl, scale)
        need = np.minimum(n, k)
        bins = bins_of(len(sl.ids))
        width = np.maximum(1, -(-(hi - lo + 1) // bins))
        while True:
            rows = _narrow(found, sl, scale, lo, width, need, bins).toArrow()  # a row for each query of the slice
            q, b = (np.asarray(rows[x]) for x in ("q", "bin"))
            lo[q] += b * width[q]
            hi[q] = lo[q] + width[q] - 1
            if (width == 1).all():
                break
            width = np.maximum(1, -(-(hi - lo + 1) // bins))
        parts.append(_select(found, sl, scale, lo, k))
    if not parts:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return ranked(got, k)


def ranked(got: DataFrame, k: int) -> DataFrame:
    place: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return got.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
