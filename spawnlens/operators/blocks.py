"""Comparisons of queries with the points that they need, in blocks of bounded size of both sides.

Points lie in cells. A cell of many points fills blocks of its own, small cells share one. A query goes to each block that holds a cell it needs, once however
many of its cells are there, so that rows are sent as often as there are blocks (a sixteenth of the points each, 32,768 at most), not once for each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at least and at most, blocks that points are dealt in between these; rows and columns of a matrix of distances; squares below this share of
#: both norms are taken from differences; pairs whose differences are held at once, and those of a list; queries that are held against all drawn points at once.
LEAST, MOST, PARTS, ROWS, COLUMNS, CLOSE, PAIRS, LISTED, PROBED = 1024, 1 << 15, 16, 256, 1024, 1e-3, 1 << 14, 1 << 10, 64


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def deal(rows: list[int], side: int) -> tuple[list[int], list[int]]:
    """First block of each cell, and how many it fills."""
    first, count, top, shared, held = [], [], 0, -1, 0
    for n in rows:
        if n > side:
            first.append(top)
            count.append(-(-n // side))
            top += count[-1]
            continue
        if shared < 0 or held + n > side:
            shared, held, top = top, 0, top + 1
        first.append(shared)
        count.append(1)
        held += n
    return first, count


def side_of(rows: list[int]) -> int:
    return int(min(MOST, max(LEAST, sum(rows) // PARTS)))


def asks(need: np.ndarray, rows: list[int]) -> tuple[pa.Array, pa.Array]:
    """`blocks` (those that hold a cell which is needed) and `mask` (the cells, a bit for each) of queries that need the cells that are true."""
    first, count = deal(rows, side_of(rows))
    held = np.zeros((len(rows), max((f + n for f, n in zip(first, count, strict=True)), default=1)), np.float32)
    for c, (f, n) in enumerate(zip(first, count, strict=True)):
        held[c, f : f + n] = 1
    query, block = np.nonzero(need.astype(np.float32) @ held)
    ends = np.searchsorted(query, np.arange(len(need) + 1)).astype(np.int32)
    bits = np.packbits(need, axis=1)
    at = np.arange(len(need) + 1, dtype=np.int32) * bits.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(block, pa.int32())), pa.BinaryArray.from_buffers(pa.binary(), len(need), [None, pa.py_buffer(at), pa.py_buffer(bits)])


def compare(queries: DataFrame, points: DataFrame, key: Column, rows: list[int], step: Callable[[pa.Table, pa.Table], pa.Table], schema: str, empty: pa.Table, side: int | None = None) -> DataFrame:
    """What step(queries, points) finds in each pair of blocks. queries have `cells` (array<int>, those they need) or what asks() gives, points `cell`, of which `rows`
    has the number of points; key tells the rows of a side apart. empty is a table of the schema without rows. The step keeps to each query's cells (see `by_cell`, `by_need`)."""
    side = side or side_of(rows)
    first, count = deal(rows, side)
    of = lambda values, at: F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)
    told = "blocks" in queries.columns
    needed = F.col("blocks") if told else F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(of(first, c), of(first, c) + of(count, c) - 1))))
    asking = queries.withColumn("_n", F.explode(needed)).drop("blocks")
    asked = {r["_n"]: r["count"] for r in asking.groupBy("_n").count().collect()}  # a row for each block
    shares = [-(-asked.get(k, 0) // side) for k in range(max((f + n for f, n in zip(first, count, strict=True)), default=1))]
    left = asking.withColumn("_m", F.pmod(F.xxhash64(key), of(shares, F.col("_n"))).cast("int"))
    apart = points.select(*[F.col(c).alias(c) for c in points.columns])  # queries may be made of the same columns
    placed = apart.withColumn("_n", (of(first, F.col("cell")) + F.pmod(F.xxhash64(key), of(count, F.col("cell")))).cast("int"))
    right = placed.where(of(shares, F.col("_n")) > 0).withColumn("_m", F.explode(F.sequence(F.lit(0), of(shares, F.col("_n")) - 1)))
    found = lambda a, b: step(a, b) if a.num_rows and b.num_rows else empty
    return left.groupBy("_n", "_m").cogroup(right.groupBy("_n", "_m")).applyInArrow(found, schema)


def by_cell(a: pa.Table, b: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each cell of a block of points with the rows of the queries that need it, rising, and its points' rows."""
    lists = a.column("cells").combine_chunks()
    cells, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    held = np.asarray(b.column("cell"))
    for c in np.unique(held).tolist():
        rows = owner[cells == c]
        if len(rows):
            yield c, rows, np.flatnonzero(held == c)


def by_need(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the queries and of the points to hold against them, by their `mask`: those that need all cells of the block against all of it, others cell by cell."""
    bits = np.unpackbits(np.frombuffer(b"".join(a.column("mask").to_pylist()), np.uint8).reshape(a.num_rows, -1), axis=1)
    held = np.asarray(b.column("cell"))
    cells = np.unique(held)
    need = bits[:, cells].astype(bool)
    whole = need.all(axis=1)
    if whole.any():
        yield np.flatnonzero(whole), np.arange(len(held))
    for c, rows in zip(cells.tolist(), (need & ~whole[:, None]).T, strict=True):
        if rows.any():
            yield np.flatnonzero(rows), np.flatnonzero(held == c)


def squares(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two matrices whose product is the squared distances of p and q, about the middle of q, and the sum of norms that its rounding goes by for each row of p."""
    mid = q.mean(axis=0)
    p, q = p - mid, q - mid
    m, n = (p * p).sum(axis=1), (q * q).sum(axis=1)
    left, right = np.concatenate([-2 * p, m[:, None], np.ones((len(p), 1))], axis=1), np.concatenate([q, np.ones((len(q), 1)), n[:, None]], axis=1)
    return left, np.ascontiguousarray(right.T), m + n.max(initial=0.0)


def rough_squares(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As squares, in single precision and in a unit that is given last, with the most that each row's are wrong by: to tell which pairs to take the distance of."""
    mid = q.mean(axis=0)
    unit = float(max(((p - mid) ** 2).sum(axis=1).max(initial=0.0), ((q - mid) ** 2).sum(axis=1).max(initial=0.0))) or 1.0
    left, right, norms = squares((p - mid) / np.sqrt(unit), (q - mid) / np.sqrt(unit))
    return left.astype(np.float32), right.astype(np.float32), 8 * (p.shape[1] + 8) * float(np.finfo(np.float32).eps) * norms + 1e-36, unit


def pair_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of row to row, component after component."""
    d = np.zeros(len(p))
    for s in range(0, len(p), PAIRS):
        for c in np.ascontiguousarray((p[s : s + PAIRS] - q[s : s + PAIRS]).T):
            d[s : s + PAIRS] += c**2
    return np.sqrt(d)


def listed_distances(p: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
    """pair_distances of p[i] and q[j], which are taken out few at a time."""
    return np.concatenate([pair_distances(p[i[s : s + LISTED]], q[j[s : s + LISTED]]) for s in range(0, len(i), LISTED)] or [np.zeros(0)])


def set_places(found: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a contiguous array of truth values of which few are set: eight are looked at at once."""
    flat = found.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def nearest_within(p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each row of p the square of a distance that k + 1 rows of q lie within; infinite if q has fewer. Of the rows of q, those of a place in eight parts
    count as the nearest of them, where these are enough."""
    out = np.full(len(p), np.inf)
    parts = 8 if len(q) >= 64 * (k + 1) else 1
    q = q[: len(q) // parts * parts]
    if len(q) <= k:
        return out
    left, right, wrong, unit = rough_squares(p, q)
    for s in range(0, len(p), PROBED):
        d = (left[s : s + PROBED] @ right).reshape(-1, parts, len(q) // parts).min(axis=1)
        d.partition(k, axis=1)
        out[s : s + PROBED] = (d[:, k] + wrong[s : s + PROBED]) * unit * (1 + 1e-6)
    out[np.isnan(out)] = np.inf
    return out


class Nearest:
    """The k nearest points of each of `rows` queries among the pairs that are told. Pairs are told with bounds on their squares and measured when many are held,
    those only that the bounds leave open; `bound` falls with what is known."""

    def __init__(self, bound: np.ndarray, k: int, ids: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.bound, self.k, self.ids, self.measure = bound, k, ids, measure
        self.most, self.held, self.told = max(1 << 20, 4 * k * len(bound)), 0, []
        self.row, self.place, self.near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def tell(self, row: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.told.append((row, place, low, high))
        self.held += len(row)
        if self.held > self.most:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        row, place, low, high = (np.concatenate(v) for v in zip(*self.told, strict=True))
        self.told, self.held = [], 0
        if len(row) > 2 * self.k * len(self.bound):
            order = np.argsort(row << 32 | high.astype(np.float32).view(np.uint32))  # bits of floats that are not negative rise with them
            r = row[order]
            at = np.arange(len(r)) - np.searchsorted(r, r)
            first = np.flatnonzero(at == self.k - 1) - (self.k - 1)
            most = high[order[first[:, None] + np.arange(self.k)]].max(axis=1, initial=0.0)
            self.bound[r[first]] = np.minimum(self.bound[r[first]], most)
        open_ = low <= self.bound[row]
        row, place = row[open_], place[open_]
        r, p = np.concatenate([self.row, row]), np.concatenate([self.place, place])
        d = np.concatenate([self.near, self.measure(row, place)])
        order = np.lexsort((self.ids[p], d, r))
        r, p, d = r[order], p[order], d[order]
        at = np.arange(len(r)) - np.searchsorted(r, r)
        last = at == self.k - 1
        self.bound[r[last]] = np.minimum(self.bound[r[last]], d[last] ** 2 * (1 + 1e-12))
        self.row, self.place, self.near = r[at < self.k], p[at < self.k], d[at < self.k]


def distance_sums(p: np.ndarray, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of each p's weighted distances to q. Distances come from a product of matrices; those so short that it loses digits come from differences, so that
    equal rows have none."""
    left, right, norms = squares(p, q)
    out = np.zeros(len(p))
    for s in range(0, len(p), ROWS):
        for t in range(0, len(q), COLUMNS):
            d = left[s : s + ROWS] @ right[:, t : t + COLUMNS]
            least = CLOSE * norms[s : s + ROWS]
            low = np.flatnonzero(d.min(axis=1) <= least)
            i, j = np.nonzero(d[low] <= least[low, None])
            with np.errstate(invalid="ignore"):
                np.sqrt(d, out=d)
            for k in range(0, len(i), PAIRS):
                r, c = low[i[k : k + PAIRS]], j[k : k + PAIRS]
                d[r, c] = np.sqrt(((p[s + r] - q[t + c]) ** 2).sum(axis=1))
            out[s : s + ROWS] += d @ weight[t : t + COLUMNS]
    return out
