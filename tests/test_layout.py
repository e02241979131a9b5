"""Neighbour-graph positions: weights, preservation and repeatability."""

import math

import numpy as np
import pytest

from spawnlens.operators import density as D
from spawnlens.operators import layout as L
from spawnlens.streaming.jobs import keep


def frame(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, x array<double>")


def near_of(x: np.ndarray, k: int) -> list:
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    return [[(int(j), d[i, j]) for j in d[i].argsort(kind="stable")[:k]] for i in range(len(x))]


def test_graph(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    near, own = near_of(x, 5), {}
    for i, l in enumerate(near):  # noqa: E741
        least, mean = l[0][1], sum(d for _, d in l) / 5
        for j, d in l:
            own[i, j] = math.exp(-(d - least) / (mean - least))
    want = {(i, j): own.get((i, j), 0) + own.get((j, i), 0) - own.get((i, j), 0) * own.get((j, i), 0) for i in range(60) for j in range(60) if (i, j) in own or (j, i) in own}
    cells = D.Cells(keep(D.distinct_points(frame(spark, x.tolist()))), keep, 6)
    got = {(r["point"], r["other"]): r["w"] for r in L.neighbour_graph(D.neighbours(cells, 5)).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(w) for e, w in want.items())


def test_preservation(spark):
    r = np.random.default_rng(6)
    x, at = r.normal(size=(80, 4)), r.normal(size=(80, 2))
    one, two = near_of(x, 6), near_of(at, 6)
    want = sum(len({j for j, _ in a} & {j for j, _ in b}) for a, b in zip(one, two, strict=True)) / (80 * 6)
    plane = spark.createDataFrame([(k, *v) for k, v in enumerate(at.tolist())], "id long, px double, py double")
    assert L.preservation(frame(spark, x.tolist()), plane, keep, 6).first()["preserved"] == pytest.approx(want)


def test_layout(spark):
    """Eight clouds at the corners of a cube, which two components cannot keep apart: the graph keeps more neighbours, twice the same, copies in one place."""
    r = np.random.default_rng(8)
    corners = np.array([[a, b, c, 0.0] for a in (0, 4) for b in (0, 4) for c in (0, 4)])
    x = (corners[r.integers(0, 8, 160)] + r.normal(size=(160, 4)) * 0.5).tolist()
    rows = frame(spark, [*x, x[0], None, [1.0, None, 0.0, 0.0]])
    first = keep(L.neighbour_layout(rows, keep, k=8, rounds=10))
    at = {q["id"]: (q["px"], q["py"]) for q in first.collect()}
    assert len(at) == 163 and at[160] == at[0] and at[161] == at[162] == (None, None)
    again = {q["id"]: (q["px"], q["py"]) for q in L.neighbour_layout(rows, keep, k=8, rounds=10).collect()}
    assert all(again[k][0] == pytest.approx(at[k][0], abs=1e-6) for k in range(160))
    start = L.start(D.distinct_points(frame(spark, x))).withColumnRenamed("point", "id")
    assert L.preservation(frame(spark, x), first, keep, 8).first()[0] > L.preservation(frame(spark, x), start, keep, 8).first()[0]
    assert L.neighbour_layout(frame(spark, []), keep).count() == 0


def test_neighbours_in_space_are_found_once(spark, monkeypatch):
    """Layout and preservation take the neighbours that are at hand: the same results, with one search in space and one in the plane."""
    x = np.random.default_rng(3).normal(size=(60, 4)).tolist()
    rows, searches, found = frame(spark, x), [], D.neighbours
    monkeypatch.setattr(L, "neighbours", lambda cells, k: searches.append(k) or found(cells, k))
    known = L.nearest(rows, keep, 6)
    plane = keep(L.neighbour_layout(rows, keep, k=6, rounds=2, known=known))
    share = L.preservation(rows, plane, keep, 6, known=known).first()[0]
    assert len(searches) == 2
    assert L.preservation(rows, plane, keep, 6).first()[0] == pytest.approx(share) and len(searches) == 4


def test_few_cells_are_asked_in_the_plane(spark, monkeypatch):
    """Points drawn by hash bound the distance to the nearest, so that a point in the plane is held against few cells, and a block gives one row for each point."""
    at = np.random.default_rng(11).uniform(size=(4000, 2))
    cells, compare, seen = D.Cells(keep(D.distinct_points(frame(spark, at.tolist()))), keep, 40), D.B.compare, []

    def spied(queries, points, *rest):
        found = compare(queries, points, *rest)
        seen.append((queries.select("mask").rdd.map(lambda r: sum(map(int.bit_count, r["mask"]))).mean(), found.count(), found.selectExpr("point").distinct().count()))
        return found

    monkeypatch.setattr(D.B, "compare", spied)
    got = {(r["point"], r["place"]): (r["other"], r["d"]) for r in D.neighbours(cells, 6).collect()}
    want = {(i, n + 1): e for i, l in enumerate(near_of(at, 6)) for n, e in enumerate(l)}  # noqa: E741
    assert got == want
    asked, rows, points = seen[0]
    assert asked < 5 and points == 4000 and rows < 3 * 4000


def test_positions_sent_or_shuffled(spark, monkeypatch):
    """Positions of more points than are broadcast meet the edges by shuffles: the same layout."""
    rows = frame(spark, np.random.default_rng(5).normal(size=(50, 4)).tolist())
    of = lambda: {r["id"]: (r["px"], r["py"]) for r in L.neighbour_layout(rows, keep, k=5, rounds=3).collect()}
    sent = of()
    monkeypatch.setattr(L, "SENT", 10)
    shuffled = of()
    assert len(sent) == 50 and all(shuffled[p] == pytest.approx(at, abs=1e-6) for p, at in sent.items())


def test_no_rows_no_share(spark):
    empty = frame(spark, [])
    plane = spark.createDataFrame([], "id long, px double, py double")
    assert L.preservation(empty, plane, keep, 3).first()["preserved"] is None
