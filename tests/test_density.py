"""Density clusters against a plain computation over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spawnlens.operators import density as D
from spawnlens.streaming.jobs import keep


def plain_tree(points: list, copies: list, x: np.ndarray, samples: int) -> list:
    """Edges (w, a, b) of the minimum spanning tree, by Kruskal over all pairs."""
    n = len(points)
    d = D.distances(x, x)
    core = []
    for i in range(n):
        have, last = copies[i] - 1, 0.0
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], points[j])):
            if have >= samples:
                break
            have, last = have + copies[j], d[i, j]
        core.append(last)
    edges = sorted((max(d[i, j], core[i], core[j]), min(points[i], points[j]), max(points[i], points[j])) for i in range(n) for j in range(i))
    of, out = {p: p for p in points}, []

    def top(p):
        while of[p] != p:
            p = of[p]
        return p

    for w, a, b in edges:
        if top(a) != top(b):
            of[top(a)] = top(b)
            out.append((w, a, b))
    return out


def plain_labels(points: list, copies: list, tree: list, least: int) -> dict:
    """The hierarchy from the top: a part is cut at its longest edge, and clusters are chosen by their stability."""
    size = dict(zip(points, copies, strict=True))
    near: dict = {p: {} for p in points}
    for w, a, b in tree:
        near[a][b] = near[b][a] = (w, a, b)

    def side(start, cut):
        seen, todo = {start}, [start]
        while todo:
            p = todo.pop()
            for q, e in near[p].items():
                if e not in cut and q not in seen:
                    seen.add(q)
                    todo.append(q)
        return seen

    cut: set = set()

    def cluster(part: set, born: float):
        """(stability, chosen parts) of a cluster and of what is inside."""
        members, stable, inside = set(part), 0.0, []
        whole = lambda s: sum(size[p] for p in s)
        while True:
            edges = [e for e in tree if e not in cut and e[1] in part and e[2] in part]
            if not edges:
                return stable + whole(part) * (1 / D.SHORTEST - born), 0.0, members, inside
            e = max(edges)
            density = 1 / max(e[0], D.SHORTEST)
            cut.add(e)
            a, b = side(e[1], cut), side(e[2], cut)
            if whole(a) >= least and whole(b) >= least:
                inside = [cluster(a, density), cluster(b, density)]
                return stable + whole(part) * (density - born), 0.0, members, inside
            if whole(a) < least and whole(b) < least:
                return stable + whole(part) * (density - born), 0.0, members, inside
            lost = b if whole(a) >= least else a
            stable += whole(lost) * (density - born)
            part = part - lost

    def choose(c):
        best = [choose(k) for k in c[3]]
        total = sum(b[0] for b in best)
        return (c[0], [c[2]]) if c[0] >= total else (total, [m for b in best for m in b[1]])

    label = dict.fromkeys(points, -1)
    if sum(copies) < least:
        return label
    for k in cluster(set(points), 0.0)[3]:
        for m in choose(k)[1]:
            label |= dict.fromkeys(m, min(m))
    return label


def clouds(seed: int, n: int) -> np.ndarray:
    """Clouds of several widths, two of them close, and noise."""
    r = np.random.default_rng(seed)
    centres, widths = np.array([[0, 0, 0], [9, 0, 0], [10.5, 0, 0], [0, 12, 3], [-8, -8, 8]]), [0.5, 0.25, 0.25, 1.5, 0.1]
    own = r.integers(0, 6, n)
    return np.where((own < 5)[:, None], centres[own % 5] + r.normal(size=(n, 3)) * np.array(widths)[own % 5][:, None], r.uniform(-15, 15, (n, 3)))


def frame(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, x array<double>")


def expected(x: list, least: int, samples: int) -> dict:
    first, copies = {}, {}
    for k, v in enumerate(x):
        first.setdefault(tuple(v), k)
        copies[tuple(v)] = copies.get(tuple(v), 0) + 1
    points = list(first.values())
    tree = plain_tree(points, [copies[tuple(x[p])] for p in points], np.array([x[p] for p in points], float), samples)
    label = plain_labels(points, [copies[tuple(x[p])] for p in points], tree, least)
    return {k: label[first[tuple(v)]] for k, v in enumerate(x)}


def got(spark, x, **more):
    return {r["id"]: r["label"] for r in D.density_clusters(frame(spark, x), keep, **more).collect()}


def test_clouds(spark):
    """600 points, few pivots and small blocks: every block path is taken."""
    x = clouds(3, 600).tolist()
    want = expected(x, 8, 5)
    assert len(set(want.values())) >= 5 and -1 in want.values()
    assert got(spark, x, pivots=20) == want


def test_ties_copies_and_small_ranges(spark):
    """Whole-number points (many equal distances), a vector that stands in a third of the rows, and ranges of 40 edges."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(0, 5, (60, 2)), r.integers(20, 24, (60, 2)), np.full((60, 2), 3)]).astype(float).tolist()
    assert got(spark, x, least=6, samples=3, pivots=7, at_once=9) == expected(x, 6, 3)


def test_odd_rows(spark):
    nothing = spark.createDataFrame([], "id long, x array<double>")
    assert D.density_clusters(nothing, keep).count() == 0
    assert D.density_quality(D.density_clusters(nothing, keep)).first()["noise_fraction"] is None
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [1.0, 2.0]), (5, [-0.0, float("inf")])], "id long, x array<double>")
    found = D.density_clusters(odd, keep)
    assert {r["id"]: r["label"] for r in found.collect()} == dict.fromkeys(range(1, 6), -1)
    q = D.density_quality(found).first()
    assert (q["n_clusters"], q["noise_fraction"]) == (0, pytest.approx(1.0))


def test_neighbours(spark):
    x = clouds(11, 300)
    cells = D.Cells(keep(D.distinct_points(frame(spark, x.tolist()))), keep, 12)
    near = {(r["point"], r["place"]): r["other"] for r in D.neighbours(cells, 4).collect()}
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(len(x)) for k, j in enumerate(d[i].argsort(kind="stable")[:4])}
    assert near == want


def test_distances_are_the_same_from_both_sides():
    x = np.random.default_rng(1).normal(size=(50, 7))
    assert (D.distances(x[:20], x) == D.distances(x, x[:20]).T).all()


def test_plan_splits_a_full_cell(spark):
    """One cell of all points, more than a block: its points and its queries are dealt in several groups."""
    rows = spark.range(3000).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("x"))
    cells = D.Cells(keep(D.distinct_points(rows)), keep, 1)
    near = D.neighbours(cells, 2)
    assert near.count() == 6000 and near.where("d > 2").count() == 0


def test_query(spark, sf_dir):
    """The registered queries over the given vectors, against all pairs of them."""
    import __spark_entry__ as e
    from spawnlens.sources import views

    x = {r["id"]: list(r["x"]) for r in views.vectors(spark, sf_dir).collect()}
    ids = sorted(x)
    place = expected([x[i] for i in ids], 8, 5)
    want = {i: ids[place[k]] if place[k] >= 0 else -1 for k, i in enumerate(ids)}
    rows = e.queries()["density_clusters"](spark, sf_dir)
    assert {r["id"]: r["label"] for r in rows.collect()} == want
    q = D.density_quality(rows).first()
    assert q["n_clusters"] == len(set(want.values()) - {-1}) and q["noise_fraction"] == pytest.approx(sum(v == -1 for v in want.values()) / len(want))


def test_silhouette_measures_few_pairs(spark):
    """Twelve clusters apart: the exact mean width, from far fewer distances than there are pairs."""
    from spawnlens.operators import clustering as C

    r = np.random.default_rng(2)
    label = r.integers(0, 12, 480)
    x = np.stack([label % 4 * 10.0, label // 4 * 10.0], axis=1) + r.normal(size=(480, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    by = np.stack([d[:, label == c].sum(axis=1) for c in range(12)], axis=1)
    size = np.bincount(label)
    a = by[np.arange(480), label] / (size[label] - 1)
    b = np.where(np.arange(12)[None] == label[:, None], np.inf, by / size[None]).min(axis=1)
    rows = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(label, x, strict=True)], "label int, x array<double>")
    got = C.silhouette(rows, at_once=16).first()
    assert got["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)
    assert got["measured"] < 0.25
    assert C.silhouette(rows.where("false")).first()["silhouette"] is None


def test_neighbours_of_odd_points(spark):
    """Equal distances, points far from the origin, very large, very small and close ones: the same as all pairs, from rough squares; 256 cells are sent to as 16 blocks."""
    from spawnlens.operators import blocks

    r = np.random.default_rng(9)
    base = r.normal(size=(70, 5))
    cases = [np.eye(40), base + 1e7, base * 1e25, base * 1e-30, np.concatenate([base, base[:20] + 1e-9, base[:3] * 1e6])]
    for x in cases:
        x = np.unique(x, axis=0)
        d = D.distances(x, x)
        np.fill_diagonal(d, np.inf)
        want = {(i, int(j), place + 1, d[i, j]) for i in range(len(x)) for place, j in enumerate(d[i].argsort(kind="stable")[:4])}
        cells = D.Cells(keep(D.distinct_points(frame(spark, x.tolist()))), keep, 5)
        assert {(q["point"], q["other"], q["place"], q["d"]) for q in D.neighbours(cells, 4).collect()} == want
    first, count = blocks.deal([2000] * 256, 32768)
    assert max(first) + 1 == 16 and set(count) == {1}


def test_nearest_of_pairs_that_are_told_with_bounds():
    """Whatever is held at once: the nearest by distance, ties to the smaller id, from bounds that say little, and bounds that fall with what is known."""
    r = np.random.default_rng(12)
    p, q, ids = r.integers(0, 4, (50, 3)).astype(float), r.integers(0, 4, (300, 3)).astype(float), r.permutation(300)
    d = D.distances(p, q)
    want = [[(int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:4]] for i in range(50)]
    for wrong, most in ((0.0, 1), (0.5, 700), (30.0, 1 << 20)):
        measured = []
        found = D.B.Nearest(np.full(50, np.inf), 4, ids, lambda i, j, m=measured: m.append(len(i)) or D.B.listed_distances(p, i, q, j))
        found.most = most
        for t in range(0, 300, 20):
            i, j = np.divmod(np.arange(50 * 20), 20)
            j += t
            open_ = d[i, j] ** 2 - wrong <= found.bound[i]
            i, j = i[open_], j[open_]
            found.tell(i, j, d[i, j] ** 2 - wrong, d[i, j] ** 2 + wrong)
        found.settle()
        assert [[(int(ids[j]), e) for j, e in zip(found.place[found.row == i], found.near[found.row == i], strict=True)] for i in range(50)] == want
        assert wrong > 1 or sum(measured) < 50 * 300


def test_distances_within_which_drawn_points_lie():
    r = np.random.default_rng(13)
    for p, q in ((r.normal(size=(70, 5)), r.normal(size=(1000, 5))), (r.normal(size=(3, 2)), r.normal(size=(9, 2)) + 1e6), (np.zeros((2, 3)), np.zeros((8, 3)))):
        exact = np.sort(D.distances(p, q), axis=1)[:, 6] ** 2
        assert (D.B.nearest_within(p, q, 6) >= exact).all()
    assert np.isinf(D.B.nearest_within(p, q[:6], 6)).all() and (D.B.nearest_within(np.zeros((1, 2)), r.normal(size=(9000, 2)), 6) < 0.1).all()


@pytest.mark.parametrize("n", [0, 3, 8, 64, 77])
def test_places_that_are_set(n):
    for rate in (0.0, 0.1, 1.0):
        found = np.random.default_rng(n).uniform(size=n) < rate
        assert D.B.set_places(found).tolist() == np.flatnonzero(found).tolist()


def test_blocks_and_pairs_that_are_needed():
    """Each query meets the blocks of its cells and, in these, all points of its cells; where it needs all of a block, in one piece."""
    r, rows = np.random.default_rng(14), [700, 0, 500, 3000, 20, 9]
    need = r.uniform(size=(40, 6)) < 0.5
    need[0], need[1] = True, False
    blocks, mask = D.B.asks(need, rows)
    first, count = D.B.deal(rows, D.B.side_of(rows))
    assert blocks.to_pylist() == [sorted({b for c in range(6) if n[c] for b in range(first[c], first[c] + count[c])}) for n in need]
    cell = r.choice([0, 2, 4], 90).astype(np.int32)
    met = np.zeros((40, 90), int)
    pieces = 0
    for asks, held in D.B.by_need(pa.table({"mask": mask}), pa.table({"cell": cell})):
        met[np.ix_(asks, held)] += 1
        pieces += 0 in asks
    assert (met == need[:, cell]).all() and pieces == 1
