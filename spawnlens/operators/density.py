"""Density clustering by hierarchy: mutual reachability, its minimum spanning tree, and the clusters of greatest stability.

Equal vectors are one point that counts as often as it stands. A point's core distance is that to its `samples`-th other row; two points are as far apart as the
largest of their distance and their core distances. Rows are compared by blocks of cells around pivots, and cells that the triangle inequality rules out
are not read. The spanning tree grows in rounds in which every part takes its shortest edge outwards. Edges are then merged in ranges of rising
weight: a range is one bounded task, and between ranges each part keeps five numbers.

Rows whose vector is null or holds null or non-finite components belong to no cluster (-1). Equal edges are ordered by their points' ids, a point's id being
the smallest of its rows'. Vectors must have one length. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import matrix as _matrix
from .order import numbered
from .skew import keyed_join

#: Pivots that cells lie around at most; points for each of them; edges of a range; the shortest distance that a density is taken of; points drawn to bound
#: distances to the nearest at most, and their components.
PIVOTS, BLOCK, EDGES, SHORTEST, PROBES, COMPONENTS = 256, 2048, 1 << 18, 1e-9, 1 << 14, 1 << 20
Keep = Callable[[DataFrame], DataFrame]


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, component after component: the same bits for (p, q) as for (q, p), whatever block they stand in."""
    d = np.zeros((len(p), len(q)))
    rows, across = max(1, (1 << 15) // max(1, len(q))), np.ascontiguousarray(q.T)
    for s in range(0, len(p), rows):
        for k in range(p.shape[1]):
            d[s : s + rows] += (p[s : s + rows, k, None] - across[None, k]) ** 2
    return np.sqrt(d)


def _vector_key(x: str) -> Column:
    """A digest of a vector's components; -0.0 is 0.0."""
    return F.sha2(F.to_json(F.transform(x, lambda v: v + F.lit(0.0))), 256)


def distinct_points(rows: DataFrame, x: str = "x") -> DataFrame:
    """point (the smallest id), x, copies: each usable vector once."""
    usable = F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf))
    return rows.where(F.coalesce(usable, F.lit(False))).groupBy(F.col(x).cast("array<double>").alias("x")).agg(F.min("id").cast("long").alias("point"), F.count("*").alias("copies"))


def to_rows(rows: DataFrame, points: DataFrame, values: DataFrame, keep: Keep) -> DataFrame:
    """Rows (id, x) with what values say of their vector's point, null where nothing is said. Copies of one vector may be many: their key is frequent."""
    by_vector = keep(points.select("point", _vector_key("x").alias("_key")).join(values, "point").drop("point"))
    return keyed_join(rows.select("id", _vector_key("x").alias("_key")), by_vector, "_key", "left").drop("_key")


class Cells:
    """Points by nearest pivot. Pivots are drawn by hash: one for each block's worth of points, 256 at most, as a query is sent to each cell that it needs and
    smaller cells would only send it more often. What the driver holds is a row for each cell."""

    def __init__(self, points: DataFrame, keep: Keep, pivots: int | None = None):
        self.keep = keep
        pivots = pivots or min(PIVOTS, -(-points.count() // BLOCK))
        self.pivots = np.array([r["x"] for r in points.select("x", "point").orderBy(F.xxhash64("point"), "point").limit(pivots).collect()], dtype=float)
        at = self.pivots

        def nearest(batches):
            for b in batches:
                d = distances(_matrix(b.column("x")), at)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "reach"])

        self.points = keep(points.mapInArrow(nearest, f"{_ddl(points)}, cell int, reach double"))
        held = self.points.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"), F.max("reach").alias("reach")).collect()
        self.rows, self.copies, self.reach = np.zeros(len(at), int), np.zeros(len(at), int), np.zeros(len(at))
        for r in held:
            self.rows[r["cell"]], self.copies[r["cell"]], self.reach[r["cell"]] = r["rows"], r["copies"], r["reach"] * (1 + 1e-9)

    def search(self, queries: DataFrame, points: DataFrame, bounds, step, schema: str) -> DataFrame:
        """What step(queries, points) finds in blocks of the cells that bounds(batch, distances to pivots) calls needed."""
        at, rows = self.pivots, self.rows.tolist()

        def route(batches):
            for b in batches:
                blocks, mask = B.asks(bounds(b, distances(_matrix(b.column("x")), at)), rows)
                yield pa.RecordBatch.from_arrays([*b.columns, blocks, mask], names=[*b.schema.names, "blocks", "mask"])

        plain = queries.drop("cell")
        routed = plain.mapInArrow(route, f"{_ddl(plain)}, blocks array<int>, mask binary")
        kinds = {"double": pa.float64(), "long": pa.int64(), "array<struct<d:double,other:long>>": pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64())]))}
        nothing = pa.table({c: pa.array([], kinds[kind]) for c, kind in (f.split() for f in schema.split(", "))})
        return B.compare(routed, points, F.col("point"), rows, step, schema, nothing)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def neighbours(cells: Cells, k: int) -> DataFrame:
    """point, other, d, place (from 1): each point's k nearest other points (all, if fewer), ties to the smaller id. Exact.

    A point first meets points drawn by hash, an eighth of all and PROBES at most: its k nearest lie no farther than k of those, so that cells and pairs beyond
    are left out. A block gives one row for each point that it has neighbours for."""
    rows, reach = cells.rows, cells.reach
    total = int(rows.sum())
    if not total:
        return cells.points.selectExpr("point", "point AS other", "0.0D AS d", "0 AS place")
    drawn = max(4 * k, min(PROBES, COMPONENTS // max(1, cells.pivots.shape[1]), max(B.LEAST, total // 8)))
    probes = _matrix(cells.points.where(F.pmod(F.xxhash64("point", F.lit(1)), F.lit(total)) < drawn).select("x").toArrow().column(0))

    def probed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(B.nearest_within(_matrix(b.column("x")), probes, k))], names=[*b.schema.names, "bound"])

    def bounds(batch, d: np.ndarray) -> np.ndarray:
        farthest = d + reach
        farthest[:, rows == 0] = math.inf
        order = farthest.argsort(axis=1)
        enough = (rows[order].cumsum(axis=1) > k).argmax(axis=1) if rows.sum() > k else np.full(len(d), len(rows) - 1)
        bound = np.minimum(farthest[np.arange(len(d)), order[np.arange(len(d)), enough]], np.sqrt(np.asarray(batch.column("bound"))))
        return (d - reach <= bound[:, None] * (1 + 1e-9)) & (rows > 0)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        here, there = np.asarray(a.column("point")), np.asarray(b.column("point"))
        p, q = _matrix(a.column("x")), _matrix(b.column("x"))
        found = B.Nearest(a.column("bound").to_numpy().copy(), k, there, lambda i, j: B.listed_distances(p, i, q, j))
        for asks, held in B.by_need(a, b):
            left, right, wrong, unit = B.rough_squares(p[asks], q[held])
            for s in range(0, len(asks), B.ROWS):
                at, e = asks[s : s + B.ROWS], wrong[s : s + B.ROWS]
                for t in range(0, len(held), B.COLUMNS):
                    d = left[s : s + B.ROWS] @ right[:, t : t + B.COLUMNS]
                    i, j = np.divmod(B.set_places(d <= np.nan_to_num((found.bound[at] / unit + e) * (1 + 1e-6), nan=math.inf).astype(np.float32)[:, None]), d.shape[1])
                    rough, j = d[i, j].astype(float), held[t + j]
                    ok = here[at[i]] != there[j]
                    i, j, rough = i[ok], j[ok], rough[ok]
                    found.tell(at[i], j, (rough - e[i]) * unit, np.maximum((rough + e[i]) * unit, 0.0))
        found.settle()
        has, first = np.unique(found.row, return_index=True)
        near = pa.StructArray.from_arrays([pa.array(found.near), pa.array(there[found.place])], names=["d", "other"])
        return pa.table({"point": here[has], "near": pa.ListArray.from_arrays(pa.array([*first, len(near)], pa.int32()), near)})

    asking = cells.keep(cells.points.select("point", "x").mapInArrow(probed, "point long, x array<double>, bound double"))
    every = cells.search(asking, cells.points.select("point", "x", "cell"), bounds, step, "point long, near array<struct<d:double,other:long>>")
    best = every.groupBy("point").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k entries of each block
    return best.select("point", F.posexplode("near").alias("place", "e")).select("point", "e.other", "e.d", (F.col("place") + 1).alias("place"))


def core_distances(cells: Cells, near: DataFrame, samples: int, k: int) -> DataFrame:
    """The points with core (distance to the samples-th other row, or the farthest if there are fewer; 0 for a point with more copies) and far, below which no
    other point than the k neighbours lies (infinite where these are all)."""
    others = near.join(cells.points.select(F.col("point").alias("other"), F.col("copies").alias("n")), "other")
    lists = others.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("place", "d", "n"))).alias("l"))  # k entries
    held = cells.points.join(lists, "point", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<place:int,d:double,n:bigint>>")))
    start = F.struct((F.col("copies") - 1).alias("n"), F.lit(0.0).alias("d"))
    last = F.aggregate("l", start, lambda s, e: F.when(s["n"] >= samples, s).otherwise(F.struct((s["n"] + e["n"]).alias("n"), e["d"].alias("d"))))
    return held.withColumns({"core": last["d"], "far": F.when(F.size("l") < k, F.lit(math.inf)).otherwise(F.element_at("l", -1)["d"])}).drop("l", "reach")


def _roots(up: DataFrame, keep: Keep) -> DataFrame:
    """comp, up: each part's last one by the pointers, of which two that point at each other end at the smaller."""
    then = up.select(F.col("comp").alias("up"), F.col("up").alias("next"))
    now = keep(up.join(then, "up").select("comp", F.when((F.col("next") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")))
    while True:
        then = now.select(F.col("comp").alias("up"), F.col("up").alias("next"))
        now = keep(now.join(then, "up").select("comp", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spanning_tree(cells: Cells, points: DataFrame, near: DataFrame, keep: Keep) -> DataFrame:
    """w, a, b: the minimum spanning tree of mutual reachability, equal weights by (a, b). points have core and far.

    A round looks outwards among the neighbours first. Only a point whose listed neighbours end before its part's best edge is searched for in the cells, within
    that edge's length; parts at least halve, so that rounds are at most log2 of the points.
    """
    core = points.select("point", "core")
    ends = near.join(core, "point").join(core.select(F.col("point").alias("other"), F.col("core").alias("core2")), "other")
    live = keep(ends.select(F.greatest("d", "core", "core2").alias("w"), F.least("point", "other").alias("a"), F.greatest("point", "other").alias("b")).distinct())
    own = points.select("point", F.col("point").alias("comp"))
    tree: list[DataFrame] = []
    reach, rows = cells.reach, cells.rows
    while True:
        of = lambda end, name: own.select(F.col("point").alias(end), F.col("comp").alias(name))
        placed = lambda e: e.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb")
        joined = keep(placed(live))
        both = lambda e: e.selectExpr("ca AS comp", "cb AS other", "w", "a", "b").union(e.selectExpr("cb", "ca", "w", "a", "b"))
        known = both(joined).groupBy("comp").agg(F.min("w").alias("best"))
        grown = keep(points.join(own, "point").join(known, "comp", "left").withColumn("bound", F.coalesce("best", F.lit(math.inf))).drop("best"))
        held = grown.groupBy("cell").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.max("core").alias("core")).collect()
        if not held or min(r["one"] for r in held) == max(r["other"] for r in held):
            break
        solo, mixed, cores = np.zeros(len(rows), np.int64), np.ones(len(rows), bool), np.zeros(len(rows))
        for r in held:
            solo[r["cell"]], mixed[r["cell"]], cores[r["cell"]] = r["one"], r["one"] != r["other"], r["core"]

        def bounds(b, d: np.ndarray, solo=solo, mixed=mixed, cores=cores) -> np.ndarray:
            comp, bound = np.asarray(b.column("comp")), np.asarray(b.column("bound"))
            other = (mixed | (solo[None] != comp[:, None])) & (rows > 0)
            sure = np.where(other & ~mixed, np.maximum(np.maximum(d + reach, cores), np.asarray(b.column("core"))[:, None]), math.inf).min(axis=1)
            return other & (d - reach <= np.minimum(bound, sure)[:, None] * (1 + 1e-9))

        def step(a: pa.Table, b: pa.Table) -> pa.Table:
            here, there = np.asarray(a.column("point")), np.asarray(b.column("point"))
            p, q, mine, theirs = _matrix(a.column("x")), _matrix(b.column("x")), np.asarray(a.column("comp")), np.asarray(b.column("comp"))
            core_a, core_b = np.asarray(a.column("core")), np.asarray(b.column("core"))
            best, least = np.full(len(p), -1), np.asarray(a.column("bound")) * (1 + 1e-9)
            for asks, held in B.by_need(a, b):
                left, right, wrong, unit = B.rough_squares(p[asks], q[held])
                own_b = np.minimum(core_b[held] ** 2 / unit, 1e37).astype(np.float32)
                for s in range(0, len(asks), B.ROWS):
                    at, e = asks[s : s + B.ROWS], wrong[s : s + B.ROWS]
                    for t in range(0, len(held), B.COLUMNS):
                        w = np.maximum(left[s : s + B.ROWS] @ right[:, t : t + B.COLUMNS], own_b[None, t : t + B.COLUMNS])
                        w[mine[at, None] == theirs[None, held[t : t + B.COLUMNS]]] = math.inf
                        most = np.minimum(np.maximum(w.min(axis=1) + 2 * e, core_a[at] ** 2 / unit + e), least[at] ** 2 / unit + e) * (1 + 1e-6)
                        i, j = np.divmod(np.flatnonzero(w <= np.minimum(most, 3e38).astype(np.float32)[:, None]), w.shape[1])  # below infinity, which is the own part
                        i, j = at[i], held[t + j]
                        exact = np.maximum(np.maximum(B.pair_distances(p[i], q[j]), core_b[j]), core_a[i])
                        order = np.lexsort((there[j], exact, i))
                        i, j, exact = i[order], j[order], exact[order]
                        first = np.ones(len(i), bool)
                        first[1:] = i[1:] != i[:-1]
                        i, j, exact = i[first], j[first], exact[first]  # the smallest id of equal ones
                        ok = (exact < least[i]) | ((exact == least[i]) & ((best[i] < 0) | (there[j] < there[best[i]])))
                        best[i[ok]], least[i[ok]] = j[ok], exact[ok]
            got = best >= 0
            return pa.table({"point": here[got], "other": there[best[got]], "w": least[got]})

        asking = grown.where(F.col("far") <= F.col("bound")).select("point", "x", "core", "comp", "bound")
        found = cells.search(asking, grown.select("point", "x", "core", "comp", "cell"), bounds, step, "point long, other long, w double")
        more = keep(placed(found.select("w", F.least("point", "other").alias("a"), F.greatest("point", "other").alias("b")).distinct()))
        live = joined.drop("ca", "cb")
        chosen = keep(both(joined.select("ca", "cb", "w", "a", "b").union(more.select("ca", "cb", "w", "a", "b"))).groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")))
        tree.append(chosen.select("e.w", "e.a", "e.b"))
        up = _roots(chosen.select("comp", F.col("e.other").alias("up")), keep)
        own = keep(own.join(up, "comp").select("point", F.col("up").alias("comp")))
    if not tree:
        return points.sparkSession.createDataFrame([], "w double, a long, b long")
    every = tree[0]
    for t in tree[1:]:
        every = every.union(t)
    return keep(every.distinct())


def merge_range(edges: list[tuple], states: dict, least: int) -> tuple[dict, list, dict]:
    """Merges edges (w, number, part, part) in their order. states: part -> [size, cluster or None, sum of density * size, size so summed, stability of the best
    clusters inside], changed in place to the parts that are left. Gives part -> (part it is in, cluster its points fell to), clusters that ended, states."""
    up = {c: c for c in states}
    fell = {c: "" for c, s in states.items() if s[1] is not None}
    ended: list[tuple] = []

    def top(c):
        while up[c] != c:
            c = up[c]
        return c

    for w, number, one, other in edges:
        a, b = sorted((top(one), top(other)), key=lambda c: (-states[c][0], c))
        s, t = states[a], states.pop(b)
        density = 1.0 / max(w, SHORTEST)
        total = s[0] + t[0]
        if t[1] is not None:  # the smaller is a cluster, so both are: they end, and a wider one begins
            gain = 0.0
            for c in (s, t):
                stability = c[2] - density * c[3]
                ended.append((c[1], f"e{number}", stability, stability >= c[4]))
                gain += max(stability, c[4])
            states[a] = [total, f"e{number}", density * total, total, gain]
        elif s[1] is not None:
            fell[b] = s[1]
            states[a] = [total, s[1], s[2] + density * t[0], s[3] + t[0], s[4]]
        elif total >= least:
            fell[a] = fell[b] = f"e{number}"
            states[a] = [total, f"e{number}", density * total, total, 0.0]
        else:
            states[a] = [total, None, 0.0, 0, 0.0]
        up[b] = a
    moved = {}
    for c in up:
        at = c
        while at not in fell and up[at] != at:
            at = up[at]
        moved[c] = (top(c), fell.get(at) or None)
    return moved, ended, states


def condense(tree: DataFrame, points: DataFrame, least: int, keep: Keep, at_once: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """(point, cluster), null for points of none, and (cluster, parent, stability, chosen): the hierarchy of clusters of `least` rows at least. chosen is a
    cluster at least as stable as the best ones inside it; the widest is never chosen."""
    first = F.when(F.col("copies") >= least, F.concat(F.lit("p"), F.col("point").cast("string")))
    density = F.when(first.isNotNull(), F.col("copies") / F.lit(SHORTEST)).otherwise(0.0)
    own = keep(points.select("point", F.col("point").alias("comp"), first.alias("cluster")))
    states = keep(points.select(F.col("point").alias("comp"), F.col("copies").alias("size"), first.alias("cluster"), density.alias("s"), F.when(first.isNotNull(), F.col("copies")).otherwise(0).alias("n"), F.lit(0.0).alias("best")))
    edges = keep(numbered(tree, ["w", "a", "b"]))
    total = edges.count()
    schema = "kind string, comp long, into long, cluster string, parent string, size long, s double, n long, best double, chosen boolean"
    fields = pa.schema([("kind", pa.string()), ("comp", pa.int64()), ("into", pa.int64()), ("cluster", pa.string()), ("parent", pa.string()), ("size", pa.int64()), ("s", pa.float64()), ("n", pa.int64()), ("best", pa.float64()), ("chosen", pa.bool_())])

    def step(e: pa.Table, s: pa.Table) -> pa.Table:
        rows = e.sort_by([("no", "ascending")])
        held = {r["comp"]: [r["size"], r["cluster"], r["s"], r["n"], r["best"]] for r in s.to_pylist()}
        moved, ended, left = merge_range(list(zip(*(rows.column(c).to_pylist() for c in ("w", "no", "ca", "cb")), strict=True)), held, least)
        out = [{"kind": "moved", "comp": c, "into": i, "cluster": f} for c, (i, f) in moved.items()]
        out += [{"kind": "ended", "cluster": c, "parent": p, "s": v, "chosen": bool(k)} for c, p, v, k in ended]
        out += [{"kind": "state", "comp": c, "size": v[0], "cluster": v[1], "s": v[2], "n": v[3], "best": v[4]} for c, v in left.items()]
        return pa.Table.from_pylist(out, schema=fields)

    parts: list[DataFrame] = []
    for start in range(0, total, at_once):
        here = edges.where((F.col("no") > start) & (F.col("no") <= start + at_once))
        of = lambda end, name: own.select(F.col("point").alias(end), F.col("comp").alias(name))
        joined = keep(here.join(of("a", "ca"), "a").join(of("b", "cb"), "b").select("w", "no", "ca", "cb"))
        touched = states.join(joined.select(F.explode(F.array("ca", "cb")).alias("comp")).distinct(), "comp", "left_semi")
        one = lambda df: df.withColumn("_one", F.lit(0)).groupBy("_one")
        done = keep(one(joined).cogroup(one(touched)).applyInArrow(step, schema))  # at most at_once edges, twice as many parts
        moved = done.where("kind = 'moved'").select("comp", "into", F.col("cluster").alias("fell"))
        parts.append(done.where("kind = 'ended'").select("cluster", "parent", F.col("s").alias("stability"), "chosen"))
        own = keep(own.join(moved, "comp", "left").select("point", F.coalesce("into", "comp").alias("comp"), F.coalesce("cluster", "fell").alias("cluster")))
        states = keep(states.join(moved, "comp", "left_anti").union(done.where("kind = 'state'").select("comp", "size", "cluster", "s", "n", "best")))
    clusters = states.where("cluster IS NOT NULL").select("cluster", F.lit(None).cast("string").alias("parent"), F.col("s").alias("stability"), F.lit(False).alias("chosen"))
    for p in parts:
        clusters = clusters.union(p)
    return own.select("point", "cluster"), keep(clusters)


def highest_chosen(clusters: DataFrame, keep: Keep) -> DataFrame:
    """cluster, top: the chosen cluster nearest to the root among a cluster and those around it, null if none is."""
    now = keep(clusters.select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("top"), F.col("parent").alias("up")))
    while not now.where("up IS NOT NULL").isEmpty():
        then = now.select(F.col("cluster").alias("up"), F.col("top").alias("top2"), F.col("up").alias("up2"))
        now = keep(now.join(then, "up", "left").select("cluster", F.coalesce("top2", "top").alias("top"), F.col("up2").alias("up")))
    return now.drop("up")


def density_clusters(rows: DataFrame, keep: Keep, least: int = 8, samples: int = 5, x: str = "x", pivots: int | None = None, at_once: int = EDGES) -> DataFrame:
    """id, label of rows (id, x): the smallest id of the row's cluster, or -1 for noise. least rows make a cluster; densities are of the samples-th other row."""
    named = rows.select("id", F.col(x).cast("array<double>").alias("x"))
    cells = Cells(keep(distinct_points(named)), keep, pivots)
    if not len(cells.pivots):
        return named.select("id", F.lit(-1).cast("long").alias("label"))
    k = 2 * samples + 1
    near = keep(neighbours(cells, k))
    points = keep(core_distances(cells, near, samples, k))
    own, clusters = condense(spanning_tree(cells, points, near, keep), points, least, keep, at_once)
    tops = keep(highest_chosen(clusters, keep).where("top IS NOT NULL"))
    placed = keep(keyed_join(own, tops, "cluster"))
    labels = keep(placed.groupBy("top").agg(F.min("point").alias("label")))
    labelled = keep(keyed_join(placed, labels, "top").select("point", "label"))
    return to_rows(named, points, labelled, keep).select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def density_quality(labelled: DataFrame) -> DataFrame:
    """n_clusters and noise_fraction (null without rows)."""
    noise = F.col("label") == -1
    return labelled.agg(F.countDistinct(F.when(~noise, F.col("label"))).alias("n_clusters"), F.avg(noise.cast("double")).alias("noise_fraction"))
