"""Feature matrices: standardising, components, rotation, clusters, their quality and their summary."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .quantiles import percentiles


def moments(rows: DataFrame, x: str = "x") -> DataFrame:
    """k, mean and population standard deviation of each component."""
    return rows.select(F.posexplode(x).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def standardise(rows: DataFrame, x: str = "x") -> DataFrame:
    """Components less their mean, by their population deviation; 0 where that is 0."""
    m = moments(rows, x).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean", "sd"))), lambda s: F.struct(s["mean"].alias("mean"), s["sd"].alias("sd"))).alias("m"))  # one row, as long as a vector
    scaled = F.zip_with(x, "m", lambda v, s: F.when(s["sd"] > 0, (v - s["mean"]) / s["sd"]).otherwise(0.0))
    return rows.crossJoin(F.broadcast(m)).withColumn(x, scaled).drop("m")


def _fixed_signs(loadings: np.ndarray) -> np.ndarray:
    """Each column's largest entry made positive."""
    return loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])


def _project(rows: DataFrame, loadings: np.ndarray, x: str, out: str) -> DataFrame:
    columns = [F.array(*[F.lit(float(v)) for v in loadings[:, k]]) for k in range(loadings.shape[1])]
    dot = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(out, F.array(*[dot(c) for c in columns]))


def principal_loadings(rows: DataFrame, k: int, x: str = "x") -> np.ndarray:
    """The loading matrix, as large as a vector is long times k."""
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows.select(array_to_vector(x).alias("_v")))
    return _fixed_signs(model.pc.toArray())


def principal_scores(rows: DataFrame, k: int, x: str = "x", out: str = "scores") -> DataFrame:
    return _project(rows, principal_loadings(rows, k, x), x, out)


def varimax(loadings: np.ndarray, rounds: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    """The rotation of a small loading matrix that maximises the variance of squared loadings; it ends when a round gains less than the tolerance."""
    p, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        turned = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).sum(axis=0) / p))
        turn = u @ v
        if before and s.sum() - before < tolerance:
            break
        before = s.sum()
    return loadings @ turn


def varimax_scores(rows: DataFrame, k: int, x: str = "x", out: str = "scores") -> DataFrame:
    return _project(rows, _fixed_signs(varimax(principal_loadings(rows, k, x))), x, out)


def kmeans(rows: DataFrame, k: int, x: str = "x", seed: int = 42) -> DataFrame:
    """Adds label."""
    model = KMeans(k=max(1, k), seed=seed, featuresCol="_v", predictionCol="label").fit(rows.select(array_to_vector(x).alias("_v")))
    return model.transform(rows.drop("label").withColumn("_v", array_to_vector(x))).drop("_v")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def centroids(rows: DataFrame, x: str = "x") -> DataFrame:
    """label, size, c (the mean vector)."""
    each = rows.select("label", F.posexplode(x).alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return each.groupBy("label").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))


def davies_bouldin(rows: DataFrame, x: str = "x") -> DataFrame:
    """Mean over clusters of the largest (spread + spread) / distance to another cluster. Pairs are of clusters, which are few."""
    c = centroids(rows, x)
    spread = rows.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(distance(F.col(x), F.col("c"))).alias("s"))
    known = c.join(spread, "label")
    a, b = known.select(F.col("label").alias("la"), F.col("c").alias("ca"), F.col("s").alias("sa")), known.select(F.col("label").alias("lb"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    pairs = a.join(b, F.col("la") != F.col("lb")).withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), distance(F.col("ca"), F.col("cb"))))
    return pairs.groupBy("la").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def centroid_silhouette(rows: DataFrame, x: str = "x") -> DataFrame:
    """The mean of (b - a) / max(a, b), a and b being distances to the own and the nearest other centroid: linear in the rows, where distances to
    all points of a cluster are not."""
    c = centroids(rows, x).agg(F.collect_list(F.struct("label", "c")).alias("all"))  # one row of few clusters
    each = rows.crossJoin(F.broadcast(c)).withColumn("d", F.transform("all", lambda s: F.struct(s["label"].alias("label"), distance(F.col(x), s["c"]).alias("d"))))
    own = F.array_min(F.transform(F.filter("d", lambda s: s["label"] == F.col("label")), lambda s: s["d"]))
    other = F.array_min(F.transform(F.filter("d", lambda s: s["label"] != F.col("label")), lambda s: s["d"]))
    return each.select(own.alias("a"), other.alias("b")).agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouette(rows: DataFrame, x: str = "x", at_once: int | None = None) -> DataFrame:
    """silhouette, the mean of (b - a) / max(a, b) over all rows, a and b being mean Euclidean distances to the others of the own and of the nearest other
    cluster; 0 for a row alone in its cluster, null with fewer than two clusters. measured is the share of all pairs of different rows whose distance was taken.

    Exact. Use centroid_silhouette where it is too much.
    """
    return silhouettes(rows, ["label"], x, at_once).select("silhouette", "measured")


def silhouettes(rows: DataFrame, labels: list[str], x: str = "x", at_once: int | None = None) -> DataFrame:
    """name, silhouette and measured of each of some ways to label the same rows; rows without one of the labels are left out.

    A row's mean distance to a cluster is at least its distance d to the centroid, and at most the root of d^2 and the cluster's mean squared distance to it.
    So a row is measured against its own cluster and those others only whose least is not above the smallest most. Equal rows of one cluster are measured once
    and count as often as they stand. Distances are taken once for all ways: to the cells in which these agree, of which a cluster's sum is the sum. Blocks of
    rows are compared with blocks (see `blocks`), of which sums by row and cell remain.
    """
    names = [f"_l{k}" for k in range(len(labels))]
    named = rows.select(*[F.col(c).cast("string").alias(n) for c, n in zip(labels, names, strict=True)], F.col(x).alias("v")).where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    placed = named.groupBy(*names, "v").agg(F.count("*").alias("copies"))
    held = placed.groupBy(*names).agg(F.count("*").alias("rows"), F.sum("copies").alias("size")).orderBy(*names).collect()  # a row for each cell
    if not held:
        return rows.sparkSession.createDataFrame([(c, None, None) for c in labels], "name string, silhouette double, measured double")
    constant = lambda pairs: F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    cells: list[dict] = [{} for _ in names]  # of each way: label -> its cells
    for c, r in enumerate(held):
        for k, n in enumerate(names):
            cells[k].setdefault(r[n], []).append(c)
    joint = lambda values: F.concat_ws("/", *values)
    own = F.element_at(constant([("/".join(r[n] for n in names), c) for c, r in enumerate(held)]), joint([F.col(n) for n in names]))
    asking, needed = placed.withColumn("cell", own).withColumn("_i", F.unhex(F.sha2(F.to_json("v"), 256))), []
    for k, n in enumerate(names):
        one = named.select(F.col(n).alias("label"), "v")
        mid = centroids(one, "v")
        spread = one.join(F.broadcast(mid), "label").groupBy("label").agg(F.avg(distance(F.col("v"), F.col("c")) ** 2).alias("spread"))
        known = mid.join(spread, "label").agg(F.collect_list(F.struct("label", "c", "spread")).alias("all"))  # one row of few clusters
        away = F.transform("all", lambda s: F.struct(s["label"].alias("label"), distance(F.col("v"), s["c"]).alias("d"), s["spread"].alias("spread")))
        most = F.array_min(F.transform(F.filter("away", lambda s: s["label"] != F.col(n)), lambda s: F.sqrt(s["d"] * s["d"] + s["spread"])))  # noqa: B023
        near = F.filter("away", lambda s: (s["label"] == F.col(n)) | (s["d"] <= F.col("most") * (1 + 1e-9)))  # noqa: B023
        of = F.create_map(*[v for label, all_of in cells[k].items() for v in (F.lit(label), F.array(*[F.lit(c) for c in all_of]))])
        asking = asking.crossJoin(F.broadcast(known)).withColumn("away", away).withColumn("most", most).withColumn(f"_near{k}", F.flatten(F.transform(near, lambda s: F.element_at(of, s["label"])))).drop("all", "away", "most")  # noqa: B023
        needed.append(f"_near{k}")
    left = asking.select("_i", "cell", "copies", "v", F.array_distinct(F.concat(*needed)).alias("cells")).withColumnRenamed("cell", "own")
    right = placed.select(own.alias("cell"), "v", "copies")
    schema, kinds = "_i binary, own int, copies long, other int, d double", [("_i", pa.binary()), ("own", pa.int32()), ("copies", pa.int64()), ("other", pa.int32()), ("d", pa.float64())]

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        p, q, weight, out = B.matrix(a.column("v")), B.matrix(b.column("v")), np.asarray(b.column("copies"), float), []
        for c, asks, points in B.by_cell(a, b):
            d = B.distance_sums(p[asks], q[points], weight[points])
            out.append(a.select(["_i", "own", "copies"]).take(pa.array(asks)).append_column("other", pa.array(np.full(len(d), c, np.int32))).append_column("d", pa.array(d)))
        return pa.concat_tables(out).cast(pa.schema(kinds)) if out else pa.schema(kinds).empty_table()

    found = B.compare(left, right, F.col("v"), [r["rows"] for r in held], sums, schema, pa.schema(kinds).empty_table(), at_once)
    by = found.groupBy("_i", "own", "other").agg(F.first("copies").alias("copies"), F.sum("d").alias("d"))
    at = lambda values, col: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(col) + 1)
    cluster = lambda n, col: at([r[n] for r in held], col)
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), cluster(n, "own").alias("mine"), cluster(n, "other").alias("label")) for k, n in enumerate(names)])).alias("w")
    each = by.select("_i", "own", "copies", "other", "d", ways).select("_i", "own", "copies", "d", "w.*", at([r["rows"] for r in held], "other").alias("pairs"))
    sizes = constant([(f"{k}/{label}", sum(held[c]["size"] for c in all_of)) for k, by_label in enumerate(cells) for label, all_of in by_label.items()])
    parts = constant([(f"{k}/{label}", len(all_of)) for k, by_label in enumerate(cells) for label, all_of in by_label.items()])
    key = F.concat_ws("/", F.col("way").cast("string"), "label")
    whole = each.groupBy("way", "_i", "own", "mine", "label").agg(F.first("copies").alias("copies"), F.sum("d").alias("d"), F.sum("pairs").alias("pairs"), F.count("*").alias("n"))
    whole = whole.withColumn("size", F.element_at(sizes, key)).withColumn("d", F.when(F.col("n") == F.element_at(parts, key), F.col("d")))  # a cluster measured in part says nothing
    alone = F.max(F.when(F.col("label") == F.col("mine"), F.col("size")))
    a = F.max(F.when(F.col("label") == F.col("mine"), F.try_divide("d", F.col("size") - 1)))
    b = F.min(F.when(F.col("label") != F.col("mine"), F.col("d") / F.col("size")))
    widths = whole.groupBy("way", "_i", "own").agg(a.alias("a"), b.alias("b"), alone.alias("alone"), F.first("copies").alias("copies"), F.sum("pairs").alias("pairs"))
    width = F.when(F.col("b").isNull(), None).when(F.col("alone") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    mean = F.try_divide(F.sum(F.col("w") * F.col("copies")), F.sum(F.when(F.col("w").isNotNull(), F.col("copies"))))
    total = float(sum(r["rows"] for r in held)) ** 2
    return widths.withColumn("w", width).groupBy("way").agg(mean.alias("silhouette"), (F.sum("pairs") / F.lit(total)).alias("measured")).select(at(labels, "way").alias("name"), "silhouette", "measured")


def _quality(s: float | None, d: float | None) -> dict[str, float]:
    s, d = -1.0 if s is None else s, math.inf if d is None else d
    return {"silhouette": s, "davies_bouldin": d, "score": s - 0.1 * d}


def quality_of(rows: DataFrame, x: str = "x") -> dict[str, float]:
    """silhouette (-1 where there is none), davies_bouldin (infinite where there is none) and score, silhouette - 0.1 davies_bouldin, of labelled rows."""
    return _quality(silhouette(rows, x).first()[0], davies_bouldin(rows, x).first()[0])


def select_k(rows: DataFrame, least: int, most: int, x: str = "x") -> DataFrame:
    """k, silhouette, davies_bouldin and score of each k that gives two clusters at least, best first; one cluster if none does. Distances between rows are taken
    once for all k."""
    found, ks = rows.select(x), range(max(2, least), max(3, most) + 1)
    for k in ks:
        found = kmeans(found, k, x).withColumnRenamed("label", f"k{k}")
    counts = found.agg(*[F.countDistinct(f"k{k}").alias(f"k{k}") for k in ks]).first()
    ks = [k for k in ks if counts[f"k{k}"] >= 2]
    widths = {r["name"]: r["silhouette"] for r in silhouettes(found, [f"k{k}" for k in ks], x).collect()} if ks else {}
    out = []
    for k in ks:
        q = _quality(widths[f"k{k}"], davies_bouldin(found.select(x, F.col(f"k{k}").alias("label")), x).first()[0])
        out.append((k, q["silhouette"], q["davies_bouldin"], q["score"]))
    out = sorted(out, key=lambda q: (-q[3], q[0])) or [(1, -1.0, math.nan, -math.inf)]
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double, davies_bouldin double, score double")


def feature_means(rows: DataFrame, x: str = "x") -> DataFrame:
    return rows.select("label", F.posexplode(x).alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("mean"))


def top_features(rows: DataFrame, n: int = 5, x: str = "x") -> DataFrame:
    """Each cluster's n features of largest absolute mean; ties to the smaller number."""
    w = Window.partitionBy("label").orderBy(F.abs("mean").desc(), "k")
    return feature_means(rows, x).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def summary(rows: DataFrame, n: int = 5, x: str = "x") -> DataFrame:
    """label, size, and the top features as JSON."""
    top = top_features(rows, n, x).groupBy("label").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "k", F.round("mean", 6).alias("value")))), lambda s: F.struct(s["k"].alias("k"), s["value"].alias("value")))).alias("top"))
    return rows.groupBy("label").agg(F.count("*").alias("size")).join(top, "label")


def dedup_vectors(rows: DataFrame, x: str = "x", digits: int = 6) -> DataFrame:
    """One row for vectors that are the same to so many digits: their number, the commonest label (ties to that of the smallest id), summed weight and mean position."""
    key = F.transform(x, lambda v: F.round(v, digits))
    by = rows.withColumn("key", key).groupBy("key", "label").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("weight").alias("w"), F.sum("px").alias("px"), F.sum("py").alias("py"))
    best = F.max_by("label", F.struct("n", -F.col("first")))
    return by.groupBy("key").agg(F.min("first").alias("id"), best.alias("label"), F.sum("n").alias("n"), F.sum("w").alias("weight"), (F.sum("px") / F.sum("n")).alias("px"), (F.sum("py") / F.sum("n")).alias("py")).drop("key")


def rotate(rows: DataFrame, degrees: float, centre: str = "mean", x: str = "px", y: str = "py") -> DataFrame:
    """Points turned about their mean, or the middle of their bounding box."""
    if degrees % 360 == 0:
        return rows
    mid = [F.avg(x), F.avg(y)] if centre == "mean" else [(F.min(c) + F.max(c)) / 2 for c in (x, y)]
    got = rows.crossJoin(F.broadcast(rows.agg(mid[0].alias("_cx"), mid[1].alias("_cy"))))  # one row
    c, s = float(np.cos(np.deg2rad(degrees))), float(np.sin(np.deg2rad(degrees)))
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    return got.withColumns({x: dx * c - dy * s + F.col("_cx"), y: dx * s + dy * c + F.col("_cy")}).drop("_cx", "_cy")


def trim_outliers(rows: DataFrame, share: float, keep: Callable[[DataFrame], DataFrame], least: int = 10, x: str = "px", y: str = "py") -> DataFrame:
    """Without the share of each cluster that is farthest from its mean point; small clusters stay whole. The bound is an exact percentile, found by ranges."""
    mid = rows.groupBy("label").agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"), F.count("*").alias("_n"))
    far = rows.join(F.broadcast(mid), "label").withColumn("_d", F.sqrt((F.col(x) - F.col("_cx")) ** 2 + (F.col(y) - F.col("_cy")) ** 2))
    bound = percentiles(far, ["label"], "_d", [1.0 - share], keep).select("label", F.col("percentiles")[0].alias("_b"))
    return far.join(F.broadcast(bound), "label").where((F.col("_n") < least) | (F.col("_d") <= F.col("_b"))).drop("_cx", "_cy", "_n", "_d", "_b")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane, counter-clockwise from the leftmost; points on its edges are none."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    corners = half(points.tolist()) + half(points[::-1].tolist())
    return np.array(corners)


def convex_hulls(rows: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """label, corner (from 0), px, py of each cluster's convex hull. Tasks send the corners of their own points only: the hull of hulls is the hull."""

    def corners(by: dict) -> pa.RecordBatch:
        rows_of = [(label, k, *p) for label, points in by.items() for k, p in enumerate(hull(points).tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_of], pa.int64()), pa.array([r[1] for r in rows_of], pa.int64()), *(pa.array([r[k] for r in rows_of], pa.float64()) for k in (2, 3))], names=["label", "corner", "px", "py"])

    def own(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            labels, points = np.asarray(b.column(0)), np.stack([np.asarray(b.column(k)) for k in (1, 2)], axis=1)
            for label in np.unique(labels).tolist():
                held[label] = hull(np.concatenate([held.get(label, np.zeros((0, 2))), points[labels == label]]))
        yield corners(held)

    def whole(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([corners({t.column("label")[0].as_py(): np.stack([np.asarray(t.column(c)) for c in ("px", "py")], axis=1)})])

    schema = "label long, corner long, px double, py double"
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("label").isNotNull()).select(F.col("label").cast("long"), F.col(x).cast("double"), F.col(y).cast("double"))
    return points.mapInArrow(own, schema).groupBy("label").applyInArrow(whole, schema)


def sample_per_cluster(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n random rows of each cluster."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.rand(seed)))).where(F.col("_r") <= n).drop("_r")
