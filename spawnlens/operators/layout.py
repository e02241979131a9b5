"""Plane positions that keep neighbourhoods: a graph of nearest neighbours, locally scaled, laid out by attraction along its edges and repulsion from all.

Equal vectors are one point. A round moves every point at once: towards its neighbours, along edges joined with the positions, and away from the others, whose
repulsion is estimated from 256 points that a hash draws anew for each round, so that a round costs the edges and never all pairs. Edges are dealt by point once;
up to 1,048,576 positions (three numbers each) are sent to them, beyond that edges and positions are shuffled in each round. Start (principal components), draws
and moves are given by the rows and the seed. Rows whose vector is null or holds null or non-finite components have null positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import principal_scores
from .density import Cells, Keep, distinct_points, neighbours, to_rows

#: Points that a round's repulsion is estimated from; spread of the start; a move's greatest length in each direction; weight of repulsion;
#: positions that are broadcast at most; points that are pushed at once.
DRAWN, SPREAD, CLIP, PUSH, SENT, HELD = 256, 10.0, 2.0, 5.0, 1 << 20, 512


def neighbour_graph(near: DataFrame) -> DataFrame:
    """point, other, w: both directions of each edge. From a point, an edge weighs exp(-(d - nearest) / mean of these), so that dense and sparse places count
    alike; both ends' weights p and q join to p + q - pq."""
    scale = near.groupBy("point").agg(F.min("d").alias("least"), F.avg("d").alias("mean"))
    excess = F.col("d") - F.col("least")
    weight = F.coalesce(F.exp(-F.try_divide(excess, F.col("mean") - F.col("least"))), F.lit(1.0))
    each = near.join(scale, "point").select("point", "other", weight.alias("w"))
    both = each.union(each.select("other", "point", "w")).groupBy("point", "other").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    return both.select("point", "other", F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def start(points: DataFrame) -> DataFrame:
    """point, px, py: two principal components, the wider one from -SPREAD to SPREAD."""
    width = len(points.select("x").first()["x"])
    two = principal_scores(points, 2) if width >= 2 else points.withColumn("scores", F.array(F.element_at("x", 1), F.lit(0.0)))
    at = two.select("point", F.element_at("scores", 1).alias("px"), F.element_at("scores", 2).alias("py"))
    mid = at.agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    moved = at.crossJoin(F.broadcast(mid)).select("point", (F.col("px") - F.col("cx")).alias("px"), (F.col("py") - F.col("cy")).alias("py"))
    most = moved.agg(F.greatest(F.max(F.abs("px")), F.max(F.abs("py")), F.lit(1e-12)).alias("most"))
    scaled = moved.crossJoin(F.broadcast(most))
    return scaled.select("point", (F.col("px") * SPREAD / F.col("most")).alias("px"), (F.col("py") * SPREAD / F.col("most")).alias("py"))


def nearest(rows: DataFrame, keep: Keep, k: int = 15, x: str = "x") -> tuple[DataFrame, DataFrame]:
    """The different vectors of rows (id, x), and each one's k nearest (point, other, d, place), both written once for what asks for them."""
    points = keep(distinct_points(rows.select("id", F.col(x).cast("array<double>").alias("x"))))
    return points, keep(neighbours(Cells(points, keep), k)) if not points.isEmpty() else points.selectExpr("point", "point AS other", "0.0D AS d", "0 AS place")


def neighbour_layout(rows: DataFrame, keep: Keep, k: int = 15, rounds: int = 30, seed: int = 42, x: str = "x", known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, px, py of rows (id, x). known is what nearest() gives for the rows, where it is at hand."""
    named = rows.select("id", F.col(x).cast("array<double>").alias("x"))
    points, near = known or nearest(named, keep, k)
    if points.isEmpty():
        return named.select("id", F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"))
    edges = keep(neighbour_graph(near).repartition("point"))
    at = keep(start(points))
    sent = F.broadcast if at.count() <= SENT else lambda positions: positions
    clip = lambda c: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), c))
    for r in range(rounds):
        drawn = np.array([[p["px"], p["py"]] for p in at.orderBy(F.xxhash64("point", F.lit(seed + r)), "point").limit(DRAWN).collect()])
        rate = 1.0 - r / rounds
        pull = edges.join(sent(at.select(F.col("point").alias("other"), F.col("px").alias("ox"), F.col("py").alias("oy"))), "other").join(sent(at), "point")
        dx, dy = F.col("ox") - F.col("px"), F.col("oy") - F.col("py")
        force = F.col("w") / (1 + dx * dx + dy * dy)
        pulled = pull.groupBy("point").agg(F.sum("w").alias("w"), F.sum(force * dx).alias("fx"), F.sum(force * dy).alias("fy"))

        def pushed(batches, drawn=drawn):
            for b in batches:
                p = [np.asarray(b.column(c)) for c in ("px", "py")]
                f = np.zeros((2, b.num_rows))
                for s in range(0, b.num_rows, HELD):
                    d = [c[None, s : s + HELD] - drawn[:, n, None] for n, c in enumerate(p)]
                    near = d[0] ** 2 + d[1] ** 2
                    f[:, s : s + HELD] = [(c / ((0.001 + near) * (1 + near))).clip(-4, 4).mean(axis=0) for c in d]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, f)], names=[*b.schema.names, "gx", "gy"])

        away = at.select("point", "px", "py").mapInArrow(pushed, "point long, px double, py double, gx double, gy double")
        both = away.join(pulled, "point", "left")
        step = lambda p, f, g: (F.col(p) + rate * clip(F.coalesce(F.col(f) / F.col("w"), F.lit(0.0)) + PUSH * F.col(g))).alias(p)
        at = keep(both.select("point", step("px", "fx", "gx"), step("py", "fy", "gy")))
    return to_rows(named, points, at, keep)


def preservation(space: DataFrame, plane: DataFrame, keep: Keep, k: int = 15, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """preserved: the share of each point's k nearest in space (id, x) that are among its k nearest in the plane (id, px, py), both over different vectors. known is
    what nearest() gives for space, where it is at hand."""
    points, near = known or nearest(space, keep, k)
    at = keep(points.select("point", "copies").join(plane.select(F.col("id").alias("point"), F.array("px", "py").alias("x")), "point").select("x", "point", "copies"))
    one, two = near.select("point", "other"), keep(neighbours(Cells(at, keep), k).select("point", "other"))
    kept = one.join(two, ["point", "other"], "left_semi")
    return one.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("m"))).select(F.try_divide("m", "n").alias("preserved"))
