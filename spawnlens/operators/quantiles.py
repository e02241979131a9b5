"""Exact percentiles by group, by narrowing ranges of values, without a group's values in one place.

Values are counted by group first, in tasks and then by (group, value), so that a frequent value is one row and a large group is spread by its values. A rank of
a group then has a bracket, at first all of the group's values. While a bracket holds more than `at_once` different values, pivots from a mergeable
sketch cut it, a histogram over the pivots says in which part the rank lies, and that part is the new bracket. Of the last bracket's values, `at_once` at most,
a running count picks the one of the rank. Histograms and brackets are all that is exchanged; ranks of one group share their brackets' counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different values that one window may count at last; pivots of a round; brackets up to which they are broadcast.
AT_ONCE, PIVOTS, BROADCAST = 4096, 64, 50_000


def counted(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, v double, c: how often each value stands in its group. Nulls do not count; NaN is the largest value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))


def _targets(counts: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """groups, place (of the share), rank (from 1), part (of the way to the next rank), for the two ranks between which each share falls."""
    pos = (F.col("n") - 1) * F.col("s.share")
    low = F.floor(pos).cast("long")
    sized = counts.groupBy(*groups).agg(F.sum("c").alias("n"), F.count("*").alias("different"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)]))
    ranks = sized.withColumn("s", each).withColumn("low", low).withColumn("part", pos - low)
    both = F.explode(F.array(F.struct(F.lit(0).alias("upper"), (F.col("low") + 1).alias("rank")), F.struct(F.lit(1).alias("upper"), F.least(F.col("low") + 2, F.col("n")).alias("rank"))))
    return ranks.withColumn("r", both).select(*groups, "s.place", "part", "r.upper", "r.rank", "different", "lo", "hi").withColumn("below", F.lit(0).cast("long"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _with(counts: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """Values joined with their group's brackets, and only those within. Brackets are few and are broadcast up to a size that is counted."""
    renamed = brackets.select(*[F.col(g).alias(f"_{g}") for g in groups], "lo", "hi")
    small = renamed.limit(BROADCAST + 1).count() <= BROADCAST
    cond = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for g in groups:
        cond = cond & _same(F.col(g), F.col(f"_{g}"))
    return counts.join(F.broadcast(renamed) if small else renamed, cond).drop(*[f"_{g}" for g in groups])


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: list[float], keep: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE, pivots: int = PIVOTS) -> DataFrame:
    """groups, percentiles array<double>: for each share, 0 to 1, the value that far along the group's sorted values, between two of them by the straight line.

    keep(df) stores a table and reads it again, so that a round does not recompute the one before. A group without a value gives no row.
    """
    counts = keep(counted(rows, groups, value))
    open_, done = keep(_targets(counts, groups, shares)), None
    while True:
        settled = open_.where(F.col("different") <= at_once)
        done = settled if done is None else done.unionByName(settled)
        wide = open_.where(F.col("different") > at_once)
        if wide.isEmpty():
            break
        open_ = keep(_narrowed(counts, wide, groups, pivots))
    key = [*groups, "lo", "hi"]
    brackets = keep(done.select(*key).distinct())
    inside = _with(counts, brackets, groups)
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = inside.withColumn("upto", upto)
    hit = places.alias("p").join(done.alias("t"), [_same(F.col(f"p.{k}"), F.col(f"t.{k}")) for k in key] + [F.col("p.upto") >= F.col("t.rank") - F.col("t.below"), F.col("p.upto") - F.col("p.c") < F.col("t.rank") - F.col("t.below")])
    found = hit.select(*[F.col(f"t.{g}").alias(g) for g in groups], "t.place", "t.part", "t.upper", "p.v")
    at = found.groupBy(*groups, "place", "part").agg(F.max(F.when(F.col("upper") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("upper") == 1, F.col("v"))).alias("b"))
    between = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return at.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", between.alias("v")))), lambda s: s["v"]).alias("percentiles"))


def _narrowed(counts: DataFrame, wide: DataFrame, groups: list[str], pivots: int) -> DataFrame:
    """Targets with brackets that are one part of the old ones. Each part lies between two pivots, both of them values of the bracket."""
    key = [*groups, "lo", "hi"]
    brackets = wide.select(*key).distinct()
    inside = _with(counts, brackets, groups)
    cuts = inside.groupBy(*key).agg(F.array_distinct(F.percentile_approx("v", [k / pivots for k in range(1, pivots)], 100 * pivots)).alias("cuts"))
    cut = inside.alias("i").join(cuts.alias("k"), [_same(F.col(f"i.{c}"), F.col(f"k.{c}")) for c in key]).select("i.*", "k.cuts")
    part = F.size(F.filter("cuts", lambda p: p < F.col("v")))
    bins = cut.groupBy(*key, part.alias("bin")).agg(F.sum("c").alias("c"), F.count("*").alias("d"), F.min("v").alias("a"), F.max("v").alias("b"))
    before = F.sum("c").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    bins = bins.withColumn("before", before)
    within = F.col("t.rank") - F.col("t.below")
    hit = wide.alias("t").join(bins.alias("b"), [_same(F.col(f"t.{c}"), F.col(f"b.{c}")) for c in key] + [F.col("b.before") < within, within <= F.col("b.before") + F.col("b.c")])
    return hit.select(*[F.col(f"t.{g}").alias(g) for g in groups], "t.place", "t.part", "t.upper", "t.rank", F.col("b.d").alias("different"), F.col("b.a").alias("lo"), F.col("b.b").alias("hi"), (F.col("t.below") + F.col("b.before")).alias("below"))
