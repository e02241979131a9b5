"""Running sums and row numbers over a whole table without one task for all of it.

Rows are cut into ranges by bounds of the first ordering column, which are taken from a sample of bounded size. Each range is summed by itself, in a
window partitioned by range, and what stands before it, a number for each range, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are cut into, and rows of the sample that their bounds are taken from.
RANGES, SAMPLE = 64, 1 << 13


def bounds(rows: DataFrame, col: str, ranges: int = RANGES, sample: int = SAMPLE) -> list:
    """At most ranges - 1 values that cut the column's values into ranges of like size; fewer if there are few values."""
    least = rows.where(F.col(col).isNotNull()).select(col).orderBy(F.xxhash64(col), col).limit(sample).collect()
    values = sorted(r[0] for r in least)
    return sorted({values[len(values) * k // ranges] for k in range(1, ranges)}) if values else []


def running(rows: DataFrame, order: list[str], size: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds the sum of size over all rows up to and with this one, in the order of the columns (ascending, nulls first). The columns must order rows fully."""
    cuts = bounds(rows, order[0], ranges)
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    cut = rows.withColumn("_range", F.coalesce(place, F.lit(0))).withColumn("_size", size)
    totals = {r["_range"]: r["n"] for r in cut.groupBy("_range").agg(F.sum("_size").alias("n")).collect()}  # a row for each range
    before, at = [], 0
    for k in range(len(cuts) + 1):
        before.append(F.lit(at))
        at += totals.get(k, 0)
    inside = F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn(name, inside + F.element_at(F.array(*before), F.col("_range") + 1)).drop("_range", "_size")


def numbered(rows: DataFrame, order: list[str], name: str = "no", ranges: int = RANGES) -> DataFrame:
    """Adds the row's number in the order of the columns, from 1."""
    return running(rows, order, F.lit(1).cast("bigint"), name, ranges)


def repeated(rows: DataFrame, times: str, name: str, at_once: int = 1024) -> DataFrame:
    """Each row as often as `times` says, with its number from 0. Numbers are dealt in blocks, so that no array holds all of a frequent row's."""
    blocks = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(at_once).cast("bigint"))))
    return blocks.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + at_once, F.col(times)) - 1))).drop("_from")
