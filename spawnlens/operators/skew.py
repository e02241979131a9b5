"""Joins whose left side may hold a third or nine tenths of its rows in a few keys.

A sketch of bounded size, merged over tasks, names the keys that are frequent on the left. Their rows on the right, one a key, are broadcast, so that the
frequent left rows stay in the tasks that read them, and only the others are shuffled. Nothing is sampled away: both parts together are the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent keys at most, so also rows that are broadcast at most; items that the sketch keeps; share of all rows from which a key is frequent.
HEAVY, TRACKED, SHARE = 128, 10_000, 0.002
#: Rows of a task whose rows take long.
SLOW = 1 << 13


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE, most: int = HEAVY) -> list:
    """Keys that hold at least `share` of the rows by a frequent-items sketch, most first; null is never one. A sketch of TRACKED items misses no key of over
    about 1 / TRACKED of the rows; what it counts decides only which way a key's rows go, not the result."""
    known = rows.where(F.col(key).isNotNull())
    found = known.agg(F.count("*").alias("n"), F.expr(f"approx_top_k({key}, {most}, {TRACKED})").alias("top")).first()
    return [t["item"] for t in found["top"] or [] if t["count"] >= share * found["n"]]


def split(rows: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """The rows of the frequent keys, and all others."""
    frequent = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    return rows.where(frequent), rows.where(~frequent)


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE, most: int = HEAVY, seen: DataFrame | None = None) -> DataFrame:
    """left joined with right on key; how: inner, left, left_semi or left_anti. right holds each key once.

    seen: rows with the key that the sketch reads instead of left, where they are cheaper to make. The sketch is a job of its own, run now.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no join of this kind: {how}")
    heavy = heavy_keys(left if seen is None else seen, key, share, most)
    if not heavy:
        return left.join(right, key, how)
    (often, rest), (few, others) = split(left, key, heavy), split(right, key, heavy)
    return often.join(F.broadcast(few), key, how).unionByName(rest.join(others, key, how))


def spread(rows: DataFrame, at_once: int = SLOW) -> DataFrame:
    """Rows that take long each, dealt to tasks of `at_once`, or to all cores if there are fewer: a small file of many rows is else read and worked through by few tasks.
    Rows are counted for it, which reads no column of a stored table."""
    return rows.repartition(max(1, -(-rows.count() // at_once), rows.sparkSession.sparkContext.defaultParallelism))


def rows_by_task(rows: DataFrame) -> list[int]:
    """Rows in each task that has any, for a look at how even a plan is; one number a task reaches the driver."""
    return [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]

