"""Pages of a table by key, so that a page reads its own range and not all that stands before it.

The index has a row for each page: its number, first and last key, and rows. It is made once, from exact row numbers by ranges (no task holds
the table), and kept beside the table, which is stored in the keys' order, so that a page's bounds pass over the row groups that it does not need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def index(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """page (from 0), first and last (structs of the keys), n. The keys must tell rows apart and not be null."""
    page = F.floor((F.col("_no") - 1) / size).cast("long").alias("page")
    key = F.struct(*keys)
    return numbered(rows.select(*keys), keys, "_no").groupBy(page).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def store(rows: DataFrame, keys: list[str], path: str, size: int) -> DataFrame:
    """Writes rows in the keys' order, in files by range, with the index beside them; returns the index."""
    spark = rows.sparkSession
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    index(stored, keys, size).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def _after(keys: list[str], bound: tuple, strict_last: bool, up: bool) -> Column:
    """Rows whose keys are, in order, at or beyond the bound: the first key's own bound is said apart, since it is what a scan can use."""
    beyond = (lambda c, v: c > v) if up else (lambda c, v: c < v)
    or_equal = (lambda c, v: c >= v) if up else (lambda c, v: c <= v)
    terms = []
    for k, (name, value) in enumerate(zip(keys, bound, strict=True)):
        c, v = F.col(name), F.lit(value)
        last = k == len(keys) - 1
        here = or_equal(c, v) if last and not strict_last else beyond(c, v)
        terms.append(reduce(lambda a, b: a & b, [F.col(x) == F.lit(y) for x, y in zip(keys[:k], bound[:k], strict=True)], here))
    return or_equal(F.col(keys[0]), F.lit(bound[0])) & reduce(lambda a, b: a | b, terms)


def between(rows: DataFrame, keys: list[str], first: tuple, last: tuple) -> DataFrame:
    """Rows from the first key up to and with the last."""
    return rows.where(_after(keys, first, False, True) & _after(keys, last, False, False))


def read_page(rows: DataFrame, keys: list[str], pages: DataFrame, page: int) -> DataFrame:
    """The rows of one page; none if there is no such page. One row of the index reaches the driver."""
    found = pages.where(F.col("page") == page).first()
    return rows.where(F.lit(False)) if found is None else between(rows, keys, tuple(found["first"]), tuple(found["last"]))


def next_page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The `size` rows that follow a key, without an index: sorted and limited in tasks first."""
    return (rows if after is None else rows.where(_after(keys, after, True, True))).orderBy(*keys).limit(size)
