"""Bins, bounds and ratios."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Single bins to 20, then upper ends and labels of wider ones; larger values share the last.
WIDE_BINS = [(50, "21-50"), (100, "51-100"), (200, "101-200"), (500, "201-500"), (1_000, "501-1k"), (2_000, "1k-2k"), (5_000, "2k-5k"), (10_000, "5k-10k"), (50_000, "10k-50k"), (100_000, "50k-100k"), (500_000, "100k-500k"), (1_000_000, "500k-1M"), (2_000_000, "1M-2M"), (5_000_000, "2M-5M")]
LAST_BIN = ">5M"
BINS = [(k, k, str(k)) for k in range(1, 21)] + [(lo + 1, hi, label) for (lo, _), (hi, label) in zip([(20, ""), *WIDE_BINS], WIDE_BINS, strict=False)]


def bin_label(x: Column) -> Column:
    """The label of the bin; what lies between two bins, or in none, has the last one's."""
    out = F.lit(LAST_BIN)
    for lo, hi, label in reversed(BINS):
        out = F.when(x.between(lo, hi), label).otherwise(out)
    return out


def bin_order(x: Column) -> Column:
    out = F.lit(len(BINS))
    for k, (lo, hi, _) in reversed(list(enumerate(BINS))):
        out = F.when(x.between(lo, hi), k).otherwise(out)
    return out


def nice_upper_bound(x: Column) -> Column:
    """The least of 1, 2, 5, 10 times a power of ten that is not under x; 1 for what is not positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    scaled = x / base
    step = F.when(scaled <= 1, 1).when(scaled <= 2, 2).when(scaled <= 5, 5).otherwise(10)
    return F.when(x <= 0, F.lit(1.0)).otherwise(step * base)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null if whole is 0."""
    return F.try_divide(part, whole)


def running(col: str, by: str, order: str) -> Column:
    return F.sum(col).over(Window.partitionBy(by).orderBy(order))


def total(col: str, by: str) -> Column:
    return F.sum(col).over(Window.partitionBy(by))
