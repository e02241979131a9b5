"""Detector evaluation: confusion matrix, rates, error slices and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evm, notes
from . import bytecode as B
from .order import numbered, repeated, running


def outcome(truth: Column, detected: Column) -> Column:
    return F.when(truth & detected, "TP").when(~truth & detected, "FP").when(truth & ~detected, "FN").when(~truth & ~detected, "TN")


def confusion(rows: DataFrame, truth: str = "is_factory_ground_truth", detected: str = "is_factory_detected", time: str = "execution_time") -> DataFrame:
    """Counts of outcomes, precision, recall, F1 and accuracy, and times; rates with nothing to divide by are 0."""
    o = outcome(F.col(truth), F.col(detected))
    c = rows.where(F.col(detected).isNotNull()).agg(*[F.count_if(o == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")], F.avg(time).alias("avg_time"), F.sum(time).alias("total_time"), F.count("*").alias("n"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", div(F.col("tp") + F.col("tn"), F.col("n")))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences of two one-row results of confusion()."""
    measures = ["precision", "recall", "f1", "accuracy"]
    a = first.select(*[F.col(m).alias(f"a_{m}") for m in (*measures, "fp", "fn")])
    b = second.select(*[F.col(m).alias(f"b_{m}") for m in (*measures, "fp", "fn")])
    return a.crossJoin(b).select(*[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"{m}_change") for m in measures], (F.col("a_fp") - F.col("b_fp")).alias("fp_reduction"), (F.col("a_fn") - F.col("b_fn")).alias("fn_reduction"))  # one row each


def with_outcome(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outcome", outcome(F.col("is_factory_ground_truth"), F.col("is_factory_detected")))


def upper_median(rows: DataFrame, col: str) -> DataFrame:
    """The element in the upper middle of the sorted values, from counts by value, so that no list of all values is made."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    placed, n = running(counts, ["v"], F.col("c"), "upto"), counts.agg(F.sum("c").alias("n"))
    return placed.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("v").alias("median"))  # one row


def size_class(x: Column) -> Column:
    return F.when(x <= 100, "up to 100").when(x <= 1000, "101-1000").when(x <= 10000, "1001-10000").otherwise("over 10000")


def ecdf(rows: DataFrame, col: str) -> DataFrame:
    """Each row's value and (i + 1) / n, i being its place in the sorted values; ties have places of their own. Sorted and summed are the different values only."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    all_of = counts.agg(F.sum("n").alias("all"))
    each = repeated(running(counts, ["value"], F.col("n"), "upto"), "n", "j").crossJoin(F.broadcast(all_of))  # one row
    return each.select("value", ((F.col("upto") - F.col("n") + F.col("j") + 1) / F.col("all")).alias("cdf"))


def histogram(rows: DataFrame, col: str, width: float, cap: float) -> DataFrame:
    """Counts of bins of the width up to the cap or the largest value, whichever is less; the last bin is closed."""
    top = rows.agg(F.least(F.max(col).cast("double"), F.lit(cap)).alias("top"))
    seen = rows.crossJoin(F.broadcast(top)).where((F.col(col) >= 0) & (F.col(col) <= F.col("top")))  # one row
    last = F.greatest(F.ceil(F.col("top") / width) - 1, F.lit(0))
    return seen.groupBy(F.least(F.floor(F.col(col) / width), last).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def explanations(rows: DataFrame) -> DataFrame:
    """Why factories were missed, by id: from the code's bytes and blocks."""
    blocks = B.reachability(B.block_rows(B.with_blocks(B.instruction_rows(B.distinct_codes(rows, "bytecode")))))
    held = blocks.where("contains_create or contains_create2").groupBy("bytecode_hash").agg(F.count("*").alias("blocks"), F.count_if("reachable").alias("reached"))
    text = F.lower(evm.strip_0x(F.col("bytecode")))
    bytes_ = evm.naive_count(text, "f0") + evm.naive_count(text, "f5")
    joined = rows.where(F.col("bytecode").isNotNull()).withColumn("bytecode_hash", evm.bytecode_hash(F.col("bytecode"))).join(held, "bytecode_hash", "left")
    why = F.when(bytes_ == 0, "no creation bytes: a proxy or another contract creates").when(F.col("blocks").isNull(), "bytes in operands only").when(F.col("reached") == 0, "creating blocks are unreachable").otherwise("should have been found")
    return joined.select("id", why.alias("why"))


def error_table(rows: DataFrame, wanted: str) -> DataFrame:
    """The exported table of one kind of error, numbered by address."""
    kept = numbered(with_outcome(rows).where(F.col("outcome") == wanted), ["address", "id"])
    text = F.lower(evm.strip_0x(F.col("bytecode")))
    if wanted == "FP":
        return kept.select("no", "address", notes.contract_name(F.col("verification_notes")).alias("name"), "factory_type", "create_positions", "execution_time")
    executed = F.coalesce(F.format_number(notes.executed_count(F.col("verification_notes")), 0), F.lit("Unknown"))
    return kept.select("no", "address", executed.alias("executed"), evm.naive_count(text, "f0").alias("create_bytes"), evm.naive_count(text, "f5").alias("create2_bytes"), notes.is_vanity(F.col("address")).alias("vanity"), "execution_time")
