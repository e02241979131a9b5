"""Creations from traces, and what is measured of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CUTOFF, ZERO_ADDRESS
from ..functions.numbers import bin_label, bin_order, running, share, total


def trace_depth(trace_address: Column) -> Column:
    """Number of parts of a comma-separated address; 0 for null and empty."""
    return F.coalesce(F.array_size(F.split(F.nullif(trace_address, F.lit("")), ",")), F.lit(0))


def creations(traces: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Successful creations by contracts before the cutoff, one row each; ingested_at is the time of the run."""
    depth = trace_depth(F.col("trace_address"))
    kept = (F.col("trace_type") == "create") & (F.col("status") == 1) & F.col("to_address").isNotNull() & F.col("from_address").isNotNull() & (F.col("from_address") != ZERO_ADDRESS) & (F.col("block_timestamp") < F.to_timestamp(F.lit(cutoff))) & (depth >= 1)
    return traces.where(kept).select(
        "chain", F.lower("from_address").alias("factory_address"), F.lower("to_address").alias("created_contract_address"), "transaction_hash", "block_number", "block_timestamp", F.to_date("block_timestamp").alias("block_date"), "trace_address", depth.alias("trace_depth"),
        F.expr("try_cast(value AS DECIMAL(38, 9))").alias("value"), F.col("input").alias("init_code"), F.col("output").alias("runtime_code"), "gas", "gas_used", "status", F.current_timestamp().alias("ingested_at"),
    )


def write_creations(found: DataFrame, path: str) -> None:
    """Replaces the partitions of the chains and dates in found; others stay."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain", "block_date").parquet(path)


def daily_active_factories(made: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return made.where(F.col("block_date") < F.to_date(F.lit(cutoff))).groupBy("chain", "block_date").agg(F.countDistinct("factory_address").alias("active_factory_count"))


def daily_create_traces(made: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return made.where(F.col("block_date") < F.to_date(F.lit(cutoff))).groupBy("chain", "block_date").agg(F.count("*").alias("create_trace_count"))


def reuse_distribution(made: DataFrame) -> DataFrame:
    """How many runtime codes are used how often, with running shares."""
    codes = made.where(F.col("runtime_code").isNotNull() & (F.col("runtime_code") != "")).groupBy("chain", "runtime_code").agg(F.count("*").alias("contract_reuse_count"))
    groups = codes.groupBy("chain", "contract_reuse_count").agg(F.count("*").alias("runtime_group_count"), F.sum("contract_reuse_count").alias("contracts_in_group"))
    by = ("chain", "contract_reuse_count")
    out = groups.select("*", running("contracts_in_group", *by).alias("cumulative_contracts"), total("contracts_in_group", "chain").alias("total_contracts"), running("runtime_group_count", *by).alias("cumulative_runtime_groups"), total("runtime_group_count", "chain").alias("total_runtime_groups"))
    return out.withColumn("cumulative_contract_fraction", share(F.col("cumulative_contracts"), F.col("total_contracts"))).withColumn("cumulative_runtime_fraction", share(F.col("cumulative_runtime_groups"), F.col("total_runtime_groups")))


def activity_distribution(made: DataFrame) -> DataFrame:
    """How many factories created how many contracts, with running shares."""
    factories = made.groupBy("chain", "factory_address").agg(F.count("*").alias("create_count"))
    groups = factories.groupBy("chain", "create_count").agg(F.count("*").alias("factory_group_count"))
    out = groups.select("*", running("factory_group_count", "chain", "create_count").alias("cumulative_factories"), total("factory_group_count", "chain").alias("total_factories"))
    return out.withColumn("cumulative_fraction", share(F.col("cumulative_factories"), F.col("total_factories")))


def candidate_factories(traces: DataFrame, after: str, before: str, least: int = 2) -> DataFrame:
    """Senders of at least so many successful creations in the open interval; depth is not asked for."""
    kept = (F.col("trace_type") == "create") & (F.col("status") == 1) & F.col("from_address").isNotNull() & (F.col("from_address") != ZERO_ADDRESS) & (F.col("block_timestamp") > F.to_timestamp(F.lit(after))) & (F.col("block_timestamp") < F.to_timestamp(F.lit(before)))
    return traces.where(kept).groupBy(F.col("from_address").alias("factory_address")).agg(F.any_value("block_timestamp").alias("sample_timestamp"), F.count("*").alias("create_count")).where(F.col("create_count") >= least)


def address_summary(made: DataFrame) -> DataFrame:
    return made.groupBy("chain", F.lower("factory_address").alias("factory_address")).agg(F.count("*").alias("total_creations"), F.countDistinct("created_contract_address").alias("unique_creations"))


def lifespan(made: DataFrame, least: int = 1) -> DataFrame:
    out = made.groupBy("chain", F.lower("factory_address").alias("factory_address")).agg(F.count("*").alias("total_creations"), F.countDistinct("created_contract_address").alias("unique_creations"), F.min("block_date").alias("first_seen_date"), F.max("block_date").alias("last_seen_date"))
    return out.where(F.col("unique_creations") >= least)


def capped_cdf(dist: DataFrame, x: str, count: str, cap: float) -> DataFrame:
    """Counts by positive x to the cap, and the running share of what is under the cap."""
    sums = dist.groupBy("chain", F.col(x).alias("x")).agg(F.sum(count).alias("n")).where((F.col("x") > 0) & (F.col("x") <= cap))
    return sums.withColumn("cdf", share(running("n", "chain", "x"), total("n", "chain")))


def binned_cdf(dist: DataFrame, x: str, count: str) -> DataFrame:
    """Counts by bin, with every bin that any chain has, and the running share."""
    labelled = dist.select("chain", bin_label(F.col(x)).alias("bin"), bin_order(F.col(x)).alias("place"), F.col(count).alias("c"))
    sums = labelled.groupBy("chain", "bin", "place").agg(F.sum("c").alias("c"))
    frame = sums.select("chain").distinct().crossJoin(F.broadcast(sums.select("bin", "place").distinct()))  # chains x bins: a few rows
    filled = frame.join(sums, ["chain", "bin", "place"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    return filled.select("chain", "bin", "place", "n", F.coalesce(share(running("n", "chain", "place"), total("n", "chain")), F.lit(0.0)).alias("cdf"))


def axis_limits(series: DataFrame, value: str) -> DataFrame:
    """Bounds of a logarithmic axis for the values of all chains."""
    got = series.agg(F.max(value).alias("y_max"), F.min(F.when(F.col(value) > 0, F.col(value))).alias("least"))
    lower = F.when(F.col("least").isNull(), 0.0).when(F.col("least") >= 1, 1.0).otherwise(F.col("least").cast("double"))
    limit = F.when(F.col("y_max") > 0, F.col("y_max") * 1.1).otherwise(1.0)
    return got.select(lower.alias("lower_bound"), F.when(F.col("least").isNull(), limit).otherwise(F.greatest(limit, lower * 1.1)).alias("upper_bound"))


def cropped_series(series: DataFrame, value: str, cropped: str = "polygon") -> DataFrame:
    """The daily series; one chain's is cropped to the days between its first and last positive count."""
    w = Window.partitionBy("chain")
    day = F.when(F.col(value) > 0, F.col("block_date"))
    out = series.withColumn("lo", F.min(day).over(w)).withColumn("hi", F.max(day).over(w))
    return out.where((F.col("chain") != cropped) | F.col("lo").isNull() | F.col("block_date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def daily_type_counts(results: DataFrame) -> DataFrame:
    yes = results.where("is_factory")
    return yes.groupBy("chain", "deployment_date").agg(F.count("*").alias("total_factories"), F.count_if("is_create_only").alias("create_only"), F.count_if("is_create2_only").alias("create2_only"), F.count_if("is_both").alias("both"))
