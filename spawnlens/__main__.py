"""Command line: python -m spawnlens {scan,detect,traces,metrics,evaluate,plan,cluster} --help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CHAINS, CUTOFF
from .operators import clustering, evaluation, kernel, scans, traces
from .operators.bytecode import distinct_codes
from .functions import evm, source_features
from .session import session
from .sources import files


class Planned(Exception):
    """A dry run has shown its plan."""


def planned(a, rows: DataFrame) -> DataFrame:
    """rows, or in a dry run only their plan: nothing is run or written then."""
    if a.dry_run:
        rows.explain("formatted")
        raise Planned
    return rows


def scan(spark: SparkSession, a) -> DataFrame:
    """Contracts of active chains between --start and --cutoff, each chain by its kind of tables in input/<chain>/: contracts, or transactions and receipts."""
    wanted, out = a.chains.split(","), None
    for chain, kind, _, status in CHAINS:
        if chain in wanted and status == "active":
            tables = {name: lambda path=f"{a.input}/{chain}/{name}.parquet": spark.read.parquet(path) for name in ("contracts", "transactions", "receipts")}
            found = scans.scan_chain(kind, tables, a.start, a.cutoff).withColumn("chain", F.lit(chain))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"no active chain among {a.chains}")
    rows = planned(a, scans.good(scans.normalised(out)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain").parquet(a.out)
    return scans.last_block(spark.read.parquet(a.out))


def detect(spark: SparkSession, a) -> DataFrame:
    """Verdicts of contracts (chain, address, code, ...), one analysis for each distinct code that has none in --out yet."""
    contracts = spark.read.parquet(a.input).where(F.col("block_timestamp") < F.to_timestamp(F.lit(a.cutoff)))
    found = kernel.verdicts(distinct_codes(contracts), enhanced=a.enhanced, longest=a.longest).drop("code")
    rows = contracts.withColumn("bytecode_hash", evm.bytecode_hash(F.col("code"))).drop("code").join(found, "bytecode_hash")
    if a.resume:
        rows = scans.only_new(rows, spark.read.parquet(a.resume), "chain", "address")
    files.append_results(planned(a, rows), a.out)
    return files.read_results(spark, a.out).withColumns(scans.exclusive_flags(F.col("factory_type"))).withColumn("execution_time_ms", F.lit(None).cast("double")).transform(scans.result_summary)


def trace(spark: SparkSession, a) -> DataFrame:
    """Creations from traces, by chain and date; partitions that are there are replaced."""
    traces.write_creations(planned(a, traces.creations(spark.read.parquet(a.input), a.cutoff)), a.out)
    return spark.read.parquet(a.out).groupBy("chain").count()


def metrics(spark: SparkSession, a) -> DataFrame:
    """The four tables of creations, as CSV."""
    made = spark.read.parquet(a.input)
    out = {"daily_active_factories": traces.daily_active_factories(made, a.cutoff), "daily_factory_create_traces": traces.daily_create_traces(made, a.cutoff), "bytecode_reuse_distribution": traces.reuse_distribution(made), "factory_activity_distribution": traces.activity_distribution(made)}
    for name, df in out.items():
        files.export_csv(planned(a, df.orderBy(*df.columns[:2])), f"{a.out}/{name}")
    return traces.lifespan(made).groupBy("chain").agg(F.count("*").alias("factories"), F.min("first_seen_date").alias("first"), F.max("last_seen_date").alias("last"))


def evaluate(spark: SparkSession, a) -> DataFrame:
    """Confusion matrix of a table with is_factory_ground_truth and, unless it has is_factory_detected, bytecode."""
    rows = spark.read.parquet(a.input)
    if "is_factory_detected" not in rows.columns:
        found = kernel.verdicts(distinct_codes(rows, "bytecode"), enhanced=a.enhanced).select(F.col("bytecode_hash").alias("h"), F.col("is_factory").alias("is_factory_detected"))
        rows = rows.withColumn("h", evm.bytecode_hash(F.col("bytecode"))).join(found, "h", "left").drop("h")
    if "execution_time" not in rows.columns:
        rows = rows.withColumn("execution_time", F.lit(None).cast("bigint"))
    files.export_json(planned(a, rows).drop("bytecode"), a.out)
    measures = evaluation.confusion(rows)
    files.export_summary(measures, f"{a.out}-summary", detector="enhanced" if a.enhanced else "baseline", input=a.input)
    return measures


def plan(spark: SparkSession, a) -> DataFrame:
    """Addresses whose sources are still to be fetched."""
    wanted = files.read_factory_addresses(spark, a.input, a.chains.split(","))
    if a.top:
        wanted = scans.top_per_chain(wanted, a.top)
    left = scans.fetch_plan(wanted, files.read_packages(spark, a.sources), factory=True)
    files.export_csv(planned(a, left), a.out)
    return left.groupBy("chain").count()


def cluster(spark: SparkSession, a) -> DataFrame:
    """Clusters of source packages by their features: standardised, rotated components, k-means."""
    text = files.read_packages(spark, a.input).select("chain", "address", source_features.joined_text(F.col("files")).alias("text")).where("text <> ''")
    found = source_features.all_features(F.col("text"))
    rows = planned(a, text.select("chain", "address", F.array(*found.values()).alias("x")))
    scored = clustering.varimax_scores(clustering.standardise(rows), min(12, len(found))).drop("x").withColumnRenamed("scores", "x")
    labelled = clustering.kmeans(scored, a.k)
    files.export_json(labelled.select("chain", "address", "label"), a.out)
    return clustering.summary(labelled)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    parser = argparse.ArgumentParser(prog="spawnlens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("scan", scan), ("detect", detect), ("traces", trace), ("metrics", metrics), ("evaluate", evaluate), ("plan", plan), ("cluster", cluster)):
        p = commands.add_parser(name, help=run.__doc__)
        p.add_argument("input")
        p.add_argument("out")
        p.add_argument("--cutoff", default=CUTOFF)
        p.add_argument("--start", default="2015-01-01")
        p.add_argument("--longest", type=int, help="characters of a code that is analysed; longer ones count as timed out")
        p.add_argument("--enhanced", action="store_true")
        p.add_argument("--resume", help="a table of results whose addresses are passed over")
        p.add_argument("--chains", default="ethereum,polygon")
        p.add_argument("--sources", default="sources")
        p.add_argument("--top", type=int)
        p.add_argument("-k", type=int, default=4)
        p.add_argument("--explain", action="store_true", help="prints the plan of the result as well")
        p.add_argument("--dry-run", action="store_true", help="prints the plan of what would be written, and runs and writes nothing")
        p.set_defaults(run=run)
    a = parser.parse_args(argv)
    try:
        out = a.run(spark or session(), a)
    except Planned:
        return []
    if a.explain:
        out.explain("formatted")
    rows = [r.asDict(recursive=True) for r in out.collect()]  # a summary of a few rows
    for r in rows:
        print(json.dumps(r, default=str))
    return rows


if __name__ == "__main__":
    main(sys.argv[1:])
