"""Streaming forms: daily counts, deduplication, and incremental detection with a checkpoint."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evm
from ..operators import kernel
from ..operators.bytecode import codes_once, distinct_codes
from ..operators.scans import only_new
from ..operators.skew import keyed_join
from ..sources.files import append_results, exists


def daily_counts(stream: DataFrame, at: str = "block_timestamp", by: tuple[str, ...] = ("chain",), late: str = "1 day") -> DataFrame:
    """Rows by day; what comes later than the watermark is left out, state is as large as the open days."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def first_of_each(stream: DataFrame, keys: list[str], at: str = "block_timestamp", late: str = "1 day") -> DataFrame:
    """One row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a later call goes on from the checkpoint."""
    if mode == "complete":
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    else:
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path)
    query.awaitTermination()


def detect_incrementally(contracts: DataFrame, results_path: str, checkpoint: str) -> None:
    """Detects codes of new contracts that have no result of their hash yet, and appends; running it twice adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        codes = distinct_codes(df)
        try:
            codes = only_new(codes, spark.read.parquet(results_path), "bytecode_hash")
        except Exception as e:  # the table is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        kernel.verdicts(codes).drop("code").write.mode("append").parquet(results_path)

    contracts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()


def detect_in_batches(contracts: DataFrame, path: str, batches: int = 8, enhanced: bool = False) -> int:
    """Detects contracts (chain, address, code) batch by batch into the results table at path, one row of each chain and address: chain, address, bytecode_hash, is_factory,
    factory_type, error. Batches are cut by a hash of the address and published whole under their names, so that a run that is lost goes on with the batches that are not
    there, and a run over a finished table does nothing; the number of batches worked through.

    Each contract's digest and each code's verdict is made once, for all batches that are not there; digests and verdicts, without codes, are written to the shared folder.

    `batches` must stay the same for a table. Addresses that came later are in batches that were published: give these contracts a path of their own, or use
    detect_incrementally().
    """
    spark, done = contracts.sparkSession, 0
    names = {k: f"{k}of{batches}" for k in range(batches)}
    left = [k for k in names if not exists(spark, f"{path}/batch={names[k]}")]
    if not left:
        return 0
    batch = F.pmod(F.xxhash64("address"), F.lit(batches))
    rows = contracts.where(batch.isin(left) & F.col("code").isNotNull())
    hashed = keep(rows.select("chain", "address", evm.bytecode_hash(F.col("code")).alias("bytecode_hash"), batch.alias("_batch")))
    found = keep(kernel.verdicts(codes_once(rows, ["chain", "address"], keep), enhanced=enhanced).select("bytecode_hash", "is_factory", "factory_type", "error"))
    for k in left:
        own = hashed.where(F.col("_batch") == k).drop("_batch")
        done += append_results(keyed_join(own, found, "bytecode_hash").select("chain", "address", "bytecode_hash", "is_factory", "factory_type", "error"), path, names[k])
    return done


class PeriodsFailed(RuntimeError):
    """Some periods failed after all others were worked through: errors is {(chain, start, end): error}."""

    def __init__(self, done: int, errors: dict):
        super().__init__(f"{len(errors)} periods failed, {done} completed: " + "; ".join(f"{c} {s} to {e}: {x}" for (c, s, e), x in list(errors.items())[:5]))
        self.done, self.errors = done, errors


def process_periods(periods: DataFrame, log_path: str, work) -> int:
    """Works through planned periods (chain, start_date, end_date) that the log at log_path does not call completed, and logs each as in_progress, then
    completed or failed; the number completed. work(chain, start, end) gives (contracts, factories).

    A failed period does not stop the others; after the last, PeriodsFailed says which failed, and a later call tries these again. Periods are few, months of
    chains; the rows of a period are the cluster's work, not the loop's.
    """
    spark, done, errors = periods.sparkSession, 0, {}
    schema = "chain string, start_date date, end_date date, status string, contracts_processed bigint, factories_found bigint, processing_time_ms bigint, updated_at timestamp"

    def log(p, status: str, contracts: int | None = None, factories: int | None = None, ms: int | None = None) -> None:
        row = spark.createDataFrame([(p["chain"], p["start_date"], p["end_date"], status, contracts, factories, ms, None)], schema)
        row.withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(log_path)

    before = read_log(spark, log_path)
    if before is not None:
        periods = only_new(periods, before.where("status = 'completed'"), "chain", "start_date", "end_date")
    for p in periods.orderBy("chain", "end_date").collect():
        log(p, "in_progress")
        began = time.monotonic()
        try:
            contracts, factories = work(p["chain"], p["start_date"], p["end_date"])
        except Exception as e:  # any work may fail in its own way; it is logged, and told at the end
            log(p, "failed")
            errors[p["chain"], p["start_date"], p["end_date"]] = e
            continue
        log(p, "completed", contracts, factories, round(1000 * (time.monotonic() - began)))
        done += 1
    if errors:
        raise PeriodsFailed(done, errors)
    return done


def read_log(spark: SparkSession, log_path: str) -> DataFrame | None:
    """The progress log, or None before its first row."""
    try:
        return spark.read.parquet(log_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; the warehouse if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes df to a new folder of the shared one and reads it again: cuts lineage, so that lost executors and later rounds recompute nothing before it."""
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
