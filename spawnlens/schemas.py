"""Declared schemas of the tables, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names and types of the tables.
CONTRACTS = "chain string, address string, bytecode string, block_timestamp timestamp, block_number bigint, transaction_hash string"
TRACES = "chain string, trace_type string, status bigint, from_address string, to_address string, transaction_hash string, block_number bigint, block_timestamp timestamp, trace_address string, value string, input string, output string, gas bigint, gas_used bigint"
RESULTS = "chain string NOT NULL, address string NOT NULL, is_factory boolean NOT NULL, is_create boolean, is_create2 boolean, is_both boolean, analysis_success boolean NOT NULL, analysis_time bigint, processed_at timestamp NOT NULL"
PROGRESS = "chain string NOT NULL, start_date date NOT NULL, end_date date NOT NULL, status string NOT NULL, contracts_processed bigint, factories_found bigint, processing_time_ms bigint, updated_at timestamp NOT NULL"
GROUND_TRUTH = "address string, bytecode string, is_factory_ground_truth boolean, is_factory_detected boolean, execution_time bigint, source_type string, verification_notes string, created_at timestamp"
FACTORY_ADDRESSES = "chain string, factory_address string, total_creations string, unique_creations string"
SOURCE_PACKAGE = "chain string, address string, source_status string, compiler string, evm_version string, verified_at string, origin string, files array<struct<path: string, content: string>>"

DDL = {"contracts": CONTRACTS, "traces": TRACES, "results": RESULTS, "progress": PROGRESS, "ground_truth": GROUND_TRUTH, "factory_addresses": FACTORY_ADDRESSES, "source_package": SOURCE_PACKAGE}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def signature(schema: StructType) -> list[tuple[str, str, str]]:
    """(name, type, mode) of each column; a table is made anew if this changes."""
    return [(f.name, f.dataType.simpleString(), "NULLABLE" if f.nullable else "REQUIRED") for f in schema.fields]


def stored_signature(declared: StructType, stored: DataFrame) -> DataFrame:
    """column_name, type, mode, n_rows, n_nulls and differs for each declared column: how a stored table holds it. A column differs if it is absent, of another type, or
    has nulls where it must not; files do not keep whether a column may be null, so rows are counted."""
    found = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    nulls = [F.count_if(F.col(f.name).isNull() if f.name in found else F.lit(True)).alias(f.name) for f in declared.fields]
    one = stored.agg(F.count("*").alias("n_rows"), F.struct(*nulls).alias("nulls"))
    rows = [
        F.struct(F.lit(name).alias("column_name"), F.lit(found.get(name)).alias("type"), F.lit(mode).alias("mode"), F.col("n_rows"), F.col("nulls")[name].alias("n_nulls"),
                 (F.lit(found.get(name) != kind) | (F.lit(mode == "REQUIRED") & (F.col("nulls")[name] > 0))).alias("differs"))
        for name, kind, mode in signature(declared)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def must_recreate(declared: StructType, found: StructType) -> bool:
    return signature(declared) != signature(found)


