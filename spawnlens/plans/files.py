"""Queries of readers, writers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import DDL, schema, stored_signature
from ..sources import files, views
from ..sources.views import sql
from ..streaming import jobs


def csv_quoted_split(spark, sf_dir):
    line = F.concat_ws(",", *[F.concat(F.lit('"'), x, F.lit('"')) for x in (F.sha2(F.col("p_partkey").cast("string"), 256), F.concat(F.lit("0x"), F.col("p_partkey").cast("string")), F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand")))])
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(F.col("p_partkey") % 10 == 0, F.lit('"only","two"')).otherwise(line).alias("value"))
    return files.parse_quoted(lines)


def source_packages(spark, sf_dir):
    """Packages with their text's length; empty ones are left out."""
    rows = views.sources(spark, sf_dir).where(F.element_at("files", 1)["content"] != "")
    return rows.select("chain", F.lower("address").alias("address"), F.size("files").cast("bigint").alias("n_files"), F.length(F.element_at("files", 1)["content"]).cast("bigint").alias("n_chars"))


def source_cache_write(spark, sf_dir):
    """What is read again after packages were written by chain."""
    path = jobs.scratch(spark, "packages")
    files.write_packages(views.sources(spark, sf_dir).select("chain", "address", "files"), path)
    return files.read_packages_cache(spark, path).select("chain", "address", F.element_at("files", 1)["path"].alias("path"))


def jsonl_tolerant(spark, sf_dir):
    """Times of JSON lines, some of which are broken."""
    line = F.when(F.col("event_id") % 7 == 0, F.lit('{"execution_time_ms": ')).otherwise(F.concat(F.lit('{"execution_time_ms": '), F.col("event_id").cast("string"), F.lit("}")))
    return files.parse_json_lines(views.events(spark, sf_dir).select(line.alias("value")), "execution_time_ms bigint")


def schema_signature(spark, sf_dir):
    """How stored tables of progress and results keep their declared schemas; a contract without code has no verdict, which results must have."""
    day = F.to_date("ts")
    progress = views.events(spark, sf_dir).select(
        F.when(F.col("user_id") % 2 == 0, "ethereum").otherwise("polygon").alias("chain"), day.alias("start_date"), F.date_add(day, 30).alias("end_date"), F.col("event_type").alias("status"),
        (F.col("event_id") * 3).alias("contracts_processed"), F.lit(None).cast("int").alias("factories_found"), F.when(F.col("event_id") % 5 > 0, F.col("event_id")).alias("processing_time_ms"), F.col("ts").cast("timestamp").alias("updated_at"))
    results = views.contracts(spark, sf_dir).select("chain", "address", (F.length("code") > 100).alias("is_factory"), F.lit(True).alias("analysis_success"), (F.col("block_number") % 97).alias("analysis_time"), F.col("block_timestamp").alias("processed_at"))
    out = [stored_signature(schema(name), jobs.keep(rows)).select(F.lit(name).alias("table_name"), "*") for name, rows in (("progress", progress), ("results", results))]
    return out[0].unionByName(out[1])


def _stream(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one_file = events.inputFiles()[0].endswith("/events.parquet")  # a stream reads folders
    source = spark.readStream.schema(events.schema)
    stream = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else source.parquet(f"{sf_dir}/events.parquet")
    return stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("block_timestamp"), "event_type")


def stream_daily_counts(spark, sf_dir):
    """Daily counts of a stream over all that there is, with a checkpoint."""
    path = jobs.scratch(spark, "daily")
    jobs.run_available(jobs.daily_counts(_stream(spark, sf_dir), by=("event_type",)), path, f"{path}-state", "complete")
    return spark.read.parquet(path)


def stream_first_of_each(spark, sf_dir):
    """Users of a stream, each once within the watermark, which is wider than the data."""
    path = jobs.scratch(spark, "first")
    jobs.run_available(jobs.first_of_each(_stream(spark, sf_dir), ["user_id"], late="3650 days"), path, f"{path}-state")
    return spark.read.parquet(path).select("user_id")


QUERIES = {f.__name__: f for f in (csv_quoted_split, source_packages, source_cache_write, jsonl_tolerant, schema_signature, stream_daily_counts, stream_first_of_each)}

#: Columns with their types as stored, their modes, and SQL for the rows in which they are null.
_STORED = [
    ("progress", c.split()[0], "int" if c.startswith("factories_found") else c.split()[1], "REQUIRED" if c.endswith("NOT NULL") else "NULLABLE", {"factories_found": "true", "processing_time_ms": "event_id % 5 = 0"}.get(c.split()[0], "false"), c.startswith("factories_found")) for c in DDL["progress"].split(", ")
] + [
    ("results", c.split()[0], None if c.split()[0] in ("is_create", "is_create2", "is_both") else c.split()[1], "REQUIRED" if c.endswith("NOT NULL") else "NULLABLE", {"is_factory": "code IS NULL", "is_create": "true", "is_create2": "true", "is_both": "true"}.get(c.split()[0], "false"), c.split()[0] in ("is_create", "is_create2", "is_both")) for c in DDL["results"].split(", ")
]


def _stored_sql(table: str, column: str, kind: str | None, mode: str, null: str, other: bool) -> str:
    nulls = f"count(*) FILTER ({null})"
    differs = "true" if other else f"{nulls} > 0" if mode == "REQUIRED" else "false"
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, {f"'{kind}'" if kind else 'NULL::VARCHAR'} AS type, '{mode}' AS mode, count(*) AS n_rows, {nulls} AS n_nulls, {differs} AS differs FROM {'events' if table == 'progress' else 'v_contracts'}"


ORACLE_SQL = {
    "csv_quoted_split": "SELECT '0x' || p_partkey AS address, p_name || ', ' || p_brand AS name FROM part WHERE p_partkey % 10 <> 0",
    "source_packages": sql("SELECT chain, lower(address) AS address, CAST(1 AS BIGINT) AS n_files, CAST(length(content) AS BIGINT) AS n_chars FROM v_sources WHERE content <> ''", "sources"),
    "source_cache_write": sql("SELECT chain, address, path FROM v_sources", "sources"),
    "jsonl_tolerant": "SELECT event_id AS execution_time_ms FROM events WHERE event_id % 7 <> 0",
    "schema_signature": sql("SELECT * FROM (" + " UNION ALL ".join(_stored_sql(*r) for r in _STORED) + ")", "contracts"),
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_first_of_each": "SELECT DISTINCT user_id FROM events",
}
