"""Readers and writers of files: quoted CSV, source packages, JSON lines, results and progress."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import schema as schema_of

VERIFIED = "tx string, address string, name string"


def parse_quoted(lines: DataFrame, col: str = "value") -> DataFrame:
    """address and name of lines with three quoted fields or more; commas inside quotes belong to their field."""
    fields = F.from_csv(F.col(col), F.lit(VERIFIED), {"quote": '"', "escape": '"'})
    return lines.select(fields.alias("f")).where("f.address IS NOT NULL AND f.name IS NOT NULL").select("f.address", "f.name")


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """A list of verified contracts: the first two lines of each file, a note and a header, are left out. A file of the list is read whole."""
    lines = F.slice(F.split("value", "\r?\n"), 3, 1 << 30)
    return parse_quoted(spark.read.text(path, wholetext=True).select(F.explode(lines).alias("value")).where("value <> ''"))


def read_factory_addresses(spark: SparkSession, path: str, chains: list[str]) -> DataFrame:
    """The address list of the chains; missing count columns are null, addresses in lower case."""
    rows = spark.read.option("header", True).csv(path)
    for c in ("total_creations", "unique_creations", "first_seen_date", "last_seen_date"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.where(F.col("chain").isin(chains)).withColumn("factory_address", F.lower("factory_address"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a CSV file's factory_address column, else its first, or of a text file's lines."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        col = "factory_address" if "factory_address" in rows.columns else rows.columns[0]
        return rows.select(F.trim(col).alias("address")).where("address <> ''")
    return spark.read.text(path).select(F.trim("value").alias("address")).where("address <> ''")


def read_packages(spark: SparkSession, root: str) -> DataFrame:
    """Source packages of root/<chain>/<address>.json. Documents that are no JSON are left out; the folder gives the chain, the file name a missing address."""
    rows = spark.read.schema(schema_of("source_package")).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/*.json").withColumn("_p", F.input_file_name())
    address = F.coalesce(F.nullif("address", F.lit("")), F.regexp_extract("_p", r"([^/]+)\.json$", 1))
    return rows.withColumn("address", F.lower(address)).withColumn("chain", F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1)).drop("_p")


def bad_packages(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the documents that read_packages leaves out, as they are no JSON."""
    texts = spark.read.text(f"{root}/*/*.json", wholetext=True).select(F.input_file_name().alias("path"), F.expr("try_parse_json(value)").alias("v"))
    return texts.where("v IS NULL").select("path")


def write_packages(packages: DataFrame, path: str) -> None:
    """Packages with files, as JSON by chain."""
    packages.where(F.size("files") > 0).write.mode("overwrite").partitionBy("chain").json(path)


def read_packages_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema_of("source_package")).json(path)


def parse_json_lines(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """Lines that are JSON; others are left out."""
    parsed = F.from_json(col, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("j")).where("j._bad IS NULL AND j IS NOT NULL").select("j.*").drop("_bad")


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The results with all columns that any append had, or None if there are none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_results(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds one row of each chain and address that the table has not yet, so that an append that is run again adds nothing; null keys equal each other. Rows may have
    columns that the table lacks.

    With the name of a batch (then all rows of the table must come in batches) the rows are staged in a folder of their own and then published by renaming it to `batch=<name>` in the table: a job that is
    lost before that leaves nothing that readers see, and a batch is published once, by whoever renames first; False if it was there before. Writers of different
    batches that run at once may both add an address; scans.last_of_each() then reads one of them.
    """
    spark = rows.sparkSession
    if batch is not None and not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a name of a batch: {batch}")
    if batch is not None and exists(spark, f"{path}/batch={batch}"):
        return False
    new, before = rows.dropDuplicates(["chain", "address"]), read_results(spark, path)
    if before is not None:
        known = before.select(F.col("chain").alias("_chain"), F.col("address").alias("_address"))
        new = new.join(known, F.col("chain").eqNullSafe(F.col("_chain")) & F.col("address").eqNullSafe(F.col("_address")), "left_anti")
    if batch is None:
        new.write.mode("append").parquet(path)
        return True
    staged = f"{path.rstrip('/')}-staged/{batch}-{uuid.uuid4().hex}"
    new.write.parquet(staged)
    return publish(spark, staged, f"{path}/batch={batch}")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Renames a staged folder to its place, one step in a file system; False, and the staged folder is deleted, if another writer was first."""
    src, fs = _hadoop(spark, staged)
    dst, _ = _hadoop(spark, target)
    fs.mkdirs(dst.getParent())
    if not fs.exists(dst) and fs.rename(src, dst) and not fs.exists(_hadoop(spark, f"{target}/{src.getName()}")[0]):
        return True
    # A rename onto a folder that has come up since puts the staged one into it: take it out again.
    fs.delete(_hadoop(spark, f"{target}/{src.getName()}")[0], True)
    fs.delete(src, True)
    return False


def swap_partition(rows: DataFrame, path: str, by: str, value: str) -> None:
    """Exchanges one partition of a stored table for rows, which lack the column `by`: the new one is staged whole, then takes the old one's place. A job that is lost
    before leaves the old partition; one lost between the two renames leaves it as `<partition>.old`, and the next call puts it back first."""
    spark, place = rows.sparkSession, f"{path}/{by}={value}"
    old, staged = f"{path.rstrip('/')}-staged/{by}={value}.old", f"{path.rstrip('/')}-staged/{by}={value}-{uuid.uuid4().hex}"
    recover_partition(spark, path, by, value)
    rows.write.parquet(staged)
    dst, fs = _hadoop(spark, place)
    keep, src = _hadoop(spark, old)[0], _hadoop(spark, staged)[0]
    if fs.exists(dst):
        fs.rename(dst, keep)
    else:
        fs.mkdirs(dst.getParent())
    fs.rename(src, dst)
    fs.delete(keep, True)


def recover_partition(spark: SparkSession, path: str, by: str, value: str) -> bool:
    """Puts an old partition back whose exchange was lost between its renames; whether there was one. An old partition beside its new one is deleted."""
    dst, fs = _hadoop(spark, f"{path}/{by}={value}")
    keep = _hadoop(spark, f"{path.rstrip('/')}-staged/{by}={value}.old")[0]
    if not fs.exists(keep):
        return False
    if fs.exists(dst):
        fs.delete(keep, True)
        return False
    return bool(fs.rename(keep, dst))


def create_table(spark: SparkSession, name: str, declared: StructType, by: list[str]) -> bool:
    """Creates a partitioned table in the catalogue unless it is there; whether its schema is the declared one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in declared.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" PARTITIONED BY ({', '.join(by)})" if by else ""))
    found = spark.table(name).schema
    return {(f.name, f.dataType) for f in found.fields} == {(f.name, f.dataType) for f in declared.fields}


def replace_chain(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the chains that rows has; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain").parquet(path)


def write_table(rows: DataFrame, path: str, declared: StructType, by: list[str], cluster: list[str]) -> None:
    """Writes the declared columns, partitioned, and sorted in files so that row groups can be passed over."""
    rows.select(*declared.fieldNames()).repartition(*by).sortWithinPartitions(*cluster).write.mode("overwrite").partitionBy(*by).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_summary(measures: DataFrame, path: str, **about: str) -> None:
    """One row of measures as one JSON record, with what it is about."""
    measures.withColumns({k: F.lit(v) for k, v in about.items()}).coalesce(1).write.mode("overwrite").json(path)
