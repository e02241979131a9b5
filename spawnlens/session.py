"""The session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators.kernel import register

#: Skewed joins are split and small shuffle partitions merged at run time; times are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session with these settings and the library's SQL functions."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false")
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    register(spark)
    return spark
