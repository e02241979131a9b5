"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spawnlens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if all runs in one process, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return told or _own_dir()


#: Tables that this process wrote to the shared folder.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again, so that lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove_materialised(spark: SparkSession) -> int:
    """Deletes all tables that materialise() has written so far, and returns their number: call it when the results that read them are stored."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Rows and bytes that go to a Python worker at once at most; long texts must not add up.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to these bounds, if they are larger, and leaves them so: a plan reads them when its rows are asked for, after the call."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > bound:
            spark.conf.set(key, str(bound))


def release_memory() -> None:
    """Gives memory that is not in use back to the system: Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release_memory() at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def least_hashes(id_col: str, wanted: int, rows: int) -> Column:
    """Keeps about four times `wanted` of `rows` rows, those of the least xxhash64, so that few are sorted to find the `wanted` least; all of a small table."""
    share = 4 * wanted / max(1, rows)
    return F.lit(True) if share >= 1 else F.xxhash64(id_col) < F.lit(int(-(2**63) + share * 2**64))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)
