"""Helpers that several operators need: the shared folder, staged tables, Arrow text batches."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local session, whose executors
    are the driver, may leave it unset; then it is set below the warehouse."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not here:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        here = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", here)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(here)
    return here


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the driver's JVM deletes it when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: With this setting a statement's shuffle files go when it ends, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files that its shuffles left on the executors go at once; nothing else reads them."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before else spark.conf.unset(CLEAN)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete those of ``tables`` that are staged; nothing may read them any more."""
    for t in tables:
        if path := vars(t).get("staged_at"):
            drop_path(t.sparkSession, path)


#: A key with over a HOT-th of all rows is hot; so there are fewer than HOT of them, at any size.
HOT = 1000


def join_by_class(rows: DataFrame, classes: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined, inner or left, with one row a key of ``classes``.  Keys marked ``hot``, fewer
    than HOT, are broadcast, so their rows stay where they are; the rest is shuffled."""
    few, many = classes.where(hot), classes.where(~hot)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(rest.join(many, keys, how))


def last_at_most(sorted_values: Column, value: Column, steps: int) -> Column:
    """The place (from 0) of the last entry that is at most ``value``, by binary search; the first is.

    ``steps`` is the bit length of the array's greatest size."""
    halves = F.lit([2**k for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(sorted_values, lo + s) <= value, F.lit(False)), lo + s).otherwise(lo))


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else unchanged,
    and the join shuffles (adaptive execution splits skewed partitions of such a join)."""
    return F.broadcast(df) if rows <= limit else df


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and the bytes of the batches that Python workers get: texts can be very long.

    This holds for the session from then on; plans take the setting when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Column ``name`` as strings; a null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def trim() -> None:
    """Give back the memory that this process does not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run, cached: bool = False):
    """``run``, after which the worker gives back the memory that it does not use: workers serve later stages too.

    Unless ``run`` uses the worker's cache, what other operators left there goes first."""

    def tidied(arrow):
        if not cached and worker_cache():
            worker_cache().clear()
            trim()
        yield from run(arrow)
        trim()

    return tidied


def worker_cache() -> dict:
    """A dict that lasts as long as the Python process, for vocabularies and word caches."""
    name = "_marlstone_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})


def hold(spark: SparkSession, value):
    """A broadcast handle for a value whose size is bounded by a parameter."""
    return spark.sparkContext.broadcast(value)
