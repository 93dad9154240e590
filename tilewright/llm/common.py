"""What the operators share: the shared folder, checked broadcasts and caches that live as long as a Python worker."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows take no more than this.
BROADCAST_BYTES = 32 << 20
#: Lets Spark delete a query's shuffle files when it ends, instead of some time after its plan is no longer referenced.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets a temporary one, and any other is refused: executors wouldn't see it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        else:
            if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="tilewright-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors. The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks df for broadcast if its counted rows are small enough; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def process_cache() -> dict:
    """A dictionary that outlives a task: it belongs to the Python worker process."""
    import sys
    import types

    return sys.modules.setdefault("_tilewright_cache", types.ModuleType("_tilewright_cache")).__dict__


def give_back() -> None:
    """Returns to the system what a task's Python has freed. Idle workers stay for a minute, beside the tasks of what comes next, and would hold it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
