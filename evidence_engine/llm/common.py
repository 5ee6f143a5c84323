"""Shared folder, work tables and hot-key joins used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch while a work table is written: whole texts are long, and a batch stands in memory several
#: times; a pair of long texts is a large row.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def release() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers outlive their tasks, and several of them
    stand beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one
    machine. RuntimeError on a cluster without one: executors cannot see the driver's folders."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="evidence-work-")
        spark.conf.set("spark.checkpoint.dir", set_to)
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path, rows, size = work_path(spark, name), spark.conf.get(ARROW_ROWS), spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), BATCH_ROWS)) if int(rows) > 0 else str(BATCH_ROWS))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
        spark.conf.set(ARROW_BYTES, size)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes work tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.work_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_work(spark: SparkSession) -> None:
    """Removes all work tables; call it when no DataFrame of this subpackage is still to be read."""
    drop_path(spark, f"{shared_dir(spark)}/work")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of any name cannot clash with those that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: A key that holds more than one in HOT_SHARE of the rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of rows with one-row-per-key groups. Keys that hold over total / HOT_SHARE rows (so HOT_SHARE at most) are
    broadcast; the others are joined by a shuffle, in which no key has more than that share of the rows, and adaptive execution
    splits partitions of the rows that are far larger than others."""
    hot = F.col(count) > F.lit(max(1000, total // HOT_SHARE))
    few = F.broadcast(groups.where(hot).limit(HOT_SHARE).withColumn("_hot", F.lit(True)))
    names = [c for c in groups.columns if c != key]
    marked = rows.join(few, key, "left")
    cold = groups.where(~hot)
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *names).join(cold, key, "left")
    return done.unionByName(rest)
