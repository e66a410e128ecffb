"""Shared folder, worker caches and block splitting."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one local process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Intermediate tables written since `tidy` last removed them.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs once the driver's objects for them are collected: ask for that between steps.

    The first collection only releases what finished jobs still hold, the next one frees them.
    """
    gc.collect()
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.3)


def tidy(spark: SparkSession) -> None:
    """Remove the intermediate tables and shuffle files of operators whose results have been written: for the start of a pipeline's stage."""
    while _MADE:
        remove(spark, _MADE.pop())
    free_shuffles(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table, on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    if not path:
        path = new_path(spark, name)
        _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task."""
    held = sys.modules.setdefault("_attesta_worker", types.ModuleType("_attesta_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def in_slabs(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items whose sizes add up to about ``limit``; one large item is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts (column number ``text``) take about ``limit`` bytes: bounds what a task holds at once."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for a, b in in_slabs((sizes + 64).tolist(), limit):
                yield batch.slice(a, b - a)
    finally:
        release()


def forget() -> None:
    """Drop what other operators have left in this worker: their caches are rebuilt when they come again."""
    sys.modules.pop("_attesta_worker", None)
    release()


def release() -> None:
    """Give memory that a task has freed back to the system: workers go on to other stages beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def block_pairs(rows: DataFrame, keys: list[str], item: Column, size: int) -> DataFrame:
    """Split large groups of ``rows`` into blocks and lay out every pair of blocks of one group.

    A group of at most ``size`` rows is one block.  A larger one is cut into ceil(n / size) blocks by the hash of
    ``item``; a row goes once to each pair of blocks with its own, so any two rows of a group meet in exactly the task of
    their two blocks.  Adds ``block`` (own block), ``b1`` and ``b2`` (the pair, b1 <= b2).  The table of large groups is
    joined without a hint, so adaptive execution splits or broadcasts it by its measured size.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")).where(F.col("group_rows") > size)
    large = large.select(*keys, F.ceil(F.col("group_rows") / size).cast("int").alias("blocks"))
    return (
        rows.join(large, keys, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
