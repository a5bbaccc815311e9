"""Shared folder, intermediate tables and small column helpers of the operators in this package."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a Python worker.  Spark's own limit of 64 MB is held several times by each task, on
#: both sides, and by allocators that keep what they once had.
BATCH_BYTES = 4_000_000

#: ASCII white space, the separators of words in every operator that splits on white space.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size and memory given back at the end of a task.

    The limit on bytes is a setting of the session, so it holds for later queries too; a smaller one is left alone."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(tidy(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session on one machine (tests) that names none gets a temporary one; on a cluster the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="klangwerk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/klangwerk-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor costs no more than
    its own tasks.  Shuffle files of the plan behind it are released."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a settled table that nothing needs any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """A function of batches that gives memory back when its task ends: Python workers outlive their tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def release_memory() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of ``docs`` have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: Rows of ids up to which a settled table of ids is broadcast; beyond it the same join is a shuffle join.
MAX_BROADCAST_IDS = 500_000


def small_side(ids: DataFrame) -> DataFrame:
    """A settled table of ids, marked for broadcast if it is counted to be small."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
