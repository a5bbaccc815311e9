"""The folder that driver and executors share, for tables that outlive a plan."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it; only a session on one machine that names none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="klangwerk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark can open."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def settled(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: a lost executor then costs its own tasks only."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def released(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more, and has Spark drop the shuffle files of what was written; else these stay until
    the driver happens to collect its garbage."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        p = fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()  # Python's frames hold the JVM's
    spark.sparkContext._jvm.System.gc()
