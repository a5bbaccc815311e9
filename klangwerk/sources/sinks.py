"""Writers and manifests (SK)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, rows_per_file: int = 100_000, fmt: str = "json") -> DataFrame:
    """SK-01: files of bounded rows; returns the manifest: file and rows, read back from what was written."""
    df.write.option("maxRecordsPerFile", rows_per_file).format(fmt).mode("overwrite").save(path)
    spark = df.sparkSession
    return spark.read.format(fmt).schema(df.schema).load(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("rows"))


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None) -> None:
    """SK-02: a Parquet table, partitioned and bucketed by its lookup keys, with statistics for the optimizer."""
    w = df.write.format("parquet").mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    w = w.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1]) if bucket_by else w
    w.saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def append_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """SK-06: rows whose key is not there yet, once each."""
    return df.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """SK-07: a build stage that is skipped if its output is complete: Spark writes _SUCCESS last, so a lost run is redone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _done(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resumable_stage(source: DataFrame, key: str, folder: str, fingerprint: str, build, shards: int = 8) -> DataFrame:
    """SK-07: a stage built in shards by ranges of a numeric key, each written once; a lost run goes on after its last shard.

    The first run writes the plan (edges of the key), every shard its own folder, the last one the manifest (shard, last_key,
    rows).  All lie under the fingerprint of the input and the rules, so another input starts anew and an interrupted one is
    continued with the same edges.  ``build`` makes the rows of the stage from those of a shard; null keys are in the first."""
    spark = source.sparkSession
    root = f"{folder.rstrip('/')}/{hashlib.sha256(fingerprint.encode()).hexdigest()[:24]}"
    if not _done(spark, f"{root}/plan"):
        edges = sorted(set(source.where(F.col(key).isNotNull()).approxQuantile(key, [i / shards for i in range(1, shards)], 0.001)))
        spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "shard int, edge double").coalesce(1).write.mode("overwrite").parquet(f"{root}/plan")
    edges = [r.edge for r in spark.read.parquet(f"{root}/plan").orderBy("shard").collect()]
    paths = [f"{root}/shard-{i:05d}" for i in range(len(edges) + 1)]
    for i, path in enumerate(paths):
        if _done(spark, path):
            continue
        k = F.col(key)
        above = k > edges[i - 1] if i else F.lit(True)
        below = k <= edges[i] if i < len(edges) else F.lit(True)
        build(source.where((above & below) | k.isNull() if i == 0 else above & below)).write.mode("overwrite").parquet(path)
    out = spark.read.parquet(*paths)
    if not _done(spark, f"{root}/manifest"):
        last = [(i, float(edges[i]) if i < len(edges) else None, spark.read.parquet(p).count()) for i, p in enumerate(paths)]
        spark.createDataFrame(last, "shard int, last_key double, rows long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return out


def stage_manifest(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame | None:
    """SK-07: shard, last_key and rows of a finished stage; None if it is not finished for that fingerprint."""
    root = f"{folder.rstrip('/')}/{hashlib.sha256(fingerprint.encode()).hexdigest()[:24]}"
    return spark.read.parquet(f"{root}/manifest") if _done(spark, f"{root}/manifest") else None


def compact(results: DataFrame, columns: list[str], name: str = "payload") -> DataFrame:
    """SK-10: results as one JSON text each, without nulls, and its size."""
    return results.select(F.to_json(F.struct(*columns)).alias(name)).withColumn("bytes", F.octet_length(name))


def manifest(df: DataFrame, **facts: str) -> DataFrame:
    """SK-11: key and value rows that describe a dataset: given facts, rows and columns."""
    counted = df.agg(F.count("*").cast("string").alias("rows"))
    pairs = {**facts, "columns": ",".join(df.columns)}
    entries = F.array(F.struct(F.lit("rows").alias("key"), F.col("rows").alias("value")), *(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(pairs.items())))
    return counted.select(F.explode(entries).alias("e")).select("e.*")


def check_manifest(found: DataFrame, **expected: str) -> DataFrame:
    """SK-11: expected facts that a manifest lacks or contradicts; no rows if it fits."""
    want = found.sparkSession.createDataFrame(sorted(expected.items()), "key string, expected string")
    return want.join(found, "key", "left").where(~F.col("expected").eqNullSafe(F.col("value")))
