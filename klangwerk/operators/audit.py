"""Audits, invariants, diagnostics and refresh checks (EV-06..13, 22..25) and quota arithmetic (EV-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def orphans(children: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
    """EV-07/08: one row: name of the check and rows without a parent."""
    return children.join(parents.select(*on).distinct(), on, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def excess(df: DataFrame, key: str, quota: int, name: str) -> DataFrame:
    """EV-08: one row: groups above their quota."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > quota).agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def conflicts(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """EV-07: one row: rows for which a condition that excludes itself holds."""
    return df.where(condition).agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def word_budget(total: int, phrases: int, entities: int) -> int:
    """EV-09: what an edition leaves for words; they must be its majority."""
    words = total - phrases - entities
    if words * 2 <= total:
        raise ValueError("words must be more than half of an edition")
    return words


def sentinels(df: DataFrame, required: DataFrame, on: str) -> DataFrame:
    """EV-11: required ids and whether they are there."""
    return required.select(on).distinct().join(df.select(on).distinct().withColumn("_in", F.lit(True)), on, "left").select(on, F.coalesce("_in", F.lit(False)).alias("passed"))


def repeat_groups(df: DataFrame, key: str, by: str, cap: int = 1) -> DataFrame:
    """EV-12: groups of one result page that share a value more often than allowed, and by how much."""
    return df.groupBy(key, by).agg(F.count("*").alias("n")).where(F.col("n") > cap).groupBy(key).agg(F.count("*").alias("groups"), F.sum(F.col("n") - cap).alias("excess"))


def coverage(tokens: DataFrame, known: DataFrame, key: str, token: str) -> DataFrame:
    """EV-13/23: per key: tokens, how many the lexicon knows, and full, partial or none."""
    k = known.select(F.col(token)).distinct().withColumn("_known", F.lit(1))
    c = tokens.join(k, token, "left").groupBy(key).agg(F.count("*").alias("tokens"), F.sum(F.coalesce("_known", F.lit(0))).alias("known"))
    return c.withColumn("coverage", F.when(F.col("known") == 0, "none").when(F.col("known") == F.col("tokens"), "full").otherwise("partial"))


def page_metrics(df: DataFrame, key: str, rank: str, form: str, family: str, cutoff: int = 20) -> DataFrame:
    """EV-06: results on a page, repeated forms and repeated families, from one window over the page."""
    page = df.where(F.col(rank) <= cutoff)
    w = lambda c: F.row_number().over(Window.partitionBy(key, c).orderBy(rank))
    marked = page.withColumn("_f", w(form)).withColumn("_g", w(family))
    return marked.groupBy(key).agg(F.count("*").alias("results"), F.sum(F.when(F.col("_f") > 1, 1).otherwise(0)).alias("repeated_forms"), F.sum(F.when(F.col("_g") > 1, 1).otherwise(0)).alias("repeated_families"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """EV-22: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def review_problems(tasks: DataFrame, reviews: DataFrame, on: str) -> DataFrame:
    """EV-24: reviews without a task, tasks without a review, tasks reviewed more than once."""
    t, r = tasks.select(on).distinct(), reviews.groupBy(on).agg(F.count("*").alias("_n"))
    unknown = r.join(t, on, "left_anti").select(on, F.lit("unknown").alias("problem"))
    missing = t.join(r, on, "left_anti").select(on, F.lit("missing").alias("problem"))
    return unknown.unionByName(missing).unionByName(r.join(t, on, "left_semi").where("_n > 1").select(on, F.lit("repeated").alias("problem")))


def channel_mix(df: DataFrame, key: str, channel: str, limit: int) -> DataFrame:
    """EV-25: results per channel, their share of the query's results, and whether the channel's limit was reached."""
    n = df.groupBy(key, channel).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key))).withColumn("saturated", F.col("n") >= limit)
