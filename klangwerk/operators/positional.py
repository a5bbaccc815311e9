"""Word sequences found by place: patterns in texts and phrases in names (JN-15, FP-06).

A text is taken apart into narrow rows (id, place, word, next); of these only the word pairs that a pattern has are kept, and
they meet patterns at each pattern's rarest pair.  Whether the other pairs stand where they must is a semi-join on (id,
place, pair), so no text and no list of words is ever shuffled.  Ids name one text each; results are sets of places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workspace as W

#: Pairs of all patterns up to which they are broadcast; beyond it the filter is a shuffle join.
MAX_BROADCAST_PAIRS = 500_000


def postings(texts: DataFrame, key: str, tokens: Column | str) -> DataFrame:
    """key, place, word and next (null at the end) of every word."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    pairs = F.arrays_zip(t.alias("word"), F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t) - 1)).alias("next"))
    return texts.where(F.size(t) > 0).select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", "p.word", "p.next")


def few(df: DataFrame) -> bool:
    """Whether a side is counted to be small enough for a broadcast."""
    return df.limit(MAX_BROADCAST_PAIRS + 1).count() <= MAX_BROADCAST_PAIRS


def _places(index: DataFrame, key: str, patterns: DataFrame, pattern: str, tokens: str) -> DataFrame:
    """key, _p, place; a place comes again if an id does.

    Sides as large as the index are never broadcast, however small Catalyst thinks they are."""
    spark = index.sparkSession
    p = W.settled(patterns.where(F.size(tokens) > 0).select(F.col(pattern).alias("_p"), F.col(tokens).alias("_t")), f"{W.shared_dir(spark)}/klangwerk-patterns-{uuid.uuid4().hex}")
    n = p.agg(F.sum(F.greatest(F.lit(1), F.size("_t") - 1)).alias("pairs"), F.count_if(F.size("_t") > 2).alias("long")).first()
    side = F.broadcast if (n["pairs"] or 0) <= MAX_BROADCAST_PAIRS else lambda df: df.hint("merge")
    single = p.where(F.size("_t") == 1).select("_p", F.col("_t")[0].alias("word")).distinct()
    double = p.where(F.size("_t") == 2).select("_p", F.col("_t")[0].alias("word"), F.col("_t")[1].alias("next")).distinct()
    # one word or one pair is found where it stands
    found = index.join(side(single), "word").select(key, "_p", "place").unionByName(index.join(side(double), ["word", "next"]).select(key, "_p", "place"))
    if not n["long"]:
        return found
    parts = postings(p.where(F.size("_t") > 2), "_p", "_t").where(F.col("next").isNotNull()).select("_p", F.col("place").alias("_at"), "word", "next")
    # only pairs that some pattern has go on
    met = index.join(side(parts.select("word", "next").distinct()), ["word", "next"], "left_semi")
    often = met.groupBy("word", "next").agg(F.count("*").alias("_n"))
    rarest = Window.partitionBy("_p").orderBy("_n", "_at")
    anchor = parts.join(often, ["word", "next"]).withColumn("_r", F.row_number().over(rarest)).where("_r = 1")
    starts = met.join(side(anchor.select("_p", "_at", "word", "next")), ["word", "next"]).select(key, "_p", (F.col("place") - F.col("_at")).alias("_start")).where("_start >= 0").distinct()
    needed = starts.join(side(parts), "_p").select(key, "_p", "_start", (F.col("_start") + F.col("_at")).alias("place"), "word", "next")
    size = p.select("_p", (F.size("_t") - 1).alias("_pairs")).distinct()
    held = needed.join(met.select(key, "place", "word", "next").hint("merge"), [key, "place", "word", "next"], "left_semi").groupBy(key, "_p", "_start").agg(F.count("*").alias("_held"))
    return found.unionByName(held.join(side(size), "_p").where(F.col("_held") == F.col("_pairs")).select(key, "_p", F.col("_start").alias("place")))


def occurrences(index: DataFrame, key: str, patterns: DataFrame, pattern: str, tokens: str) -> DataFrame:
    """key, pattern and place of every place where a pattern's words stand side by side; ``index`` as `postings` gives it."""
    return _places(index, key, patterns, pattern, tokens).distinct().select(key, F.col("_p").alias(pattern), F.col("place").cast("long").alias("place"))


def holders(index: DataFrame, key: str, patterns: DataFrame, pattern: str, tokens: str) -> DataFrame:
    """key and pattern of `occurrences`, each once.  Rows are dealt by key before they are made unique, so no task of a scan
    collects what it finds."""
    return _places(index, key, patterns, pattern, tokens).select(key, F.col("_p").alias(pattern)).repartition(key).dropDuplicates([key, pattern])
