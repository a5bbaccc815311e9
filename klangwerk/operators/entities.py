"""Named entities: popularity, order and diversity (SF-19/20, RK-14/15, EV-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T

from . import ranking as R


def hybrid_cut_score(quality_ppm: Column, usage_ppm: Column) -> Column:
    """SF-20: integer geometric mean of two shares in millionths; half of one where the other is missing."""
    both = F.floor(F.sqrt((quality_ppm * usage_ppm).cast("double"))).cast("long")
    return F.when(quality_ppm.isNotNull() & usage_ppm.isNotNull(), both).otherwise(F.floor(F.coalesce(quality_ppm, usage_ppm, F.lit(0)) / 2).cast("long"))


def ordered(rows: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """RK-14: tier, .02 score band, syllable distance, prominence, popularity, score, name."""
    band = T.deficit_band("score")
    order = [F.asc("tier"), band, F.asc("distance"), F.desc("percentile"), F.desc("popularity"), F.desc("score"), F.asc("surface"), F.asc("entity")]
    from .relational import top_per_group

    return top_per_group(rows, [key], order, limit)


def diverse(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """RK-15: one result per entity and per surface, in order."""
    return R.capped_greedy(rows, key, "rank", {"entity": 1, "surface": 1}, limit)


def cut_summary(rows: DataFrame, kept: Column, *keys: str) -> DataFrame:
    """EV-10: rows kept and rejected, and how many have evidence."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(kept, 1).otherwise(0)).alias("kept"), F.sum(F.when(kept, 0).otherwise(1)).alias("rejected"))
