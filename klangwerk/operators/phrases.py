"""Phrase ranking evidence and order (RK-11..13, AG-09/10, EV-12, SF-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base of a phrase's utility by rhyme class, bonus by phrase type (the largest counts), penalties by safety class.
TYPE_BASE = {"multisyllabic_perfect": 1.00, "perfect": 1.00, "multisyllabic_slant": 0.82, "family": 0.78, "slant": 0.65, "weak": 0.25}
TYPE_BONUS = {"proverb": 0.025, "idiom": 0.020, "figurative_expression": 0.020, "phrase": 0.015}
SAFETY_PENALTY = {"safe": 0.0, "marked": 0.35, "restricted": 0.50}


def commonness(counts: DataFrame, totals: DataFrame, corpora: int) -> DataFrame:
    """AG-09: sum of log1p(sentences per million) over the corpora, by their number; and in how many a phrase occurs."""
    per = counts.join(totals, "source").select("phrase", (F.col("n") * 1_000_000.0 / F.col("total")).alias("rate"))
    return per.groupBy("phrase").agg((F.sum(F.log1p("rate")) / corpora).alias("commonness"), F.count("*").alias("in_corpora"))


def utility(kind: Column, phonetic: Column, syllables: Column, corpora: Column, magnitude: Column, types: Column, overlap: Column, safety: Column) -> Column:
    """RK-11: base by class + .45 phonetic + .03 matched syllables (of six) + .03 corpora (of three) + .07 commonness (of six)
    + the bonus of the best phrase type - .08 overlap with the query - the safety penalty; to six digits, as each part."""
    pick = lambda table, c, other: F.coalesce(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[c], F.lit(other))
    share = lambda c, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))) / most
    bonus = F.greatest(F.lit(0.0), *(F.when(F.array_contains(types, k), v).otherwise(0.0) for k, v in TYPE_BONUS.items()))
    parts = [pick(TYPE_BASE, kind, TYPE_BASE["weak"]), 0.45 * share(phonetic, 1), 0.03 * share(syllables, 6), 0.03 * share(corpora, 3), 0.07 * share(magnitude, 6), F.coalesce(bonus, F.lit(0.0)), -0.08 * share(overlap, 1), -pick(SAFETY_PENALTY, safety, 0.0)]
    return F.round(sum((F.round(x, 6) for x in parts[1:]), parts[0]), 6)


def order() -> list[Column]:
    """RK-12: eligible, safety, tier, band, utility, phonetic score, id."""
    safety = F.when(F.col("safety") == "safe", 0).when(F.col("safety") == "marked", 1).otherwise(2)
    return [F.desc("eligible"), safety, F.asc("tier"), F.asc("band"), F.desc("utility"), F.desc("phonetic"), F.asc("phrase")]


def deduped(df: DataFrame, key: str, frames: list[str], by: list[Column]) -> DataFrame:
    """RK-13: first row of each value, one frame after another (exact, normalised, family)."""
    from .relational import best_per_group

    for frame in frames:
        df = best_per_group(df, [key, frame], by)
    return df
