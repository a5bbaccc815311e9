"""Ranking, quotas, percentiles and diversity (WN, RK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges
from .base import as_col


def interleave(df: DataFrame, language: str, rank_class: str, order: list[str]) -> DataFrame:
    """WN-01: languages interleaved by usage percentile: global rank by (class, ordinal / count in language and class, language, order)."""
    own = Window.partitionBy(language, rank_class)
    # the global order needs one sorted stream; a range-partitioned sort keeps it parallel, ordinals come from `ordinals`
    placed = df.withColumn("_ordinal", F.row_number().over(own.orderBy(*order))).withColumn("_count", F.count("*").over(own))
    return placed.withColumn("share", F.col("_ordinal") / F.col("_count")).drop("_ordinal", "_count")


def ordinals(df: DataFrame, order: list[Column], buckets: Column, name: str = "ordinal") -> DataFrame:
    """WN-06: global row numbers without one global window: rows are numbered within ordered buckets (``buckets`` must not
    decrease along ``order``), and each bucket is shifted by the rows of those before it."""
    b = df.withColumn("_b", buckets)
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    shift = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return b.withColumn("_r", within).join(shift, "_b").withColumn(name, (F.col("_r") + F.col("_shift")).cast("long")).drop("_b", "_r", "_shift")


def quota_fill(df: DataFrame, keys: list[str], order: list[Column], quota: int, required: Column) -> DataFrame:
    """WN-02: up to ``quota`` rows a group: required rows first, the rest by order; keeps smaller editions nested."""
    w = Window.partitionBy(*keys).orderBy(F.when(required, 0).otherwise(1), *order)
    return df.withColumn("fill_rank", F.row_number().over(w).cast("long")).where(F.col("fill_rank") <= quota)


def rank_percentile(df: DataFrame, keys: list[str], order: list[Column], name: str = "percentile") -> DataFrame:
    """WN-07: 1 - i / (n - 1) by rank in the group, 1 for a single row; groups may be of any size (see `ranges`)."""
    i, n = F.col("_i"), F.col("_n")
    return ranges.group_positions(df, keys, order, "_i", "_n").withColumn(name, F.when(n == 1, F.lit(1.0)).otherwise(1.0 - i / (n - 1))).drop("_i", "_n")


def popularity_tier(percentile: Column | str) -> Column:
    """WN-07: A from .80, B from .35, else C."""
    p = as_col(percentile)
    return F.when(p >= 0.80, "A").when(p >= 0.35, "B").otherwise("C")


def tie_percentile_ppm(df: DataFrame, keys: list[str], value: str, name: str = "ppm") -> DataFrame:
    """WN-08: share of strictly smaller values in millionths; ties equal, a single row 1e6, missing values 0 and not counted.

    Groups and ties may be of any size (see `ranges`)."""
    below, n = F.col("_below"), F.col("_n")  # long: times two million they pass 32 bits from 1,074 rows on
    ppm = F.when(F.col(value).isNull(), F.lit(0)).when(n == 1, F.lit(1_000_000)).otherwise(F.floor((below * 2_000_000 + (n - 1)) / (2 * (n - 1))))
    return ranges.smaller_values(df, keys, value, "_below", "_n").withColumn(name, ppm.cast("long")).drop("_below", "_n")


def type_coverage(df: DataFrame, key: str, type_col: str, order: list[Column], floor: int, limit: int) -> DataFrame:
    """RK-04: at least ``floor`` rows of each present type, filled up to ``limit`` by order."""
    own = F.row_number().over(Window.partitionBy(key, type_col).orderBy(*order))
    marked = df.withColumn("_floor", own <= floor)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("_floor"), 0).otherwise(1), *order))
    return marked.withColumn("_place", place).where(F.col("_place") <= limit).drop("_floor", "_place")


def stable_sample(df: DataFrame, strata: list[str], key: str, seed: str, quota: int) -> DataFrame:
    """RK-19: the ``quota`` rows of each stratum with the smallest digests; the same rows in every run."""
    from klangwerk.functions.text import stable_score

    scored = df.withColumn("sample_score", stable_score(seed, F.col(key)))
    w = Window.partitionBy(*strata).orderBy("sample_score", key)
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def rank_violations(df: DataFrame, key: str, rank: str, level: str) -> DataFrame:
    """RK-16: rows that stand after one of a higher level, found with a running maximum instead of pairs."""
    before = F.max(level).over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("highest_before", before).where(F.col("highest_before") > F.col(level))


def near_tie_bands(df: DataFrame, keys: list[str], score: str, tie: list[str] = (), width: float = 0.03, name: str = "band") -> DataFrame:
    """WN-09: rows by falling score; a new band begins where the score is more than ``width`` below its band's first.

    Bands depend on the scores alone, so only a group's different scores are walked, in order by definition; rows take the
    band of theirs by a join."""
    from pyspark.sql.types import LongType, StructType

    cells = df.select(*keys, score).distinct()
    schema = StructType([*cells.schema.fields]).add(name, LongType())

    def run(pdf):
        pdf = pdf.sort_values(score, ascending=False, kind="stable")
        bands, anchor, n = [], None, -1
        for s in pdf[score]:
            if anchor is None or anchor - s > width:
                anchor, n = s, n + 1
            bands.append(n)
        return pdf.assign(**{name: bands})

    walked = cells.groupBy(*keys).applyInPandas(run, schema)
    same = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_w.{c}")) for c in [*keys, score]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.alias("_r").join(walked.alias("_w"), on).select("_r.*", f"_w.{name}")


def capped_greedy(df: DataFrame, key: str, order: str, caps: dict[str, int], limit: int, rank: str = "kept_rank") -> DataFrame:
    """RK-13/15: walks a group in order and keeps a row if none of its frames has reached its cap.  The walk is sequential
    by definition; cut groups with `top_per_group` first where they may be large."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*df.schema.fields]).add(rank, LongType())

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        seen, keep = {c: {} for c in caps}, []
        for i, row in zip(pdf.index, pdf[list(caps)].itertuples(index=False)):
            if len(keep) == limit:
                break
            if all(seen[c].get(v, 0) < caps[c] for c, v in zip(caps, row)):
                for c, v in zip(caps, row):
                    seen[c][v] = seen[c].get(v, 0) + 1
                keep.append(i)
        out = pdf.loc[keep]
        return out.assign(**{rank: range(1, len(out) + 1)})

    return df.groupBy(key).applyInPandas(run, schema)
