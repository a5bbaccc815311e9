"""Summaries, distributions, consensus and evidence merges (AG, WN-10..14, ST-06) over any DataFrame.

Sets are gathered after a distinct of their values, so a group's size costs no more than its different values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import as_col


def count_by_type(df: DataFrame, types: str, keys: list[str] = ()) -> DataFrame:
    """AG-03: rows of each type; a row counts for all its types."""
    return df.select(*keys, F.explode(types).alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("n"))


def grouped_results(df: DataFrame, keys: list[str], types: str, item: str, rank: str) -> DataFrame:
    """AG-04: the items of each type in order of rank.  ``df`` holds ranked results, a bounded list per key."""
    each = df.select(*keys, F.explode(types).alias("type"), F.struct(rank, item).alias("_i"))
    return each.groupBy(*keys, "type").agg(F.transform(F.array_sort(F.collect_list("_i")), lambda x: x[item]).alias("items"))


def aggregated_search(df: DataFrame, keys: list[str], least: int, **measures: Column) -> DataFrame:
    """AG-05, AG-32: aggregates of groups of at least ``least`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in measures.items())).where(F.col("n") >= least)


def attested_groups(df: DataFrame, key: str, surface: str, eligible: Column, tokens: str, available: Column, least: int = 2, most: int = 16) -> DataFrame:
    """AG-32: phrases with an eligible available row whose longest form has between ``least`` and ``most`` tokens."""
    rows = df.where(available).groupBy(key).agg(F.min(surface).alias("canonical"), F.max(tokens).alias("token_count"), F.bool_or(eligible).alias("_ok"))
    return rows.where(F.col("_ok") & F.col("token_count").between(least, most)).drop("_ok")


def evidence_in_groups(df: DataFrame, keys: list[str], source: str, counts: list[str]) -> DataFrame:
    """AG-06: number of different sources and sums of counts."""
    return df.groupBy(*keys).agg(F.countDistinct(source).alias("sources"), *(F.sum(c).alias(c) for c in counts))


def catalogue_stats(df: DataFrame, flags: dict[str, Column], means: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """AG-07: rows, rows for which each flag holds, means."""
    own = [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in flags.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *own, *(F.avg(m).alias(f"mean_{m}") for m in means))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG-14: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_exactly_one(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """AG-14: groups in which the flag holds for no row or for several."""
    return df.groupBy(*keys).agg(F.count_if(flag).alias("n")).where("n != 1")


#: Quantiles of a distribution summary.
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def distribution(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """AG-15/17: count, mean and linearly interpolated quantiles.

    Equal values are counted before they meet, so an exact quantile holds a group's different values, not its rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    each = [F.percentile(value, F.lit(q), F.col("_k")).alias(name) for name, q in quantiles.items()]
    return counted.groupBy(*keys).agg(F.sum("_k").alias("n"), (F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("mean"), *each)


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float] = {"p50": 0.5, "p95": 0.95}) -> DataFrame:
    """AG-16/18: timing summary: count, mean, population deviation, least and largest value, quantiles by nearest rank.

    Counts per value are summed up in order of the values; the first whose sum reaches the share of the rows is the quantile."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    own = Window.partitionBy(*keys)
    placed = counted.withColumn("_past", F.sum("_k").over(own.orderBy(value))).withColumn("_n", F.sum("_k").over(own))
    x, k = F.col(value).cast("double"), F.col("_k")
    mean = F.sum(x * k) / F.sum(k)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x * k) / F.sum(k) - mean * mean))
    at = [F.min(F.when(F.col("_past") >= F.ceil(F.col("_n") * q), F.col(value))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(*keys).agg(F.sum("_k").alias("n"), mean.alias("mean"), spread.alias("deviation"), F.min(value).alias("least"), F.max(value).alias("largest"), *at)


def stage_timing(df: DataFrame, stages: str) -> DataFrame:
    """AG-18: the timing summary of every stage of a map of stage to milliseconds."""
    return nearest_rank(df.select(F.explode(stages).alias("stage", "ms")), ["stage"], "ms")


def shares(df: DataFrame, keys: list[str], count: str, name: str = "probability") -> DataFrame:
    """AG-19: counts as shares of their group."""
    return df.withColumn(name, F.col(count) / F.sum(count).over(Window.partitionBy(*keys)))


def consensus(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-21: unresolved without a value, converged with one, conflict with several; and the values."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.withColumn("state", F.when(F.size("values") == 0, "unresolved").when(F.size("values") == 1, "converged").otherwise("conflict"))


def merged_options(df: DataFrame, keys: list[str], confidence: str, any_flags: list[str], all_flags: list[str], first: dict[str, Column], sets: list[str], scalars: list[str]) -> DataFrame:
    """AG-22: options of one resolution key as one: the highest confidence, flags that hold for any or for all, the first known
    attributes by an order, unions of arrays (``sets``) and of single values (``scalars``), sorted."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return df.groupBy(*keys).agg(F.max(confidence).alias(confidence), *(F.bool_or(c).alias(c) for c in any_flags), *(F.bool_and(c).alias(c) for c in all_flags),
                                 *(F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c, o in first.items()), *(flat(c) for c in sets), *(F.array_sort(F.collect_set(c)).alias(c) for c in scalars))


def ranked_variants(df: DataFrame, keys: list[str], order: list[Column], eligible: Column) -> DataFrame:
    """AG-23: variants numbered by order; the first eligible one is preferred."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("variant", F.row_number().over(w.orderBy(*order)).cast("long"))
    first = F.min(F.when(eligible, F.col("variant"))).over(w)
    return numbered.withColumn("preferred", F.coalesce(F.col("variant") == first, F.lit(False)))


def merged_sets(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """AG-24: the union of a group's values (an array or a single value), sorted."""
    single = df.select(*keys, F.explode(values).alias("_v")) if dict(df.dtypes)[values].startswith("array") else df.select(*keys, F.col(values).alias("_v"))
    return single.distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("_v")).alias(values))


def summary_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG-25: rows of each combination."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def census(df: DataFrame, keys: list[str], sources: str, size: str, blank: Column) -> DataFrame:
    """AG-26: rows, sources, total size and blank rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(sources).alias("sources"), F.sum(size).alias("size"), F.count_if(blank).alias("blank"))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, last: int = 100, name: str = "rolling_mean") -> DataFrame:
    """AG-27: mean of the last values, the row's own included."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0)))


def first_seen_sets(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """AG-28: for each group the different values of every column, in the order in which they are first seen."""
    out = None
    for v in values:
        first = df.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.min(F.struct(*order)).alias("_o"))
        own = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", v))), lambda x: x[v]).alias(v))  # noqa: B023
        out = own if out is None else out.join(own, keys, "full")
    none = [F.coalesce(F.col(v), F.array().cast(dict(out.dtypes)[v])).alias(v) for v in values]
    return out.select(*keys, *none)


def pairwise_similarity(df: DataFrame, keys: list[str], item: str, similarity, most: int = 50) -> DataFrame:
    """AG-29: number of different items, mean and largest similarity of their pairs.  ``df`` holds result pages; a page has at
    most ``most`` different items by the operator's contract, larger groups raise an error."""
    sets = df.select(*keys, item).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("_i"))
    checked = sets.withColumn("_i", F.when(F.size("_i") <= most, F.col("_i")).otherwise(F.raise_error(F.lit("a page has too many items")).cast(dict(sets.dtypes)["_i"])))
    own = checked.select(*keys, F.size("_i").cast("long").alias("items"), F.flatten(F.transform("_i", lambda a, i: F.transform(F.slice(F.col("_i"), i + 2, most), lambda b: F.struct(a.alias("a"), b.alias("b"))))).alias("_p"))
    scored = own.withColumn("_s", F.transform("_p", lambda p: similarity(p["a"], p["b"])))
    total = F.aggregate("_s", F.lit(0.0), lambda n, x: n + x)
    return scored.select(*keys, "items", F.when(F.size("_s") > 0, total / F.size("_s")).alias("mean_similarity"), F.array_max("_s").alias("max_similarity"))


def merged_evidence(df: DataFrame, keys: list[str], least: list[str], sets: list[str], flags: list[str]) -> DataFrame:
    """AG-30: the smallest sizes, unions of attributes (sorted) and flags that hold for any row."""
    return df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in least), *(F.array_sort(F.collect_set(c)).alias(c) for c in sets), *(F.bool_or(c).alias(c) for c in flags))


def lexical_profiles(df: DataFrame, keys: list[str], batch: str, priority: str, least: list[str], most: list[str]) -> DataFrame:
    """AG-31: per surface the aggregates of the batch of smallest source priority (its minimum; of equals the earliest batch),
    the priority the minimum of all."""
    per = df.groupBy(*keys, batch).agg(F.min(priority).alias(priority), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most))
    first = F.min_by(F.struct(*least, *most), F.struct(priority, batch)).alias("_p")
    return per.groupBy(*keys).agg(F.min(priority).alias(priority), first).select(*keys, priority, "_p.*")


def coverage_audit(df: DataFrame, status: str, source: str, tokens: str, name: str, order: list[Column], top: int = 20) -> DataFrame:
    """AG-34: measure, label, n: rows by status, by source and by number of tokens, and the ``top`` unresolved names in order."""
    part = lambda kind, c: df.groupBy(as_col(c).cast("string").alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("measure"), "label", "n")
    open_ = df.where(F.col(status) == "unresolved").orderBy(*order).limit(top).select(F.lit("unresolved").alias("measure"), F.col(name).alias("label"), F.lit(1).cast("long").alias("n"))
    return part("status", status).unionByName(part("source", source)).unionByName(part("tokens", tokens)).unionByName(open_)


def delta_to_best(df: DataFrame, keys: list[str], value: str, name: str = "delta") -> DataFrame:
    """WN-10: how far a value is below the largest of its group."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys)) - F.col(value))


def repeat_distance(df: DataFrame, keys: list[str], order: list[str], value: str, most: int = 4, name: str = "distance") -> DataFrame:
    """WN-11: rows until the value comes again, within the next ``most``; null if it does not."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.coalesce(*(F.when(F.lead(value, k).over(w) == F.col(value), k) for k in range(1, most + 1))))


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """WN-12: from, to, n and share of neighbouring values; the first and last of each group stand for themselves with null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = df.select(F.col(value).alias("from_value"), F.lead(value).over(w).alias("to_value")).unionByName(
        df.select(F.lag(value).over(w).alias("from_value"), F.col(value).alias("to_value")).where("from_value IS NULL"))
    return shares(pairs.groupBy("from_value", "to_value").agg(F.count("*").alias("n")), ["from_value"], "n")


def cumulative_offsets(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "offset") -> DataFrame:
    """WN-14: sum of the values before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast(dict(df.dtypes)[value])))


def result_overlap(a: Column | str, b: Column | str) -> Column:
    """ST-06: struct of shared items, Jaccard similarity and length of the common beginning of two ordered lists."""
    x, y = as_col(a), as_col(b)
    both, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    prefix = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same).cast("long"))
    return F.struct(both.cast("long").alias("shared"), F.when(union == 0, 0.0).otherwise(both / union).alias("jaccard"), prefix.alias("common_prefix"))
