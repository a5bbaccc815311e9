"""Running aggregates and ranks in groups of any size (WN-07, WN-08, EV-03, EV-05).

A window over a group is one task's work however many rows the group has.  Here rows are dealt by ranges of (group, order)
- Spark samples the splitters -, aggregated within each range, and every range takes over what the group's earlier ranges hold.
The ranges are written once, so both passes see the same rows in them.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workspace as W


def same(keys: list[str], left: DataFrame, right: DataFrame, prefix: str = "_k_") -> Column:
    """Equality of keys, nulls equal; the right side has them as _k_*."""
    return reduce(and_, (left[k].eqNullSafe(right[prefix + k]) for k in keys), F.lit(True))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: "_k_" + k for k in keys})


def running(df: DataFrame, keys: list[str], order: list[Column], before: dict[str, tuple[Column, str]], totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds to each row the sum, min or max ("sum", "min", "max") of a value over the rows of its group that stand before it, as
    ``before`` names them (null where there are none), and sums over the whole group, as ``totals`` names them.

    Rows that ``order`` leaves equal come in any order."""
    spark = df.sparkSession
    values = {f"_v{i}": v for i, (v, _) in enumerate(before.values())} | {f"_t{i}": v for i, v in enumerate((totals or {}).values())}
    dealt = df.withColumns(values).withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*(F.asc(k) for k in keys), *order, F.asc("_tie")).withColumn("_range", F.spark_partition_id())
    placed = W.settled(dealt, f"{W.shared_dir(spark)}/klangwerk-ranges-{uuid.uuid4().hex}")
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least, "max": F.greatest}
    each = placed.groupBy("_range", *keys).agg(*(kinds[k](f"_v{i}").alias(f"_s{i}") for i, (_, k) in enumerate(before.values())), *(F.sum(f"_t{i}").alias(f"_u{i}") for i in range(len(totals or {}))))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = each.select("_range", *keys, *(kinds[k](f"_s{i}").over(earlier).alias(f"_b{i}") for i, (_, k) in enumerate(before.values())), *(F.sum(f"_u{i}").over(group).alias(f"_w{i}") for i in range(len(totals or {}))))
    held = _renamed(held.withColumnRenamed("_range", "_of"), keys)
    own = Window.partitionBy("_range", *keys).orderBy(*order, F.asc("_tie")).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumns({f"_o{i}": kinds[k](f"_v{i}").over(own) for i, (_, k) in enumerate(before.values())})
    joined = within.join(held, (within["_range"] == held["_of"]) & same(keys, within, held))
    out = {name: merge[k](F.col(f"_b{i}"), F.col(f"_o{i}")) for i, (name, (_, k)) in enumerate(before.items())} | {name: F.col(f"_w{i}") for i, name in enumerate(totals or {})}
    return joined.select(*df.columns, *(c.alias(name) for name, c in out.items()))


def group_positions(df: DataFrame, keys: list[str], order: list[Column], position: str = "position", size: str = "size") -> DataFrame:
    """Adds position (from 0) and size of each row's group."""
    placed = running(df, keys, order, {position: (F.lit(1).cast("long"), "sum")}, {size: F.lit(1).cast("long")})
    return placed.withColumn(position, F.coalesce(F.col(position), F.lit(0)).cast("long"))


def smaller_values(df: DataFrame, keys: list[str], value: str, below: str = "below", size: str = "size") -> DataFrame:
    """Adds below, how many rows of the group have a smaller value, and size, how many have one; null without a value.

    Equal values are counted before they are ordered, so one frequent value is no burden."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_equal"))
    counted = running(cells, keys, [F.asc(value)], {below: (F.col("_equal"), "sum")}, {size: F.col("_equal")})
    counted = _renamed(counted.select(*keys, value, F.coalesce(F.col(below), F.lit(0)).cast("long").alias(below), size), [*keys, value])
    return df.join(counted, same([*keys, value], df, counted) & df[value].isNotNull(), "left").select(*df.columns, below, size)
