"""Ranks, concordance and contradictions in groups of any size against windows and all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from klangwerk.operators import evaluation as E
from klangwerk.operators import ranges as G
from klangwerk.operators import ranking as R


@pytest.fixture(scope="module")
def hot(spark):
    """One group with most rows, one value with a third of them, null keys and null values."""
    rng = random.Random(9)
    rows = [("hot", i, 7.0 if i % 3 == 0 else rng.uniform(0, 20)) for i in range(6000)]
    rows += [(k, 10_000 + i, rng.choice([None, 1.0, 2.0, 3.0])) for i, k in enumerate(["a", "b", None, "c"] * 40)] + [("single", 20_000, 5.0), ("none", 20_001, None), ("twice", 20_002, 1.0), ("twice", 20_002, 1.0)]
    return spark.createDataFrame(rows, "k string, id long, v double").repartition(8)


@pytest.fixture()
def eight(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_equal_one_window(hot, eight):
    order = [F.desc_nulls_last("v"), F.asc("id")]
    own = Window.partitionBy("k")
    want = Counter(map(tuple, hot.select("k", "id", "v", (F.row_number().over(own.orderBy(*order)) - 1).cast("long").alias("p"), F.count("*").over(own)).collect()))
    placed = G.group_positions(hot, ["k"], order)
    assert Counter(map(tuple, placed.select("k", "id", "v", "position", "size").collect())) == want
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy(*order)) - 1
    plain = hot.withColumn("percentile", F.when(n == 1, F.lit(1.0)).otherwise(1.0 - i / (n - 1)))
    assert Counter(map(tuple, R.rank_percentile(hot, ["k"], order).select("k", "id", "v", "percentile").collect())) == Counter(map(tuple, plain.select("k", "id", "v", "percentile").collect()))


def test_a_hot_group_is_dealt_over_many_ranges(hot, eight, monkeypatch):
    seen = []
    keep = G.W.settled
    monkeypatch.setattr(G.W, "settled", lambda df, path: seen.append(keep(df, path)) or seen[-1])
    G.group_positions(hot, ["k"], [F.asc("v"), F.asc("id")]).count()
    sizes = sorted((r["count"] for r in seen[0].where("k = 'hot'").groupBy("_range").count().collect()), reverse=True)
    assert len(sizes) >= 6 and sizes[0] < 6000 / 3


def test_smaller_values_equal_one_window(hot, eight):
    own = Window.partitionBy("k", F.col("v").isNotNull())
    n, below = F.count("*").over(own), F.rank().over(own.orderBy("v")).cast("long") - 1
    plain = F.when(F.col("v").isNull(), F.lit(0)).when(n == 1, F.lit(1_000_000)).otherwise(F.floor((below * 2_000_000 + (n - 1)) / (2 * (n - 1)))).cast("long")
    want = Counter(map(tuple, hot.select("k", "id", "v", plain).collect()))
    assert Counter(map(tuple, R.tie_percentile_ppm(hot, ["k"], "v").select("k", "id", "v", "ppm").collect())) == want


def test_running_minimum(hot, eight):
    own = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    df = hot.dropDuplicates(["k", "id"])
    want = Counter(map(tuple, df.select("k", "id", F.min("v").over(own), F.max("v").over(own)).collect()))
    got = G.running(df, ["k"], [F.asc("id")], {"low": (F.col("v"), "min"), "high": (F.col("v"), "max")})
    assert Counter(map(tuple, got.select("k", "id", "low", "high").collect())) == want


def judged(spark, golds):
    rng = random.Random(len(golds))
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.randint(0, 12)), rng.choice(golds)) for k in ("x", "y", None) for i in range(90)] + [("alone", 1, 1.0, 1.0), ("empty", 1, None, None)]
    return rows, spark.createDataFrame(rows, "k string, id long, s double, g double")


@pytest.mark.parametrize("golds", [[0.0, 1.0], [None, 0.0, 1.0, 2.0, 3.0, 4.0], [i / 7 for i in range(60)]])
def test_concordance_and_contradictions_equal_all_pairs(spark, eight, golds):
    rows, df = judged(spark, golds)
    want, pairs = {}, {}
    for k, i, s, g in rows:
        for l, j, t, h in rows:
            if k == l and None not in (s, g, t, h) and g > h:
                want.setdefault(k, Counter())["concordant" if s > t else "discordant" if s < t else "tied"] += 1
                if s < t:
                    pairs.setdefault(k, []).append((h - g, s - t, i, j))
    got = {r.k: Counter({c: r[c] for c in ("concordant", "discordant", "tied") if r[c]}) for r in E.concordance(df, "k", "s", "g").collect()}
    assert got == want
    for most in (1, 8, 5000):
        found = {}
        for r in E.discordant_pairs(df, "k", "id", "s", "g", most).orderBy("k", "rank").collect():
            found.setdefault(r.k, []).append((-r.gold_gap, -r.score_gap, r.better, r.worse))
        assert found == {k: sorted(p)[:most] for k, p in pairs.items()}


def test_empty_groups(spark):
    none = spark.createDataFrame([], "k string, id long, s double, g double")
    assert G.group_positions(none, ["k"], [F.asc("id")]).collect() == [] and E.concordance(none, "k", "s", "g").collect() == [] and E.discordant_pairs(none, "k", "id", "s", "g").collect() == []
