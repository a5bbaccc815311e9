"""Evaluation metrics (EV) from predictions and gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges


def confusion(df: DataFrame, predicted: Column, gold: Column, *keys: str) -> DataFrame:
    """EV-01/04: tp, fp, fn, tn with precision, recall, F1 and false rates; a ratio without a base is null."""
    one = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    c = grouped.agg(one(predicted & gold, "tp"), one(predicted & ~gold, "fp"), one(~predicted & gold, "fn"), one(~predicted & ~gold, "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def class_metrics(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """EV-02: per class support, predictions, hits, precision and recall."""
    pairs = df.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.struct(F.col(predicted).alias("label"), F.lit(1).alias("p"), F.lit(0).alias("g")), F.struct(F.col(gold).alias("label"), F.lit(0).alias("p"), F.lit(1).alias("g")))).alias("e")
    hit = F.when(F.col(predicted) == F.col(gold), F.col("n")).otherwise(0)
    sums = pairs.select("n", hit.alias("hit"), each).groupBy(F.col("e.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("e.p")).alias("predicted"), F.sum(F.col("n") * F.col("e.g")).alias("gold"), F.sum(F.col("hit") * F.col("e.p")).alias("hits"))
    return sums.select("label", "predicted", "gold", "hits", F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).alias("precision"), F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).alias("recall"))


def ndcg(df: DataFrame, key: str, rank_order: list[Column], relevance: str, cutoff: int | None = None) -> DataFrame:
    """EV-03: gain (2^relevance - 1) / log2(rank + 1) in the given order over that in the ideal order."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*rank_order))).withColumn("_i", F.row_number().over(w.orderBy(F.desc(relevance), *rank_order)))
    gain = lambda r: F.when(F.col(r) <= cutoff if cutoff else F.lit(True), (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col(r) + 1.0)).otherwise(0.0)
    return ranked.groupBy(key).agg(F.sum(gain("_r")).alias("dcg"), F.sum(gain("_i")).alias("ideal")).withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")))


def concordance(df: DataFrame, key: str, score: str, gold: str) -> DataFrame:
    """EV-03: pairs of a group whose scores agree with their gold (concordant), contradict it (discordant) or are equal (tied).

    Pairs are counted, not made.  Golds get dense ranks; two of them part at one bit of their ranks, the highest that differs,
    so at each bit the rows with 1 are compared with those with 0 that share the bits above: running sums over the scores of
    as many cells as values times bits.  A group with one gold only has no pairs and no row."""
    cells = df.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).groupBy(key, score, gold).agg(F.count("*").alias("n"))
    golds = ranges.group_positions(cells.select(key, gold).distinct(), [key], [F.asc(gold)], "_rank", "_golds")
    renamed = golds.select(F.col(key).alias("_k"), F.col(gold).alias("_g"), "_rank", "_golds")
    ranked = cells.join(renamed, cells[key].eqNullSafe(F.col("_k")) & (cells[gold] == F.col("_g"))).where("_golds > 1").select(key, score, "n", "_rank", F.length(F.bin(F.col("_golds") - 1)).alias("_bits"))
    level = ranked.select(key, score, "n", "_rank", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_level"))
    bit = F.expr("shiftright(_rank, _level) & 1")
    parted = level.groupBy(key, "_level", F.expr("shiftright(_rank, _level + 1)").alias("_prefix"), score).agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("_low"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("_high"))
    met = ranges.running(parted, [key, "_level", "_prefix"], [F.asc(score)], {"_below": (F.col("_low"), "sum")}, {"_all": F.col("_low")}).withColumn("_below", F.coalesce("_below", F.lit(0)))
    high = F.col("_high")
    return met.groupBy(key).agg(F.sum(high * F.col("_below")).alias("concordant"), F.sum(high * (F.col("_all") - F.col("_below") - F.col("_low"))).alias("discordant"), F.sum(high * F.col("_low")).alias("tied"))


def ordered_difference(left: DataFrame, right: DataFrame, key: str, rank: str, item: str) -> DataFrame:
    """EV-17: first rank at which two ordered lists differ, and members of one side only."""
    l, r = left.select(key, rank, F.col(item).alias("_l")), right.select(key, rank, F.col(item).alias("_r"))
    at = l.join(r, [key, rank], "full").groupBy(key).agg(F.min(F.when(~F.col("_l").eqNullSafe(F.col("_r")), F.col(rank))).alias("first_mismatch"))
    members = left.select(key, F.col(item).alias("_x"), F.lit(1).alias("_a")).distinct().join(right.select(key, F.col(item).alias("_x"), F.lit(1).alias("_b")).distinct(), [key, "_x"], "full")
    sides = members.groupBy(key).agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right"))
    return at.join(sides, key)


def refresh_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """EV-18, UI-01: unchanged, changed, new or removed by key."""
    o, n = old.select(*keys, F.col(value).alias("_o"), F.lit(1).alias("_in_o")), new.select(*keys, F.col(value).alias("_n"), F.lit(1).alias("_in_n"))
    state = F.when(F.col("_in_o").isNull(), "new").when(F.col("_in_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, state.alias("state"))


def discordant_pairs(df: DataFrame, key: str, item: str, score: str, gold: str, most: int = 50) -> DataFrame:
    """EV-05: key, worse, better, gold_gap, score_gap, rank: pairs of a group whose scores contradict their gold, the widest gold
    gaps first, then the widest score gaps, then better and worse; ``most`` a group are reported.

    Best first: the widest pair of each better row is found by running minima, and only the ``most`` rows with the widest
    ones can have pairs in the report; only these meet the group's other rows."""
    rows = df.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).select(F.col(key).alias("_k"), F.col(item).alias("_i"), F.col(score).alias("_s"), F.col(gold).alias("_g"))
    cells = rows.groupBy("_k", "_s").agg(F.min("_g").alias("_least"))
    # the least gold among higher scores
    above = ranges.running(cells, ["_k"], [F.desc("_s")], {"_low": (F.col("_least"), "min")}).where("_low IS NOT NULL").select(F.col("_k").alias("_ka"), F.col("_s").alias("_sa"), "_low")
    wrong = rows.join(above, F.col("_k").eqNullSafe(F.col("_ka")) & (F.col("_s") == F.col("_sa"))).where(F.col("_low") < F.col("_g"))
    # of that gold, the row with the highest score, the first by item
    top = rows.groupBy("_k", "_g").agg(F.max(F.struct(F.col("_s"))).alias("_t")).select(F.col("_k").alias("_kb"), F.col("_g").alias("_gb"), F.col("_t._s").alias("_sb"))
    widest = wrong.join(top, F.col("_k").eqNullSafe(F.col("_kb")) & (F.col("_low") == F.col("_gb")))
    first = Window.partitionBy("_k").orderBy(F.desc(F.col("_g") - F.col("_low")), F.desc(F.col("_sb") - F.col("_s")), "_i")
    better = widest.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("_k", "_i", "_s", "_g")
    a, b = (x.select(F.col("_k").alias(f"k_{n}"), F.col("_i").alias(f"i_{n}"), F.col("_s").alias(f"s_{n}"), F.col("_g").alias(f"g_{n}")) for x, n in ((better, "a"), (rows, "b")))
    pairs = b.join(a, F.col("k_a").eqNullSafe(F.col("k_b"))).where("g_a > g_b AND s_a < s_b").select(F.col("k_a").alias(key), F.col("i_b").alias("worse"), F.col("i_a").alias("better"), (F.col("g_a") - F.col("g_b")).alias("gold_gap"), (F.col("s_b") - F.col("s_a")).alias("score_gap"))
    w = Window.partitionBy(key).orderBy(F.desc("gold_gap"), F.desc("score_gap"), "better", "worse")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


#: What two pronunciations may agree in.
AGREEMENTS = ("exact_phones", "exact_tail", "syllable_count", "stress_pattern", "primary_stress")


def analysis_agreement(left: Column, right: Column, score: Column) -> Column:
    """EV-20: struct of what two analyses agree in and their rhyme score; null without either."""
    same = {"exact_phones": left["phonemes"] == right["phonemes"], "exact_tail": left["exact_key"] == right["exact_key"], "syllable_count": left["syllable_count"] == right["syllable_count"],
            "stress_pattern": left["stress_pattern"] == right["stress_pattern"], "primary_stress": left["primary_stress"] == right["primary_stress"]}
    return F.when(left.isNotNull() & right.isNotNull(), F.struct(*(c.alias(n) for n, c in same.items()), F.round(score, 6).alias("rhyme_score")))


def agreement_stats(df: DataFrame, left_ok: str, right_ok: str, flags: dict[str, str] = {n: n for n in AGREEMENTS}, score: str = "rhyme_score", keys: list[str] = ()) -> DataFrame:
    """EV-14/20: cases, shares of accepted ones on each side, and of those accepted by both the shares that agree and the mean
    rhyme score; percentages to two digits."""
    pct = lambda a, b: F.when(b > 0, F.round(a * 100.0 / b, 2)).otherwise(0.0)
    both = F.col(left_ok) & F.col(right_ok)
    sums = df.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(F.col(left_ok)).alias("_l"), F.count_if(F.col(right_ok)).alias("_r"), F.count_if(both).alias("both_accepted"),
                                 *(F.count_if(both & F.col(c)).alias(f"_{n}") for n, c in flags.items()), F.sum(F.when(both, F.col(score))).alias("_s"))
    n = F.col("both_accepted")
    return sums.select(*keys, "cases", pct(F.col("_l"), F.col("cases")).alias("left_pct"), pct(F.col("_r"), F.col("cases")).alias("right_pct"), "both_accepted", *(pct(F.col(f"_{k}"), n).alias(f"{k}_pct") for k in flags),
                       F.when(n > 0, F.round(F.col("_s") / n, 6)).otherwise(0.0).alias("mean_rhyme_score"))


def score_calibration(df: DataFrame, score: str, correct: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """EV-14: for each share of the cases with a score (lower is better): the threshold that keeps it, what it keeps, and how
    much of that is correct.  Cases are counted per score, so sums run over different scores only."""
    cells = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("ok"))
    w = Window.orderBy(score)  # different scores of an evaluation
    past = cells.withColumn("kept", F.sum("n").over(w)).withColumn("right", F.sum("ok").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    each = past.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where(F.col("kept") >= F.greatest(F.lit(1), F.ceil(F.col("all") * F.col("share"))))
    first = each.groupBy("share").agg(F.min(F.struct(score, "kept", "right", "all")).alias("x"))
    return first.select("share", F.col(f"x.{score}").alias("threshold"), F.col("x.kept").alias("retained"), F.round(F.col("x.kept") * 100 / F.col("x.all"), 2).alias("retained_pct"), F.round(F.col("x.right") * 100 / F.col("x.kept"), 2).alias("correct_pct"))


def best_threshold(df: DataFrame, score: str, correct: str, least_pct: float) -> DataFrame:
    """EV-14: the threshold that keeps most cases while ``least_pct`` of them are correct; no row if none does."""
    cells = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("ok"))
    w = Window.orderBy(score)
    past = cells.select(F.col(score).alias("threshold"), F.sum("n").over(w).alias("retained"), F.sum("ok").over(w).alias("right"))
    return past.where(F.round(F.col("right") * 100 / F.col("retained"), 2) >= least_pct).orderBy(F.desc("retained"), "threshold").limit(1)


def plan_lines(df: DataFrame, *wanted: str) -> dict[str, bool]:
    """EV-15: whether each of the texts (PushedFilters, BroadcastHashJoin, WindowGroupLimit ..) stands in the physical plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {w: w in plan for w in wanted}


def page_quality(page: DataFrame, key: str, rank: str, form: str, lemma: str, query_lemma: str, family: str, usage: str, rare: Column, cutoff: int = 20) -> DataFrame:
    """EV-06/16: of the first results: repeated forms, rows of the query's lemma, families on several rows, near copies
    (neighbouring spelling of .80 and more to an earlier row), unranked and rarely used rows, rare or historical ones."""
    top = page.where(F.col(rank) <= cutoff)
    sets = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.lower(form).alias("f")))).alias("p"))
    alike = lambda a, b: 1.0 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
    near = F.size(F.filter("p", lambda x: F.exists("p", lambda y: (y["r"] < x["r"]) & (y["f"] != x["f"]) & (alike(x["f"], y["f"]) >= 0.80))))
    copies = F.size("p") - F.size(F.array_distinct(F.transform("p", lambda x: x["f"])))
    families = top.where(F.col(family).isNotNull() & (F.col(family) != "")).groupBy(key, family).agg(F.count("*").alias("n")).where("n > 1").groupBy(key).agg(F.sum(F.col("n") - 1).alias("repeated_families"))
    rows = top.groupBy(key).agg(F.count("*").alias("results"), F.count_if((F.col(lemma) == F.col(query_lemma)) & (F.col(lemma) != "")).alias("same_lemma"), F.count_if(F.col(usage).isNull()).alias("unranked"),
                                F.count_if(F.col(usage) > 100_000).alias("over_100k"), F.count_if(F.col(usage) > 250_000).alias("over_250k"), F.count_if(rare).alias("rare"))
    own = sets.select(key, copies.cast("long").alias("repeated_forms"), near.cast("long").alias("near_copies"))
    return rows.join(own, key).join(families, key, "left").withColumn("repeated_families", F.coalesce("repeated_families", F.lit(0)))


def retention(writer: DataFrame, legacy: DataFrame, key: str, form: str, tier: str) -> DataFrame:
    """EV-16: of an older engine's results of the best tier, how many the new one has: rows, retained and share (1 without any)."""
    best = legacy.where(F.col(tier) == 0).select(key, F.lower(form).alias("_f"))
    have = writer.select(key, F.lower(form).alias("_f")).distinct().withColumn("_in", F.lit(1))
    c = best.join(have, [key, "_f"], "left").groupBy(key).agg(F.count("*").alias("rows"), F.count("_in").alias("retained"))
    every = legacy.select(key).distinct().join(c, key, "left").select(key, *(F.coalesce(x, F.lit(0)).alias(x) for x in ("rows", "retained")))
    return every.withColumn("retention", F.when(F.col("rows") > 0, F.round(F.col("retained") / F.col("rows"), 4)).otherwise(1.0))


def regressions(page: DataFrame, rules: DataFrame, key: str, form: str, rank: str, kind: str, cheap: str) -> DataFrame:
    """EV-16: failures of each rule (key, candidate, max_rank, allowed types, max_cheap; nulls ask nothing)."""
    rows = page.select(key, F.lower(form).alias("_f"), F.col(rank).alias("_r"), F.col(kind).alias("_k"), F.col(cheap).alias("_c"))
    met = rules.join(rows, (rules[key] == rows[key]) & (F.lower(rules["candidate"]) == rows["_f"]), "left").drop(rows[key])
    failures = F.array_compact(F.array(F.when(F.col("_f").isNull(), "candidate_missing"), F.when(F.col("_r") > F.col("max_rank"), "rank_too_low"),
                                       F.when(F.col("_f").isNotNull() & F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.col("_k")), F.lit(False)), "primary_type_mismatch"),
                                       F.when(F.coalesce("_c", F.lit(0)) > F.col("max_cheap"), "cheap_tier_penalty_too_high")))
    return met.select(key, "candidate", failures.alias("failures"))


def judged_ndcg(page: DataFrame, key: str, rank: str, relevance: str, reviews: DataFrame, cutoff: int) -> DataFrame:
    """EV-16: nDCG at a cutoff over judgements 0..4; pending unless every row of a full page is judged.  ``reviews``: key and
    relevance of all judged candidates, of which the ideal page is made."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    seen = page.where(F.col(rank) <= cutoff).groupBy(key).agg(F.count("*").alias("required"), F.count(relevance).alias("judged"), F.sum(gain(F.col(relevance), F.col(rank))).alias("_dcg"))
    best = reviews.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(relevance)))).where(F.col("_i") <= cutoff).groupBy(key).agg(F.sum(gain(F.col(relevance), F.col("_i"))).alias("_ideal"))
    done = (F.col("required") == cutoff) & (F.col("judged") == cutoff)
    return seen.join(best, key, "left").select(key, "required", "judged", F.when(done, "ok").otherwise("pending_reference").alias("status"),
                                               F.when(done, F.when(F.col("_ideal") > 0, F.round(F.col("_dcg") / F.col("_ideal"), 4)).otherwise(1.0)).alias("ndcg"))


def gates(metrics: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """EV-16: metric, value and whether it lies within its limits (least, most) of a one-row table."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), ((F.lit(True) if lo is None else F.col(m) >= lo) & (F.lit(True) if hi is None else F.col(m) <= hi)).alias("passed")) for m, (lo, hi) in limits.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def ranking_experiment(df: DataFrame, key: str, policies: dict[str, list[Column]], relevance: str, baseline: str) -> DataFrame:
    """EV-19: policy, mean nDCG over the queries and its difference to the baseline policy."""
    out = None
    for name, order in policies.items():
        own = ndcg(df, key, order, relevance).agg(F.avg("ndcg").alias("mean_ndcg")).withColumn("policy", F.lit(name))
        out = own if out is None else out.unionByName(own)
    base = out.where(F.col("policy") == baseline).select(F.col("mean_ndcg").alias("_b"))
    return out.crossJoin(F.broadcast(base)).select("policy", F.round("mean_ndcg", 6).alias("mean_ndcg"), F.round(F.col("mean_ndcg") - F.col("_b"), 4).alias("delta"))  # a row a policy, and one


def repeatability(runs: DataFrame, run: str, key: str, fingerprint: str) -> DataFrame:
    """EV-21: run, key, expected and observed fingerprints where a run differs from the first."""
    first = runs.agg(F.min(run).alias("_first"))
    marked = runs.crossJoin(F.broadcast(first))  # one row
    base = marked.where(F.col(run) == F.col("_first")).select(key, F.col(fingerprint).alias("expected"))
    others = marked.where(F.col(run) != F.col("_first"))
    grid = others.select(run).distinct().crossJoin(F.broadcast(base.select(key))).unionByName(others.select(run, key)).distinct()  # runs are few
    met = grid.join(base, key, "left").join(others.select(run, key, F.col(fingerprint).alias("observed")), [run, key], "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("observed"))).select(run, key, "expected", "observed")


def blind_export(tasks: DataFrame, key: str, shown: list[str], seed: str) -> DataFrame:
    """EV-24: tasks for review without what the engine thinks of them, under ids that do not tell their order."""
    from klangwerk.functions.text import stable_score

    return tasks.select(F.left(stable_score(seed, F.col(key)), F.lit(16)).alias("blind_id"), *shown)
