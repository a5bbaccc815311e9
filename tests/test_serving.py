"""Rate limits, caches, backups, resolvers, the derivation lexicon and morphology on small data."""

import pytest
from pyspark.sql import functions as F

from klangwerk.operators import aggregates as A
from klangwerk.operators import evaluation as E
from klangwerk.operators import morphology as M
from klangwerk.operators import policies as P
from klangwerk.operators import ranking as R
from klangwerk.operators import serving as S
from klangwerk.sources import readers


def test_rate_limiter_refills_and_forgets():
    at = [0.0]
    r = S.RateLimiter(2, 1, most=2, idle=10, now=lambda: at[0])
    assert [r.take("a")[0] for _ in range(3)] == [True, True, False] and r.take("a")[1] == pytest.approx(1.0)
    at[0] = 1.0
    assert r.take("a") == (True, 0.0) and not r.take("a")[0]
    r.take("b"), r.take("c")
    assert len(r.buckets) == 2 and "a" not in r.buckets
    at[0] = 100.0
    r.take("d")
    assert list(r.buckets) == ["d"]


def test_cache_keeps_the_last_used():
    c, calls = S.LastUsed(8), []
    load = lambda k: lambda: calls.append(k) or k
    assert c.get(0, load(0)) == (0, False) and c.get(0, load(0)) == (0, True)
    for k in range(1, 9):
        c.get(k, load(k))
    assert c.get(0, load(0)) == (0, False) and len(c.kept) == 8
    with pytest.raises(ZeroDivisionError):
        c.get("x", lambda: 1 / 0)
    assert "x" not in c.kept


def test_backup_round_trip_and_limits():
    text = S.export_backup("song", [("a", "line ü"), ("b", "")], {"theme": "dark"})
    assert S.import_backup(text) == {"document": "song", "bars": [("a", "line ü"), ("b", "")], "preferences": {"theme": "dark"}}
    for bad in ("{}", "[]", text.replace('"version": 1', '"version": 9'), text.replace('"id": "b"', '"id": "a"'), text.replace("line ü", "x" * 5000)):
        with pytest.raises(ValueError):
            S.import_backup(bad)


def test_resolver_is_asked_once_for_each_value(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "w string, n int").coalesce(1)

    def resolver():
        opened = []
        return lambda values: opened.append(1) or [f"{v}/{len(opened)}" for v in values]

    got = {r.n: r.ipa for r in S.resolved_by(df, "w", resolver, "ipa").collect()}
    assert got == {1: "a/1", 2: "b/1", 3: None, 4: "a/1"}
    row = spark.range(1).select(S.build_stamp().alias("t"), S.json_array(F.lit('["a","b"]')).alias("a"), S.json_array(F.lit("no")).alias("b"), S.json_object(F.lit(None).cast("string")).alias("c")).first()
    assert len(row.t) == 20 and row.t.endswith("Z") and row.a == ["a", "b"] and row.b == [] and row.c == {}


LINES = ["35 US: A Bv: colour <n/m>: colours, (A: colored | B: coloured), - # a note", "50: @thou {2} (old): thee", "60 GB AU: -whilst", "# comment", "no size: x", "10", "", None, "70: A-: wrang <v>: wranged!, (one, two)", "80: -"]


def test_derivation_lexicon(spark):
    got = readers.derivation_lexicon(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert [(r["size"], r.region, r.lemma, r.pos, r.pos_class, r.archaic, r.uncommon, r.invalid, r.derived) for r in got] == [
        (35, "US", "colour", "n/m", "m", False, False, False, ["colours", "colored", "coloured"]), (50, None, "thou", None, None, True, False, False, ["thee"]),
        (60, "GB", "whilst", None, None, False, True, False, []), (70, None, "wrang", "v", None, False, False, True, ["wranged", "one, two"])]
    assert [(v.spelling, v.level) for v in got[0].variants] == [("A", 0), ("B", 4)]


def test_morphology(spark):
    lex = spark.createDataFrame([("haus", 5, ["noun"]), ("tür", 4, ["noun"]), ("schloss", 3, ["noun"]), ("walk", 9, ["verb"]), ("boss", 2, ["noun"]), ("bos", 1, ["noun"])], "form string, n long, classes array<string>")
    words = spark.createDataFrame([("haustürschloss",), ("xtürschloss",), ("haustür",), ("walked",), ("bosses",), ("hausing",)], "form string")
    assert {r.form: r.parts for r in M.prefix_cover(words, lex).collect()} == {"haustürschloss": ["haus", "tür", "schloss"], "haustür": ["haus", "tür"]}
    assert {(r.form, r.lemma, r.inflection) for r in M.tagged_inflections(words, lex).collect()} == {("walked", "walk", "d"), ("bosses", "boss", "s")}
    analyses = spark.createDataFrame([("haustür", "a", None), ("haustür", "b", "tür"), ("walked", "a", None), ("bosses", "a", "x"), ("bosses", "b", "y")], "form string, analysis string, head string")
    got = {r.form: (r.state, r.heads, r.evidence) for r in M.compound_evidence(analyses, words, lex).collect()}
    assert got == {"haustür": ("converged", ["tür"], ["attested_split", "stated"]), "walked": ("unresolved", [], []), "bosses": ("conflict", ["x", "y"], ["stated"])}


def test_rules_and_judgements(spark):
    page = spark.createDataFrame([("q", "Maus", 1, "perfect", 0, 4), ("q", "Laus", 2, "slant", 3, 0), ("p", "Tag", 1, "perfect", 0, None)], "k string, form string, r int, type string, cheap int, rel int")
    rules = spark.createDataFrame([("q", "maus", 1, ["perfect"], 0), ("q", "laus", 1, ["perfect"], 1), ("q", "haus", None, None, None), ("p", "tag", None, None, None)], "k string, candidate string, max_rank int, allowed array<string>, max_cheap int")
    got = {(r.k, r.candidate): r.failures for r in E.regressions(page, rules, "k", "form", "r", "type", "cheap").collect()}
    assert got == {("q", "maus"): [], ("q", "laus"): ["rank_too_low", "primary_type_mismatch", "cheap_tier_penalty_too_high"], ("q", "haus"): ["candidate_missing"], ("p", "tag"): []}
    reviews = spark.createDataFrame([("q", 4), ("q", 0), ("q", 3), ("p", 1)], "k string, rel int")
    j = {r.k: (r.status, r.ndcg) for r in E.judged_ndcg(page, "k", "r", "rel", reviews, 2).collect()}
    assert j["p"] == ("pending_reference", None) and j["q"][0] == "ok" and j["q"][1] == round(15 / (15 + 7 / 1.584962500721156), 4)
    g = {r.metric: r.passed for r in E.gates(spark.createDataFrame([(0.5, 3)], "a double, b int"), {"a": (0.4, None), "b": (None, 2)}).collect()}
    assert g == {"a": True, "b": False}
    best = E.best_threshold(spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, True)], "s double, ok boolean"), "s", "ok", 75.0).first()
    assert (best.threshold, best.retained, best["right"]) == (4.0, 4, 3)


def test_percentiles_of_large_groups(spark):
    df = spark.range(6000).select(F.lit("k").alias("k"), (F.col("id") % 3000).alias("v"))
    got = {r.v: r.ppm for r in R.tie_percentile_ppm(df, ["k"], "v").distinct().select("v", "ppm").collect()}
    assert all(got[v] == (2 * v * 2_000_000 + 5999) // (2 * 5999) for v in range(3000))


def test_orders_and_summaries(spark):
    rows = spark.createDataFrame([("ä", 1), ("b", 2), ("a", 3), ("z", 4), ("B", 5)], "word string, id int")
    assert [r.word for r in rows.orderBy(*P.collated_order("word", "de")).collect()] == ["a", "ä", "b", "B", "z"]
    df = spark.createDataFrame([("a", v) for v in [1.0] * 50 + [2.0] * 49 + [100.0]] + [("b", None)], "k string, v double")
    got = {r.k: r for r in A.nearest_rank(df, ["k"], "v").collect()}
    assert set(got) == {"a"} and (got["a"].p50, got["a"].p95, got["a"].largest, got["a"].n) == (1.0, 2.0, 100.0, 100)
    one = A.distribution(df, ["k"], "v", {"q": 0.5}).first()
    assert one.q == 1.5 and one.n == 100
    with pytest.raises(Exception, match="too many"):
        A.pairwise_similarity(spark.range(60).select(F.lit(1).alias("k"), "id"), ["k"], "id", lambda a, b: F.lit(0.0)).collect()


def test_english_order(spark):
    from klangwerk.operators import english as En

    rows = [("q", i, f, 0, p, ["x"] if f in ("cats", "cat") else [f]) for i, (f, p) in enumerate([("cat", 0.95), ("cats", 0.94), ("hat", 0.93), ("mat", 0.90), ("zzz", 0.50)])] + [("q", 9, "best", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "query string, id long, form string, tier int, phonetic double, lemmas array<string>").withColumns({"syllable": F.lit(1.0), "zipf": F.lit(4.0), "usage_rank": F.lit(None).cast("long")})
    ranked = En.banded(En.quality(df), "query")
    assert [(r.form, r.band) for r in ranked.orderBy("rank").collect()] == [("cat", 0), ("cats", 0), ("hat", 0), ("mat", 1), ("zzz", 2), ("best", 0)]
    got = En.diversified(ranked, "query", 4).orderBy("position").collect()
    assert [r.form for r in got] == ["cat", "hat", "cats", "mat"] and got[2].max_redundancy == 0.95
    assert En.redundancy({"form": "a", "lemmas": []}, {"form": "a", "lemmas": []}) == 1.0 and En.redundancy({"form": "", "lemmas": []}, {"form": "a", "lemmas": []}) == 0.0
