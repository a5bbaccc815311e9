"""The decoder against its rules on a small model."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from klangwerk.operators import beam as B
from klangwerk.operators import corpus as C
from klangwerk.operators import decoder as D
from klangwerk.operators import workspace as W
from tests import local_decoder as LD

LINES = ["the cat sat on the mat", "the dog sat on the hat", "a cat ran to the mat", "a dog ran to the hat", "the cat ran on"]


@pytest.fixture(scope="module")
def model(spark):
    tokens = spark.createDataFrame([(x.split(),) for x in LINES], "tokens array<string>")
    return LD.Model.of(D.continuations(C.transitions(tokens, 3)), D.continuations(D.backward_counts(tokens, 3)), 3)


def tables_of(spark, lines, order, k=128):
    tokens = spark.createDataFrame([("m", x.split()) for x in lines], "model string, tokens array<string>")
    return B.build(D.continuations(C.transitions(tokens, order, "model"), k, "model"), D.continuations(D.backward_counts(tokens, order, "model"), k, "model"), order, buckets=3)


@pytest.fixture(scope="module")
def tables(spark):
    return tables_of(spark, LINES, 3)


def test_model_counts_both_directions(model):
    forward, reverse = Counter(), Counter()
    for line in LINES:
        t = ["<s>"] * 3 + line.split() + ["</s>"]
        for i in range(3, len(t)):
            for k in (1, 2, 3):
                forward[" ".join(t[i - k : i]), t[i]] += 1
        u = ["<s>"] + line.split() + ["</s>"] * 3
        for i in range(len(u) - 3):
            for k in (1, 2, 3):
                reverse[" ".join(u[i + 1 : i + 1 + k]), u[i]] += 1
    got = lambda d: {(c, t): n for (x, c), row in model.rows.items() if x == d for t, n in row.items()}
    assert got("forward") == dict(forward) and got("reverse") == dict(reverse)


def test_random_and_plans_repeat():
    a, b = D.seeded_random("x"), D.seeded_random("x")
    draws = [a() for _ in range(1000)]
    assert draws == [b() for _ in range(1000)] and 0 <= min(draws) < max(draws) < 1 and abs(sum(draws) / 1000 - 0.5) < 0.05 and D.seeded_random("y")() != draws[0]
    assert D.string_hash("") == 2166136261 and D.string_hash("a") == 0xE40C292C
    plan = D.plan_section("verse", 6, 40, "aab", 3)
    assert [p["slot"] for p in plan] == list("AABAAB") and all(27 <= p["tokens"] <= 28 for p in plan) and {p["tokens"] for p in D.plan_section("hook", 5, 7)} == {7}
    profile = {"start": {"intro": 1}, "end": {"outro": 1}, "transitions": {"intro": {"verse": 1}, "verse": {"verse": 0.5, "outro": 0.5}, "outro": {}}, "sections": {"verse": {"lines": 8, "tokens": 7}}}
    song = D.plan_song(profile, 4, seed=5)
    assert song == D.plan_song(profile, 4, seed=5) and song[0]["type"] == "intro" and len(song) == 4 and all(len(s["lines"]) == (8 if s["type"] == "verse" else 4) for s in song)


def test_beam_uses_seen_transitions_and_bridges(model):
    for line in LD.reverse_beam(model, ["mat"], "1", D.Controls(target=6)):
        t = line["tokens"]
        assert len(t) == 6 and t[-1] == "mat" and all(model.probability("reverse", t[i + 1 :] + ["</s>"], t[i])[0] > 0 for i in range(5))
    opened = LD.reverse_beam(model, ["mat"], "1", D.Controls(target=6, opening=("the",)))
    assert opened and all(x["tokens"][0] == "the" and model.probability("forward", ["the"], x["tokens"][1])[0] > 0 for x in opened)
    assert LD.reverse_beam(model, ["mat"] * 7, "1", D.Controls(target=6)) == [] and LD.reverse_beam(model, ["zzz"], "1", D.Controls(target=4)) == []
    assert LD.reverse_beam(model, ["on", "the", "mat"], "1", D.Controls(target=3))[0]["tokens"] == ["on", "the", "mat"]
    assert {t for t, *_ in model.bridges(["the"], ["sat"])} == {"cat", "dog"} and model.bridges(["zzz"], ["sat"]) == []


def many_lines(n=300, seed=11):
    import random

    rng, words = random.Random(seed), [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("c", [D.Controls(target=6), D.Controls(target=5, weirdness=1.0, naturalness=0.1), D.Controls(target=7, opening=("w1", "w0")), D.Controls(target=4, opening=("w3",), weirdness=0.0)])
def test_beam_of_tables_is_the_local_beam(spark, c):
    lines = many_lines()
    tables = tables_of(spark, lines, 3, 20)
    local = LD.Model.of(tables.forward, tables.backward, 3)
    tails = [["w0"], ["w2", "w1"], ["w39"], ["nowhere"], ["w0"] * 6, ["w5", "w5", "w5"], ["w1", "w2", "w3", "w4"]]
    beams = spark.createDataFrame([(i, "m", t, f"s{i}") for i, t in enumerate(tails)] + [(99, "another", ["w0"], "s")], "beam long, model string, tail array<string>, seed string")
    got = {}
    for r in B.search(beams, tables, c).orderBy("beam", "place").collect():
        got.setdefault(r.beam, []).append((r.tokens, r.prefix, round(r.context_mean, 9)))
    want = {i: [(x["tokens"], x["prefix"], round(x["context_mean"], 9)) for x in found] for i, t in enumerate(tails) if (found := LD.reverse_beam(local, t, f"s{i}", c))}
    assert len(want) > 1 and got == want


def test_beam_joins_the_model_without_moving_it(spark):
    tables = tables_of(spark, many_lines(50), 2)
    asked = spark.createDataFrame([(1, "m", ["w0"], "s")], "beam long, model string, tail array<string>, seed string")
    frontier = asked.selectExpr("*", "array() AS opening", "4 AS missing", "CAST(array() AS array<string>) AS prefix", "'' AS state", "0.0D AS score", "0 AS depth")
    plan = B._options(frontier, tables, D.Controls(), 0)._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("FileScan parquet spark_catalog")].splitlines()
    assert "Python" not in plan and not any("Exchange" in x for x in scan[-3:])


def test_entities_take_the_place_of_words(spark, model, tables):
    c = D.Controls(target=6)
    line = LD.reverse_beam(model, ["mat"], "1", c)[0]
    entities = [{"tokens": ["dog"], "quality": 0.9}, {"tokens": ["never", "seen"], "quality": 0.8}, {"tokens": ["a", "cat"], "quality": 0.7}]
    want = LD.with_entities(model, line, entities, "s")
    rows = spark.createDataFrame([(7, "m", line["tokens"], line["prefix"], 0, "s")], "id long, model string, tokens array<string>, prefix array<string>, lead int, seed string")
    e = spark.createDataFrame([("m", x["tokens"], x["quality"]) for x in entities], "model string, entity array<string>, quality double")
    got = B.with_entities(rows, e, tables, "id").orderBy("place").collect()
    assert [r.tokens for r in got] == [x["tokens"] for x in want] and len(want) > 1
    assert [round(r.entity_quality, 9) for r in got[1:]] == [round(x["entity"], 9) for x in want[1:]]


def test_drafts_are_diverse():
    draft = lambda t, u, form, family=None: {"tokens": t.split(), "utility": u, "natural": u, "form": form, "family": family}
    a, b, c = draft("the cat sat", 0.9, "sat"), draft("a cat sat", 0.89, "sat"), draft("my dog ran", 0.5, "ran")
    got = D.diverse_drafts([b, c, a], 3)
    assert [x["form"] for x in got] == ["sat", "ran"] and [x["rank"] for x in got] == [1, 2]
    assert D.draft_similarity(a, b) == 1.0 and D.draft_similarity(a, c) == 0.0
    assert D.draft_similarity(a, draft("the cat sat", 0.1, "other")) == pytest.approx(1.0) and D.draft_similarity(draft("x y", 1, "p", "f"), draft("z y", 1, "q", "f")) == pytest.approx(0.42 / 3 + 0.2 + 0.08)


def test_choice_avoids_what_was_used():
    rows = [{"form": f, "final": f, "family": f, "quality": 0.5} for f in "abcd"]
    used, draw = {}, D.seeded_random(9)
    seen = Counter(D.choose(rows, draw, D.Controls(), used)["form"] for _ in range(400))
    assert set(seen) == set("abcd") and max(seen.values()) < 150 and used["form", "a"] == seen["a"] and D.choose([], draw, D.Controls(), used) is None


def test_generated_lines_are_the_local_ones(spark):
    lines = many_lines()
    tables = tables_of(spark, lines, 2, 20)
    local = LD.Model.of(tables.forward, tables.backward, 2)
    rows = [(q, "m", f"w{i}", f"w{i}", [f"w{i}"], 1 - i / 50, 0.5, 0.4 + i / 100) for q, n in (("q", 6), ("r", 1), ("s", 3)) for i in range(n)] + [("t", "m", "zz", "zz", ["zz"], 1.0, 1.0, 1.0)]
    pool = spark.createDataFrame(rows, "query string, model string, surface string, normalized string, tokens array<string>, phonetic double, usage double, support double").withColumn("kind", F.lit("word"))
    reservoirs = D.tail_reservoir(pool, "query").cache()
    c, got = D.Controls(target=5), {}
    for r in B.generate(tables, reservoirs, "query", c, count=3, most=20).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.line, r.form, r.utility, r.natural))
    want = {}
    for q in "qrst":
        own = [r.asDict() for r in reservoirs.where(F.col("query") == q).orderBy("place").collect()]
        tails = [{"form": r["normalized"], "final": r["tokens"][-1], "family": " ".join(r["tokens"][-2:]), "tokens": r["tokens"], **{k: r[k] for k in ("quality", "phonetic", "usage", "support")}} for r in own]
        found = LD.generate_lines(local, tails, c, 3, 20, f"1337|{q}")
        if found:
            want[q] = [(" ".join(d["tokens"]), d["form"], d["utility"], d["natural"]) for d in found]
    assert set(want) == set("qrs") and {q: [x[:2] for x in v] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items()}
    assert all(x[2:] == pytest.approx(y[2:], abs=2e-6) for q in want for x, y in zip(got[q], want[q]))


def test_gaps_make_no_neighbours(spark):
    lines = spark.createDataFrame([(1, "g", "a b x c a b".split()), (2, "g", ["x", "x"]), (3, "h", "a x".split())], "line long, model string, tokens array<string>")
    known = spark.createDataFrame([("g", w) for w in "abc"] + [("h", "a"), ("h", "x")], "model string, form string")
    held = {r.line: r.tokens for r in C.within_vocabulary(lines, "line", "tokens", known, "model").collect()}
    assert held == {1: ["a", "b", None, "c", "a", "b"], 2: [None, None], 3: ["a", "x"]}
    got = Counter({(r.model, r.context, r.next): r.n for r in C.transitions(C.within_vocabulary(lines, "line", "tokens", known, "model"), 2, "model", gaps=True).collect()})
    want = Counter()
    for model, tokens in (("g", held[1]), ("g", held[2]), ("h", held[3])):
        t = ["<s>", "<s>", *tokens, "</s>"]
        for i in range(2, len(t)):
            want.update((model, " ".join(t[i - k : i]), t[i]) for k in (1, 2) if None not in t[i - k : i + 1])
    assert got == want and ("g", "b", "c") not in got


def test_reservoir_compares_to_nine_decimals(spark):
    """Last bits of a sum order nothing; of rows that are equal in all that is compared, the ties decide."""
    rows = [("q", "word", "b", "b", 0.5, 0.5, 0.5), ("q", "word", "a", "a", 0.5, 0.5 - 1e-12, 0.5), ("q", "phrase", "c", "c", 0.4, 0.9, 0.9), ("q", "word", "c", "c", 0.4, 0.9, 0.9)]
    for own in (rows, rows[::-1]):
        pool = spark.createDataFrame(own, "query string, kind string, normalized string, surface string, phonetic double, usage double, support double").repartition(3)
        got = [(r["surface"], r["kind"]) for r in D.tail_reservoir(pool, "query").orderBy("place").collect()]
        assert got == [("c", "phrase"), ("c", "word"), ("a", "word"), ("b", "word")]


def test_model_is_counted_once(spark):
    """What the tables are made of is worked out once, however often their rows are read."""
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    mark = F.udf(seen, "string").asNondeterministic()
    rows = spark.createDataFrame([("m", "a", "b", 2), ("m", "a", "c", 1), ("m", "b", "a", 1)], "model string, context string, next string, n long").withColumn("model", mark("model"))
    tables = B.build(rows, rows.select("model", F.col("next").alias("context"), F.col("context").alias("next"), "n"), 1, buckets=2)
    assert sorted((r.context, r.next, r.n, r.total, r.place) for r in tables.forward.collect()) == [("a", "b", 2, 3, 1), ("a", "c", 1, 3, 2), ("b", "a", 1, 1, 1)] and read.value == 6


@pytest.mark.parametrize("order", [1, 2, 3])
def test_grams_give_both_directions(spark, order):
    """Grams that are counted once give what each direction counts by itself."""
    rows = [("g", "a b a b c".split()), ("g", ["a", None, "b", "c"]), ("g", [None, None, "a"]), ("g", ["a"]), ("g", [None]), ("h", "a b".split()), ("h", ["b", "b", None])]
    tokens = spark.createDataFrame(rows, "model string, tokens array<string>").repartition(3)
    found = lambda df: Counter({(r.model, r.length, r.context, r.next): r.n for r in df.collect()})
    ahead, behind = C.both_transitions(C.both_counts(tokens, order, "model", gaps=True), order, "model")
    assert found(ahead) == found(C.transitions(tokens, order, "model", gaps=True))
    assert found(behind) == found(D.backward_counts(tokens, order, "model", gaps=True))


def test_vocabulary_sent_or_joined(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "gh"[i % 2], [None if j % 5 == 4 else f"w{(i * j) % 9}" for j in range(i % 6)]) for i in range(200)]
    lines = spark.createDataFrame(rows, "line long, model string, tokens array<string>").repartition(3)
    known = spark.createDataFrame([("g", f"w{j}") for j in range(0, 9, 2)] + [("h", "w1"), ("h", "w8"), (None, "w2")], "model string, form string")
    found = []
    for most in (500_000, 0):
        monkeypatch.setattr(C, "MAX_BROADCAST_WORDS", most)
        df = C.within_vocabulary(lines, "line", "tokens", known, "model")
        assert ("MapInArrow" in df._jdf.queryExecution().toString()) == bool(most)
        found.append((df.dtypes, sorted((r.line, r.model or "", [x or "" for x in r.tokens]) for r in df.collect())))
    assert found[0] == found[1] and len(found[0][1]) > 100


def test_model_stays_in_its_buckets(spark, tables, monkeypatch):
    """A step moves what it asks for, not the model; and what the tables were made of is gone."""
    monkeypatch.setattr(B, "MAX_BROADCAST_WORDS", 0)
    for t in (tables, tables_of(spark, LINES, 3)):
        asked = spark.createDataFrame([("m", "the")], "model string, context string").repartition(5)
        plan = asked.hint("merge").join(t.backward, ["model", "context"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        folder = t.backward.inputFiles()[0].rsplit("/", 2)[0]
        assert not any(W.exists(spark, f"{folder}/counted-{x}") for x in ("forward", "backward"))
    assert sorted(t.backward.collect()) == sorted(tables.backward.collect())


def test_most_cuts_before_totals(spark):
    tokens = spark.createDataFrame([("m", x.split()) for x in LINES], "model string, tokens array<string>")
    cut = tables_of(spark, LINES, 2, 2)
    whole = B.build(*C.both_transitions(C.both_counts(tokens, 2, "model"), 2, "model"), 2, buckets=3, most=2)
    for x, y in ((cut.forward, whole.forward), (cut.backward, whole.backward)):
        assert sorted(x.collect()) == sorted(y.collect()) and x.count()
