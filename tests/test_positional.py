"""Sequences by place and source novelty against brute force, and what their plans shuffle."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from klangwerk.operators import corpus as C
from klangwerk.operators import filters as X
from klangwerk.operators import positional as Z
from klangwerk.operators import relational as O


def shuffled_columns(df):
    """What the exchanges of a plan carry."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [m.group(1) for m in re.finditer(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", plan)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    docs = [(i, rng.choices("a b c d e of".split(), [5, 3, 2, 1, 1, 8], k=rng.randint(0, 60))) for i in range(80)] + [(900, None), (901, []), (902, ["of"] * 3000)]
    patterns = [(100 + i, rng.choices("a b c d e of".split(), k=rng.randint(1, 5))) for i in range(40)] + [(1, []), (2, None), (3, ["nowhere"]), (4, ["of", "nowhere"]), (5, ["of"] * 4), (6, ["e"])]
    return docs, patterns


@pytest.mark.parametrize("most", [500_000, 0])
def test_places_of_patterns(spark, texts, monkeypatch, most):
    monkeypatch.setattr(Z, "MAX_BROADCAST_PAIRS", most)
    docs, patterns = texts
    d, p = spark.createDataFrame(docs, "id long, t array<string>"), spark.createDataFrame(patterns, "pid long, p array<string>")
    got = Counter(tuple(r) for r in O.contained_sequences(d, p, "id", "t", "pid", "p").collect())
    want = Counter((i, j, k) for i, t in docs for j, q in patterns if t and q for k in range(len(t)) if t[k : k + len(q)] == q)
    assert got == want
    df = O.contained_sequences(d, p, "id", "t", "pid", "p")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrayType" not in plan
    for carried in shuffled_columns(df):
        assert not re.search(r"\b_?t(okens)?#", carried)


def test_names_by_phrase(spark):
    names = [(1, "The Old Man", 5), (2, "Old Man River", 9), (3, "Man, old!", 7), (4, "the old man and the sea", 5), (5, None, 1), (6, "", 1), (7, "OLD-MAN", 3)]
    asked = [("old man",), ("THE",), ("sea",), ("",), (None,), ("old man river boat",), ("old-man",)]
    n = spark.createDataFrame(names, "id long, name string, pop long")
    q = spark.createDataFrame(asked, "q string")
    order = [F.desc("pop"), F.asc("id")]
    got = [(r["query"], r.id, r["rank"]) for r in X.name_search(n, "id", "name", q, "q", order).orderBy("query", "rank").collect()]
    assert got == [("THE", 1, 1), ("THE", 4, 2), ("old man", 2, 1), ("old man", 1, 2), ("old man", 4, 3), ("old-man", 7, 1), ("sea", 4, 1)]
    kept = X.name_index(n, "id", "name").cache()
    again = [(r["query"], r.id, r["rank"]) for r in X.name_search(n, "id", "name", q, "q", order, limit=1, index=kept).orderBy("query").collect()]
    assert again == [x for x in got if x[2] == 1]


def brute_novelty(tokens, sources):
    def windows(t):
        return [(n, tuple(t[i : i + n])) for n in range(4, 9) for i in range(len(t) - n + 1)]

    kinds = {}
    for kind, t in sources:
        kinds.setdefault(kind, [set(), set()])
        kinds[kind][0].update(windows(t or []))
        kinds[kind][1].add(tuple(t or []))
    out = {}
    for kind, (known, whole) in kinds.items():
        hits = [w for w in windows(tokens or []) if w in known]
        exact = bool(tokens) and tuple(tokens) in whole
        if hits or exact:
            out[kind] = (exact, max((n for n, _ in hits), default=0), len(hits))
    return out


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_novelty_by_kind(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MAX_BROADCAST_WINDOWS", most)
    rng = random.Random(4)
    line = lambda n: rng.choices("a b c d".split(), k=n)
    sources = [(rng.choice(["lyric", "sentence", "phrase"]), line(rng.randint(0, 30))) for _ in range(60)] + [("lyric", None), ("phrase", ["x", "y"]), ("sentence", ["x"] * 2000)]
    candidates = [(i, line(rng.randint(0, 20))) for i in range(40)] + [(100 + i, list(t)) for i, (_, t) in enumerate(sources[:10])] + [(200, ["x", "y"]), (201, None), (202, []), (203, ["x"] * 12), (204, ["q"] * 9)]
    c, s = spark.createDataFrame(candidates, "id long, tokens array<string>"), spark.createDataFrame(sources, "kind string, tokens array<string>").repartition(3)
    by_kind = C.novelty_by_kind(c, s, "id", "kind")
    got = {}
    for r in by_kind.collect():
        got.setdefault(r.id, {})[r.kind] = (r.exact, r.longest, r.matched)
    want = {i: found for i, t in candidates if (found := brute_novelty(t, sources))}
    assert got == want
    summary = {r.id: r for r in C.source_novelty(c, by_kind, "id").collect()}
    for i, t in candidates:
        found = want.get(i, {})
        strict = [v for k, v in found.items() if k != "phrase"]
        run, n = max((v[1] for v in strict), default=0), len(t or [])
        r = summary[i]
        assert (r.exact_source, r.longest_run, r.matched_windows) == (any(v[0] for v in strict), run, sum(v[2] for v in strict))
        assert r.novelty == (round(1 - run / n, 6) if n else 1.0) and r.phrase_support == (round(found.get("phrase", (0, 0, 0))[1] / min(8, n), 6) if n else 0.0)
    plain = {r.id: r.longest for r in C.novelty(c, s, "id").collect()}
    assert plain == {i: max((v[1] for v in want.get(i, {}).values()), default=0) for i, _ in candidates}


def test_sources_are_shuffled_as_hits_only(spark):
    c = spark.createDataFrame([(1, list("abcdef"))], "id long, tokens array<string>")
    df = C.novelty_by_kind(c, spark.createDataFrame([("k", list("abcdefg"))], "kind string, tokens array<string>"), "id", "kind")
    assert not any(re.search(r"\btokens#", x) for x in shuffled_columns(df))
