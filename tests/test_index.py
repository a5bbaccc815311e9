"""The built index and bounded scoring against the plain search."""

import random

import pytest
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.operators import index as I
from klangwerk.operators import lexicon as L
from klangwerk.operators import search as S

PARTS = {"de": ("h m l r tr sch str b k fl".split(), "au a ei o u e i ie ä".split(), "s m g n nd st rt tz ch lle".split()), "en": ("h m l r tr sh str b k fl".split(), "ou a ea o u e i ie".split(), "s m g n nd st rt ck sh".split())}


@pytest.fixture(scope="module")
def words(spark):
    rng, rows = random.Random(7), set()
    for language, (onset, nucleus, coda) in PARTS.items():
        while sum(r[0] == language for r in rows) < 500:
            rows.add((language, "".join(rng.choice(onset) + rng.choice(nucleus) + (rng.choice(coda) if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 3)))))
    ranked = [(g, f, 1, 1, i + 1 if i % 9 else None) for i, (g, f) in enumerate(sorted(rows, key=lambda r: hash(r[1]) % 1000))]
    return spark.createDataFrame(ranked, "language string, form string, n long, sources long, usage_rank long").cache()


@pytest.fixture(scope="module")
def index(spark, words, tmp_path_factory):
    return I.build(words, f"file://{tmp_path_factory.mktemp('index')}", "a source")


def asked(words):
    return words.where("length(form) BETWEEN 5 AND 7").where(F.crc32(F.col("form").cast("binary")) % 25 == 0)


@pytest.mark.parametrize("order", ["usage", "sound"])
def test_search_over_the_index_is_the_plain_search(words, index, order):
    q = asked(words).cache()
    want = sorted(map(str, S.search(q, words, order=order).collect()))
    assert len(want) > 200 and sorted(map(str, I.search(q, index, order=order).collect())) == want


@pytest.mark.parametrize("order", ["usage", "sound"])
@pytest.mark.parametrize("limit", [1, 7, 60, 250])
def test_bounded_scoring_keeps_the_best(words, index, order, limit):
    q = asked(words)
    columns = ["language", "query", "form", "types", "tier", "score", "rank"]
    plain = S.ranked(S.scored(S.candidates(L.channels(L.pronounce(q)), L.channels(L.pronounce(words)))), order, limit).select(*columns)
    best = S.best_scored(I.lookup(I.asked(q), index), order, limit).cache()
    assert sorted(map(str, best.select(*columns).collect())) == sorted(map(str, plain.collect()))
    saved = best.agg(F.max("n_candidates").alias("n"), F.sum(F.col("n_candidates") - F.col("n_scored")).alias("saved")).first()
    assert saved.saved > 0 if limit < 60 else saved.n > 0


def test_bound_is_never_below_the_score(words):
    rng = random.Random(1)
    heard = {}
    for r in words.collect():
        a = P.analyze(P.grapheme_to_ipa(r.form, r.language), r.language)
        if a:
            back = P.hear_sound(P.spell_sound(a["syllables"], a["primary_stress"]))
            assert back["syllables"] == a["syllables"] and back["primary_stress"] == a["primary_stress"]
            heard.setdefault(r.language, []).append((a, P.anchored_vectors(back)))
    rejected = 0
    for language, rows in heard.items():
        for _ in range(4000):
            (a, x), (b, y) = rng.choice(rows), rng.choice(rows)
            s, bound = P.score_anchored(a, b, language), P.possible_anchored(x, y, language)
            assert P.score_prepared(x, y, language) == s
            types = [t for t in (s["type"] != "weak" and s["type"], s["assonance"] and "assonance", s["consonance_relation"] and "consonance") if t]
            if bound is None:
                assert not types
                rejected += 1
            elif types:
                assert bound[0] <= min(S.TIERS[t] for t in types) and bound[1] >= s["overall"]
    assert rejected > 100


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_keys_are_read_from_their_buckets_and_many_join_without_moving_postings(spark, words, index, monkeypatch):
    few = plan(I.lookup(I.asked(words.where("form = 'haus'").unionByName(words.limit(1))), index))
    assert "In(posting" in few and "SelectedBucketsCount" in few
    monkeypatch.setattr(I, "MAX_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = I.lookup(I.asked(asked(words)), index)
        df.collect()
        many = plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = many[: many.index("FileScan parquet spark_catalog")].splitlines()[-6:]
    assert "SortMergeJoin" in many and not any("Exchange" in line for line in scan[-3:])
    assert sorted(map(str, df.collect())) == sorted(map(str, I.lookup(I.asked(asked(words)), index).collect()))


def test_an_index_opens_again_and_only_for_its_source(spark, words, index):
    spark.sql(f"DROP TABLE {index.table}")
    assert I.reopen(spark, index.folder, "another source") is None and I.reopen(spark, index.folder + "/nowhere") is None
    again = I.reopen(spark, index.folder, "a source")
    assert again.postings.count() == L.channels(L.pronounce(words)).count()


def test_open_or_build_builds_once(spark, words):
    calls = []
    ask = lambda: calls.append(1) or words.limit(5)
    first = I.open_or_build(spark, "test", "s1", ask)
    assert I.open_or_build(spark, "test", "s1", ask).folder == first.folder and len(calls) == 1
    assert I.open_or_build(spark, "test", "s2", ask).folder != first.folder and len(calls) == 2


def test_empty_lexicon(spark, words, tmp_path):
    empty = I.build(words.limit(0), f"file://{tmp_path}/empty")
    assert I.search(words.limit(3), empty).collect() == [] and I.search(words.limit(0), empty).collect() == []
