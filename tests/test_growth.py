"""Steps whose memory or work once grew with the largest group, key or scan task."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.functions import text as T
from klangwerk.operators import filters as X
from klangwerk.operators import grouped as GR
from klangwerk.operators import mosaic as M
from klangwerk.operators import positional as Z
from klangwerk.operators import relational as O
from klangwerk.operators import song as G
from klangwerk.plans import QUERIES


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [500_000, 0])
def test_suffix_search_joins_by_syllables_and_collects_no_index(spark, monkeypatch, most):
    monkeypatch.setattr(Z, "MAX_BROADCAST_PAIRS", most)
    rng = random.Random(4)
    words = [(i, "-".join(rng.choices("abc", k=rng.randint(1, 4))), rng.randint(1, 6)) for i in range(200)] + [(900, None, 2), (901, "", 2), (902, "a-b", None)]
    df = spark.createDataFrame(words, "id long, k string, n int")
    index = df.select(F.col("id").alias("target"), F.explode(T.suffix_keys("k")).alias("suffix"), F.col("n").alias("syllables"))
    asked = df.where("id % 7 = 0 OR id >= 900").select(F.col("id").alias("query"), F.col("k").alias("suffix"), F.col("n").alias("syllables"))
    found = O.suffix_search(asked.unionByName(asked), index, "query", "target").select("query", "target")
    want = sorted((q, i) for q, a, m in words for i, b, n in words if (q % 7 == 0 or q >= 900) and a and b and "-" in a and None not in (m, n) and b.endswith(a) and abs(m - n) <= 1)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    assert not [line for line in executed(found).splitlines() if "HashAggregate" in line and "target" in line]


def test_suffix_keys_of_odd_keys(spark):
    df = spark.createDataFrame([("a-bc-d",), ("-a-b",), ("ab",), ("a-",), ("-",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(T.suffix_keys("k")).collect()] == [["a-bc-d", "bc-d", "c-d"], ["a-b"], [], ["a-"], [], [], None]


def test_names_are_neither_broadcast_nor_collected_by_a_scan(spark):
    names = spark.createDataFrame([(i, "old man old man", i % 5) for i in range(50)] + [(99, "man old", 1)], "id long, name string, pop long")
    found = X.name_search(names, "id", "name", spark.createDataFrame([("old man",)], "q string"), "q", [F.desc("pop"), F.asc("id")], limit=100)
    assert sorted(r.id for r in found.collect()) == list(range(50))
    plan = executed(found)
    assert "SortMergeJoin [id" in plan


def test_the_scheme_of_many_songs_is_one_pass_and_reads_words_once(spark, tmp_path):
    lines = spark.createDataFrame([(s, i, w) for s in range(300) for i, w in enumerate(["haus.", "maus", None, "tag -", "haus"])] + [(999, i, "katze") for i in range(3000)], "song int, line long, text string")
    lines.write.parquet(f"{tmp_path}/lines")
    words = G.settled_words(spark.read.parquet(f"{tmp_path}/lines"), "song", "line")
    labels = G.scheme(words, G.strongest_pairs(words, "song", "line", "de"), "song", "line")
    got = labels.where("song IN (7, 999)").groupBy("song").agg(F.array_join(F.array_distinct(F.array_sort(F.collect_list(F.struct("line", "label")))["label"]), "")).collect()
    assert {r[0]: r[1] for r in got} == {7: "A" + G.NO_WORD + "B", 999: "A"}
    plan = executed(labels)
    assert "FlatMapGroupsInPandas" not in plan and f"{tmp_path}/lines" not in plan


@pytest.mark.parametrize("line, word", [("a-b c--d", "d"), ("x -y-z!", "y-z"), ("l'été ’", "l'été"), ("a-", "a"), ("-", ""), ("", ""), ("A1-b2 …", "a1-b2")])
def test_end_words(spark, line, word):
    assert spark.createDataFrame([(line,)], "l string").select(T.end_word("l")).first()[0] == word


def test_neighbours(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(T.neighbours("t")).collect()] == [["a b", "b c"], [], [], []]


def test_windows_leave_python_in_small_batches(spark):
    schema = pa.schema([("n", pa.int32())])
    given = [0]

    def rows():
        for i in range(2 * GR.ROWS_OUT + 5):
            given[0] += 1
            yield (i,)

    batches = GR._batches(rows(), schema)
    assert next(batches).num_rows == GR.ROWS_OUT == given[0] and [b.num_rows for b in batches] == [GR.ROWS_OUT, 5]
    lex = spark.createDataFrame([("de", w, P.grapheme_to_ipa(w, "de")) for w in ("alte", "leute")], "language string, form string, ipa string")
    said = M.phrase_pronunciations(spark.createDataFrame([(1, ["alte", "leute"], "de")], "id int, tokens array<string>, lang string"), lex, "id", "tokens", "lang")
    assert "MapInArrow" in executed(M.phrase_windows(said, "id", "lang"))


@pytest.mark.parametrize("name", ["jn05_english_channels", "jn07_phrase_mosaic"])
def test_a_lexicon_is_spoken_once(spark, sf, name):
    # what is left in the plan reads the written table instead of the documents' words
    plan = executed(QUERIES[name](spark, sf)).split("== Initial Plan ==")[0]
    assert "klangwerk-" in plan and "_g2p(" not in plan
