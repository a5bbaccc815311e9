"""Surface checks, derived keys and revisions on hand-written cases."""

from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.functions import surfaces as S
from klangwerk.operators import revisions as V


def test_keys_of_an_analysis(spark):
    a = spark.createDataFrame([("ˈaɐ.baɪtsˌvaɪ.zə", "de"), ("ˈhaʊs", "de")], "ipa string, g string").withColumn("a", P.analysis(F.col("ipa"), F.col("g")))
    r = a.select(S.right_edge_keys("a").alias("k"), S.rendered_ipa("a").alias("i"), S.identity_key("a").alias("d"), F.transform(S.entity_anchors("a"), lambda e: e["channel"]).alias("c")).collect()
    assert r[0].k == ["aɪ-aɪ-ə", "aɪ-ə"] and r[1].k == []
    assert r[0].i.endswith("vaɪ.zə") and r[1].d == "h aʊ s|2"
    assert r[1].c == ["exact_tail", "vowel_sequence", "vowel_family", "final_nucleus_coda", "final_nucleus"] and r[0].c.count("right_edge") == 2


def test_surfaces(spark):
    rows = spark.createDataFrame([("[1] Haus",), ("so …",), ("<b>x",), ("er/sie geht",), ("",), (None,), ("guter Rat",), ("z. B. 2",), ("a b",)], "s string")
    got = rows.select(S.artifact("s").alias("a"), S.safety("s", F.lit(False)).alias("f")).collect()
    assert [r.a for r in got] == ["wiktionary_numbered_display", "ellipsis_placeholder", "markup_fragment", "pronoun_template", "empty_surface", "empty_surface", None, None, None]
    assert got[6].f["class"] == "safe" and "digit_bearing" in got[7].f.reasons and got[8].f.reasons == ["multiple_single_letter_tokens"]
    units = spark.createDataFrame([("Henry VIII & Jean-Luc 2",), (" ",)], "s string").select(S.lookup_units("s").alias("u")).collect()
    assert units[0].u == ["henry", "eight", "and", "jean", "luc", "two"] and units[1].u == []
    ipa = spark.range(1).select(S.generated_ipa(F.lit("h_ɡoː‖x"), "en").alias("e"), S.generated_ipa(F.lit("ɑːɾ"), "de").alias("d")).first()
    assert (ipa.e, ipa.d) == ("h goʊ x", "aːr")


def test_revisions(spark):
    now = spark.createDataFrame([("d", "a", 0, "x"), ("d", "c", 1, "new"), ("d", "b", 2, "y"), ("d", "e", 3, None)], "doc string, bar string, at int, t string")
    was = spark.createDataFrame([("d", "a", 0, "x"), ("d", "b", 1, "y"), ("d", "c", 2, "old"), ("d", "z", 3, "q"), ("d", "e", 3, None)], "doc string, bar string, at int, t string")
    assert {r.bar: r.state for r in V.compare_revisions(now, was, "doc", "bar", "at", "t").collect()} == {"a": "same", "b": "moved", "c": "changed", "e": "same", "z": "removed"}
    one = spark.createDataFrame([("d", b, i, b) for i, b in enumerate("nabcd")], "doc string, bar string, at int, t string")
    two = spark.createDataFrame([("d", b, i, b) for i, b in enumerate("abdc")], "doc string, bar string, at int, t string")
    rows = {r.bar: r for r in V.compare_revisions(one, two, "doc", "bar", "at", "t").collect()}
    assert rows["n"].state == "added" and [rows[b].moved for b in "abcd"] == [True] * 4 and V.common_bars(list("nabcd"), list("abdc")) == [(1, 0), (2, 1), (4, 2)]
    assert V.common_bars([], ["a"]) == [] and V.common_bars(list("bac"), list("abc")) == [(1, 0), (2, 2)]
    lib = spark.createDataFrame([("/a", "Song One"), ("/a/b", "song two"), ("/ab", "Song"), ("/a", "Other")], "path string, title string")
    assert [r.title for r in V.library(lib, "/a", "SONG").collect()] == ["Song One", "song two"]


def test_revisions_of_many_documents_in_one_pass(spark):
    """Documents that end and begin inside batches, a null one among them; a pass over a partition serves all its documents."""
    size = lambda d: 1 + d * 7 % 23
    rows = lambda keep: [(d if d else None, b, b, f"{b % 4}") for d in range(3000) for b in range(size(d)) if keep(b)]
    make = lambda r: spark.createDataFrame(r, "doc long, bar int, at int, t string").repartition(3)
    got = V.compare_revisions(make(rows(lambda b: b % 5)), make(rows(lambda b: b % 3)), "doc", "bar", "at", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = [(d if d else None, b, "same" if b % 5 and b % 3 else "added" if b % 5 else "removed") for d in range(3000) for b in range(size(d)) if b % 5 or b % 3]
    assert sorted(((r.doc, r.bar, r.state) for r in got.collect()), key=str) == sorted(want, key=str) and "FlatMapGroups" not in plan
