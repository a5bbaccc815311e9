"""Phrase, name and bridge operators against brute force on small data."""

from itertools import product

from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.operators import mosaic as M
from klangwerk.operators import names as N

WORDS = "haus maus reise weise strasse garten warten liebe diebe arbeit im am die der wald bald kalt".split()


def analysed(w):
    return P.analyze(P.grapheme_to_ipa(w, "de"), "de")


def test_bound_is_never_below_the_score():
    every = [analysed(w) for w in WORDS]
    assert all(P.score_bound(a, b, "de") >= P.score(a, b, "de")["overall"] - 1e-9 for a, b in product(every, every))


def test_anchors_clips_and_windows():
    a = P.analyze("ˈʃtʁaːsənˌbaːn", "de")
    assert [x["anchor"] for x in P.query_anchors(a, "de")] == ["primary:1"]
    b = P.analyze("ɡəˈʃtʁaːsənˌbaːnən", "de")
    assert [x["anchor"] for x in P.query_anchors(b, "de")] == ["primary:2", "secondary:4", "full_surface:1"]
    assert P.clipped_anchors(b, 1)[-1] == {"start": 3, "end": 4, "kind": "secondary_clipped"} and len(P.clipped_anchors(b)) == 2
    w = P.window_analysis(b["syllables"], 1, 3, "de")
    assert w["vowel_key"] == "aː-ə" and w["syllable_count"] == 2 and w["coda_key"] == "n" and w["multi_key"] == w["exact_key"]
    whole = P.window_analysis(a["syllables"], 0, 3, "de")
    assert (whole["exact_key"], whole["vowel_key"], whole["vowel_family"]) == (a["exact_key"], a["vowel_key"], a["vowel_family"])
    long, short = P.analyze("ˈbaːnən", "de"), P.analyze("ˈhaːn", "de")
    assert P.score_clipped(P.analyze("ˈbaːnnən", "de"), short, "de", 1)["overall"] >= P.score_anchored(long, short, "de")["overall"] - 1e-9


def test_bridge():
    found = P.to_english("ˈʃtʁaːsə")
    assert found["ipa"].startswith("ˈɑ") and found["position"] == 1 and found["analysis"]["syllable_count"] == 2
    assert P.to_english("") is None and P.to_english(None) is None


def phrases(spark):
    rows = [(1, ["die", "reise"]), (2, ["im", "garten"]), (3, ["der", "unbekannte"]), (4, []), (5, ["am", "wald", "haus"]), (6, None), (7, ["warten", "im", "haus"])]
    lex = spark.createDataFrame([("de", w, P.grapheme_to_ipa(w, "de")) for w in WORDS], "language string, form string, ipa string")
    return spark.createDataFrame(rows, "id long, tokens array<string>").withColumn("lang", F.lit("de")), lex, rows


def test_phrase_pronunciations_and_windows(spark):
    df, lex, rows = phrases(spark)
    said = M.phrase_pronunciations(df, lex, "id", "tokens", "lang")
    got = {r.id: r for r in said.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ready", 2: "ready", 3: "unresolved_token", 4: "empty", 5: "ready", 6: "empty", 7: "ready"}
    want = set()
    for i, tokens in rows:
        if got[i].status != "ready":
            assert got[i].ipa is None
            continue
        parts = [analysed(w) for w in tokens]
        ends = [sum(p["syllable_count"] for p in parts[: k + 1]) for k in range(len(parts))]
        assert list(got[i].token_ends) == ends and got[i].a.syllable_count == ends[-1]
        whole = P.analyze(got[i].ipa, "de")
        for s in range(ends[-1]):
            for e in range(s + 2, min(ends[-1], s + 6) + 1):
                crossed = sum(s < x < e for x in ends)
                if crossed:
                    w = P.window_analysis(whole["syllables"], s, e, "de")
                    want.add((i, s, e, crossed, s > 0 and s not in ends, e not in ends, w["vowel_key"], w["vowel_family"], w["coda_class"]))
    windows = M.phrase_windows(said, "id", "lang")
    assert {(r.id, r.start, r.end, r.crossed, r.starts_inside, r.ends_inside, r.vowel_key, r.vowel_family, r.coda_class) for r in windows.collect()} == want and len(want) > 4


def test_mosaic_retrieval_equals_brute_force(spark):
    df, lex, _ = phrases(spark)
    windows = M.phrase_windows(M.phrase_pronunciations(df, lex, "id", "tokens", "lang"), "id", "lang")
    rows = [r.asDict() for r in windows.collect()]
    asked = ["weise", "warten", "haus", "liebe"]
    queries = spark.createDataFrame([(w, "de", P.grapheme_to_ipa(w, "de")) for w in asked], "q string, lang string, ipa string")
    for family, limit in ((True, 100), (False, 100), (True, 1)):
        want = set()
        for w in asked:
            for x in P.query_anchors(analysed(w), "de"):
                tests = {"exact_tail": lambda r: r["exact_key"] == x["exact_key"], "vowel_coda": lambda r: (r["vowel_key"], r["coda_key"]) == (x["vowel_key"], x["coda_key"]), "vowel": lambda r: r["vowel_key"] == x["vowel_key"],
                         "vowel_family_coda_class": lambda r: (r["vowel_family"], r["coda_class"]) == (x["vowel_family"], x["coda_class"])}
                tests = {c: (lambda r, f=f: f(r) and r["syllable_count"] == x["syllable_count"]) for c, f in tests.items()}
                tests["final_nucleus_coda_class"] = lambda r: (r["final_nucleus"], r["coda_class"]) == (x["final_nucleus"], x["coda_class"]) and abs(r["syllable_count"] - x["syllable_count"]) <= 1
                for c, f in tests.items():
                    if family or c != "vowel_family_coda_class":
                        hits = sorted((r["syllable_count"], r["id"], r["start"], r["end"]) for r in rows if f(r))
                        want |= {(w, x["anchor"], i, s, e, c) for _, i, s, e in hits[:limit]}
        found = M.retrieve_windows(queries, windows, "q", "id", "lang", family, limit)
        assert {(r.q, r.anchor, r.id, r.start, r.end, c) for r in found.collect() for c in r.channels} == want and want
    best = M.ranked_windows(M.retrieve_windows(queries, windows, "q", "id", "lang"), "q", "id", "lang").collect()
    assert len({(r.q, r.id, r.start, r.end) for r in best}) == len(best) > 0
    for q in asked:
        own = sorted((r for r in best if r.q == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [(r.tier, -r.score) for r in own] == sorted((r.tier, -r.score) for r in own)


def test_resolved_names(spark):
    lex = spark.createDataFrame([("haus", "haʊs"), ("am see", "am zeː"), ("am", "am"), ("wald", "valt")], "form string, ipa string")
    names = spark.createDataFrame([("Am See",), ("Haus am Wald",), ("Haus X",), ("",), (None,), ("--",), ("am am am am am am am",), ("Haus am Wald",)], "name string")
    got = {r.name: (r.status, r.tokens, list(r.unresolved), r.ipa) for r in N.resolved_names(names, lex, "name").collect()}
    assert got == {"Am See": ("exact_source_backed", 2, [], "am zeː"), "Haus am Wald": ("bounded_token_composition", 3, [], "haʊs am valt"), "Haus X": ("unresolved_token", 2, ["x"], None),
                   "": ("unresolved_empty_surface", 0, [], None), "--": ("unresolved_empty_surface", 0, [], None), "am am am am am am am": ("unresolved_too_many_tokens", 7, ["am"] * 7, None)}


def test_candidates_of_categories_are_cut_as_they_would_be_after_the_join(spark):
    names = [(i, "c%d" % (i % 3), (i * 37) % 101) for i in range(120)] + [(i, "c2", (i * 37) % 101) for i in range(0, 30, 3)]
    anchors = [(i, ch, k) for i in range(120) for ch, k in (("exact", f"k{i % 4}"), ("vowel", f"v{i % 2}"))]
    asked = [("q1", "exact", "k1"), ("q1", "vowel", "v0"), ("q2", "vowel", "v1"), ("q3", "vowel", "v1")]
    wanted = [("q1", "c0"), ("q1", "c2"), ("q1", "c2"), ("q2", "c1"), ("q3", "nothing")]
    n = spark.createDataFrame(names, "id long, category string, pop long")
    got = N.entity_candidates(spark.createDataFrame(asked, "q string, channel string, key string"), spark.createDataFrame(anchors, "id long, channel string, key string"), n, "q", "id",
                              [F.desc("pop"), F.asc("id"), F.asc("category")], spark.createDataFrame(wanted, "q string, category string"), per_channel=7)
    want = {}
    for q, ch, k in asked:
        rows = sorted(((-pop, i, c) for i, c, pop in names if (q, c) in wanted and (i, ch, k) in anchors))[:7]
        for _, i, _ in rows:
            want.setdefault((q, i), set()).add(ch)
    assert {(r.q, r.id): set(r.channels) for r in got.collect()} == want and want
