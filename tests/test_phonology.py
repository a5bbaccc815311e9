"""Phonology: small hand-written cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from klangwerk.functions import phonology as P
from klangwerk.functions.profiles import ENGLISH, GERMAN


def test_german_rhyme_begins_at_the_first_primary_stress():
    a = P.analyze("[ˈvaː.zɐˌfal]", "de")
    assert (a["syllable_count"], a["stress_pattern"], a["exact_key"], a["vowel_key"]) == (3, "201", "aː.zɐ.fal", "aː-ɐ-a")


def test_english_rhyme_begins_at_the_last_primary_stress():
    a = P.analyze("ˈriːˈmeɪk", "en")
    assert (a["stress_pattern"], a["exact_key"], a["primary_stress"]) == ("22", "eɪk", 2)


def test_boundaries_override_legal_onsets():
    assert [s["coda"] for s in P.analyze("ˈap.la", "de")["syllables"]] == [["p"], []]
    assert [s["coda"] for s in P.analyze("ˈapla", "de")["syllables"]] == [[], []]


@pytest.mark.parametrize("bad", ["", None, "ptk", "ˈxqz"])
def test_invalid_pronunciations_have_no_analysis(bad):
    assert P.analyze(bad, "en") is None


def test_arpabet():
    assert P.analyze("B AH0 N AE1 N AH0", "en", "arpabet")["exact_key"] == "æ.nə"
    assert P.arpabet_segments("B1 AH0") is None and P.arpabet_segments("QQ") is None and P.arpabet_segments("") is None


def test_coda_classes():
    assert P.coda_class([], GERMAN) == "OPEN" and P.coda_class(["n", "t"], GERMAN) == "COR-NAS+COR-STOP" and P.coda_class(["w"], GERMAN) == "?w"


def test_empty_sequences_differ_by_use():
    alike = lambda a, b: 0.5
    assert P.sequence_similarity([], [], alike, 0.6) == 0.6 and P.sequence_similarity((), (), alike, 1.0) == 1.0 and P.sequence_similarity(["a"], [], alike, 1.0) == 0.0
    assert P.sequence_similarity(["a", "b"], ["a", "c"], lambda x, y: float(x == y), 1.0) == 0.5


def test_classes():
    say = lambda w: P.analyze(P.grapheme_to_ipa(w, "de"), "de")
    assert P.score(say("haus"), say("maus"), "de")["type"] == "perfect"
    assert P.score(say("reise"), say("weise"), "de")["type"] == "multisyllabic_perfect"
    exact = P.score(say("haus"), say("maus"), "de")
    assert exact["assonance"] is None and exact["consonance_relation"] is None


def test_spelling_rules():
    assert P.grapheme_to_ipa("tag", "de") == "ˈtaːk" and P.grapheme_to_ipa("warg", "de") == "ˈvaRk" and P.grapheme_to_ipa("nation", "en") == "ˈnæʃən" and P.grapheme_to_ipa("stich", "de") == "ˈʃtɪç"


symbols = st.lists(st.sampled_from([*GERMAN.consonants, *GERMAN.nuclei]), max_size=8)


@settings(max_examples=60, deadline=None)
@given(symbols, symbols)
def test_similarity_is_symmetric_and_bounded(a, b):
    alike = lambda x, y: P.consonant_similarity(x, y, "de") if x in GERMAN.consonants and y in GERMAN.consonants else P.vowel_similarity(x, y, "de")
    x, y = P.sequence_similarity(a, b, alike, 1.0), P.sequence_similarity(b, a, alike, 1.0)
    assert abs(x - y) < 1e-9 and 0 <= x <= 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.sampled_from(["de", "en"]))
def test_rules_never_fail(text, language):
    a = P.analyze(P.grapheme_to_ipa(text, language), language)
    assert a is None or a["syllable_count"] == len(a["stress_pattern"])


def test_tables_cover_their_symbols():
    for p in (GERMAN, ENGLISH):
        assert set(p.vowels) == set(p.family) == set(p.nuclei)
        assert all(c[0] in p.places and c[1] in p.manners for c in p.consonants.values())


def test_cross_word_windows_are_made_where_the_line_stands(spark):
    """SQ-01: windows and their counts against brute force; no window is shuffled."""
    from collections import Counter

    from pyspark.sql import functions as F

    from klangwerk.functions import phonology as P
    from klangwerk.operators import lexicon as L

    lines = [(1, "de", "der mond geht auf"), (2, "en", "the moon the moon goes up"), (3, "en", "x"), (4, None, "no language here"), (5, "fr", "pas de regles ici"), (6, "de", None)]
    df = spark.createDataFrame(lines, "id long, lang string, text string").select("id", "lang", F.split("text", " ").alias("words"))
    want = []
    for i, g, text in lines:
        s = [(k, x["nucleus"]) for k, w in enumerate((text or "").split()) if g in ("de", "en") for x in (P.analyze(P.grapheme_to_ipa(w, g), g) or {"syllables": []})["syllables"]]
        want += [(i, g, a, n, "-".join(x for _, x in s[a : a + n])) for a in range(len(s)) for n in range(2, 7) if a + n <= len(s) and s[a][0] != s[a + n - 1][0]]
    got = L.syllable_windows(df, "id", "words", "lang")
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    n, phrases = Counter((g, k) for _, g, _, _, k in want), Counter((g, k) for _, g, k in {(i, g, k) for i, g, _, _, k in want})
    counts = L.window_counts(df.repartition(3), "words", "lang").collect()
    assert {(r["lang"], r["vowel_key"]): (r["n"], r["phrases"]) for r in counts} == {k: (n[k], phrases[k]) for k in n}
