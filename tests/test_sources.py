"""Readers and sinks on small texts."""

import json

import pytest
from pyspark.sql import functions as F

from klangwerk.sources import readers as R
from klangwerk.sources import sinks as S


def of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_dictionary_skips_bad_lines(spark):
    rows = of(spark, json.dumps({"word": "Haus", "lang_code": "de", "pos": "noun", "sounds": [{"ipa": "haʊ̯s"}, {}]}), json.dumps({"word": "house", "lang_code": "en"}), "{broken", "", json.dumps({"word": "zwei Wörter", "lang_code": "de"}))
    assert [(r.word, r.normalized, r.ipa) for r in R.dictionary(rows).collect()] == [("Haus", "haus", ["haʊ̯s"])]


def test_counts_and_ranks(spark, tmp_path):
    got = R.corpus_counts(of(spark, "Haus\tx\t3", "haus\t2", "12\t4", "bad\tno"), F.lit("s")).collect()
    assert [(r.form, r.n) for r in got] == [("haus", 5)]
    (tmp_path / "a.tsv").write_text("rank\tform\n1\ta\n2\tb\n")
    assert R.ranked_forms(spark, str(tmp_path / "a.tsv")).count() == 2
    (tmp_path / "b.tsv").write_text("rank\tform\n1\ta\n3\tb\n")
    with pytest.raises(ValueError):
        R.ranked_forms(spark, str(tmp_path / "b.tsv"))
    (tmp_path / "c.tsv").write_text("rank\tname\n")
    with pytest.raises(ValueError):
        R.ranked_forms(spark, str(tmp_path / "c.tsv"))


def test_pronouncing_dictionary(spark):
    got = R.pronouncing_dictionary(of(spark, ";;; comment", "READ  R EH1 D", "READ(2)  R IY1 D", "", "ALONE")).collect()
    assert [(r.surface, r.normalized, r.pronunciation, r.alternate) for r in got] == [("READ", "read", "R EH1 D", None), ("READ", "read", "R IY1 D", 2)]


def test_message_pack(spark, tmp_path):
    raw = b"\x93\x82\xa6format\xa2cB\xa7version\x01\x91\xa3the\x92\xa2of\xd9\x03and"
    assert R.unpack(raw) == [{"format": "cB", "version": 1}, ["the"], ["of", "and"]]
    with pytest.raises(ValueError):
        R.unpack(raw + b"\x00")
    (tmp_path / "w.bin").write_bytes(raw)
    assert sorted((r.word, r.bucket, r.zipf) for r in R.frequency_buckets(spark, str(tmp_path / "w.bin")).collect()) == [("and", 1, 8.99), ("of", 1, 8.99), ("the", 0, 9.0)]


def test_entities(spark):
    item = {"id": "Q7", "type": "item", "labels": {"de": {"language": "de", "value": "Köln"}, "en": {"language": "en", "value": "Cologne"}}, "aliases": {"en": [{"language": "en", "value": "cologne"}, {"language": "en", "value": "Koeln"}]},
            "sitelinks": {"dewiki": {"site": "dewiki", "title": "Köln"}, "commons": {"site": "commons", "title": "x"}}, "claims": {"P31": ["Q515"], "P17": ["Q183", "Q2"]}}
    items = R.entity_items(of(spark, "[", json.dumps(item) + ",", json.dumps({**item, "id": "Q8", "claims": {"P31": ["Q1"]}}), "]"), {"city": ["Q515"], "person": ["Q5"]})
    r = items.collect()
    assert len(r) == 1 and (r[0].entity, r[0].category, r[0].sitelinks, r[0].statements) == ("Q7", "city", 1, 3)
    assert {(n.language, n.normalized, n.surface, n.preferred) for n in R.entity_names(items).collect()} == {("de", "köln", "Köln", True), ("en", "cologne", "Cologne", True), ("en", "koeln", "Koeln", False)}
    assert [(r.entity, r.qrank) for r in R.qrank(of(spark, "Entity,QRank", "Q1,55", "x,1", "Q2,-3")).collect()] == [("Q1", 55)]


def test_sparql_terms(spark):
    got = R.sparql_terms(of(spark, '<http://x/entity/Q12>\t"a \\"b\\" \\\\ c"@en\t"3"^^<int>\t', "plain\t\t\t\r"), ["a", "b", "c", "d"]).withColumn("q", R.entity_id(F.col("a"))).collect()
    assert (got[0].a, got[0].b, got[0].c, got[0].d, got[0].q) == ("http://x/entity/Q12", 'a "b" \\ c', "3", None, "Q12")
    assert (got[1].a, got[1].b, got[1].q) == ("plain", None, None)


def test_phrases(spark):
    rows = of(spark, json.dumps({"word": "auf  den Hund kommen", "lang_code": "de", "pos": "phrase", "senses": [{"tags": ["idiomatic"]}, {"tags": ["obsolete"]}]}), json.dumps({"word": "Hund", "lang_code": "de"}), json.dumps({"word": "ganz alt", "lang_code": "de", "tags": ["veraltet"]}))
    got = {r.canonical: (r.types, r.history, len(r.tokens)) for r in R.phrases(rows).collect()}
    assert got == {"auf den Hund kommen": (["idiom", "phrase"], "mixed", 4), "ganz alt": (["multiword_lexeme"], "historical_only", 2)}


def test_transcript_and_sentences(spark):
    got = [r.x for r in of(spark, "0012 AB1: ja (laughs) [x] komm <p> 12:30 her", "Seite 4", "(.)", None).select(R.transcript_line(F.col("value")).alias("x")).collect()]
    assert got == ["ja komm her", None, None, None]
    s = R.sentences(of(spark, "1\tDas ist ein Satz.", "ohne Nummer hier", "2\t ", "3\tDAS ist ein satz")).collect()
    assert [(r.id, r.sentence) for r in s] == [("1", "Das ist ein Satz."), (None, "ohne Nummer hier"), ("3", "DAS ist ein satz")]
    a = R.assessed_sentences(spark.createDataFrame([("Das ist ein Satz.",), ("DAS ist ein satz",), ("see www.x.de now ok",), ("1 2 3 vier",), ("kurz",)], "sentence string")).groupBy("rejected").count().collect()
    assert {r.rejected: r["count"] for r in a} == {None: 1, "url": 1, "digits": 1, "short": 1}


def test_lyrics(spark):
    text = "before\n--- Song One ---\n[Verse 1]\nErste Zeile!\nhttp://x\n[Pre-Chorus]\nZweite Zeile\n--- ---\n--- Two ---\nfrei\n[Lyrics to x]\nmeta line"
    got = [(r.song, r.section_type, r.normalized, r.last_word) for r in R.lyrics(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").orderBy("line_no").collect()]
    assert got == [(1, "verse", "erste zeile", "zeile"), (1, "pre_hook", "zweite zeile", "zeile"), (2, None, "frei", "frei"), (2, None, "meta line", "line")]


def test_sinks(spark, tmp_path):
    df = spark.range(25).coalesce(1)
    m = S.write_shards(df, f"{tmp_path}/s", 10)
    assert sorted(r.rows for r in m.collect()) == [5, 10, 10]
    assert S.append_new(df.unionAll(df), spark.range(20), ["id"]).count() == 5
    calls = []
    for _ in range(2):
        S.stage(spark, f"{tmp_path}/t", lambda: calls.append(1) or df)
    assert len(calls) == 1
    found = S.manifest(df, schema="v1")
    assert S.check_manifest(found, schema="v1", rows="25").count() == 0 and S.check_manifest(found, schema="v2").count() == 1
    assert S.compact(df, ["id"]).agg(F.sum("bytes")).first()[0] > 0
