"""Lexicon and pronunciation tables from a corpus (SR, AG-08, PH, ST-01, SQ-09)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.functions import text as T

from . import ranking as R

LANGUAGES = ("de", "en")


def lexicon(docs: DataFrame, least: int = 1) -> DataFrame:
    """language, form, n, sources and usage_rank (1 for the most frequent form of a language)."""
    words = docs.where(F.col("lang").isin(*LANGUAGES)).select(F.col("lang").alias("language"), "source", F.explode(T.word_tokens("text")).alias("_w")).select("language", "source", F.lower("_w").alias("form"))
    # a form is tested once it is counted, not wherever it stands
    per = words.groupBy("language", "form", "source").agg(F.count("*").alias("n")).where(F.col("form").rlike(r"^[\p{L}'’-]+$"))
    forms = per.groupBy("language", "form").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where(F.col("n") >= least)
    # ranks within a language, from ordered buckets: by count, then by the form's first letters
    order = [F.asc("language"), F.desc("n"), F.asc("form")]
    # buckets of bounded number: rare forms by count and first letters, frequent ones by the logarithm of the count alone
    often = F.lpad((F.lit(20_000) - F.floor(F.log2("n") * 256)).cast("string"), 6, "0")
    bucket = F.concat(F.col("language"), often, F.when(F.col("n") <= 64, F.left("form", F.lit(2))).otherwise(""))
    ranked = R.ordinals(forms, order, bucket, "_at")
    first = ranked.groupBy("language").agg(F.min("_at").alias("_first"))
    return ranked.join(F.broadcast(first), "language").withColumn("usage_rank", F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def pronounce(lexicon_rows: DataFrame) -> DataFrame:
    """Adds ipa (by rule) and its analysis; forms without a nucleus are dropped."""
    spoken = lexicon_rows.withColumn("s", P.spoken(F.col("form"), F.col("language")))
    return spoken.where("s.a IS NOT NULL").select(*lexicon_rows.columns, "s.ipa", "s.a")


def channels(pronounced: DataFrame, *more: str) -> DataFrame:
    """ST-01, JN-01: a row per retrieval key of each form, with what bounded lookups order by, and further columns."""
    a = lambda c: F.col(f"a.{c}")
    keys = {"exact": a("exact_key"), "multi": a("multi_key"), "vowel": a("vowel_key"), "family": a("vowel_family"), "family_coda": F.concat_ws("/", a("vowel_family"), a("coda_class")),
            "final": F.concat_ws("/", F.get(F.split(a("final_tail"), " "), F.lit(0)), a("coda_class")), "coda": F.when(a("coda_key") != "", a("coda_key"))}
    entries = F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_order"), F.concat_ws(":", F.col("language"), k).alias("key"), k.isNotNull().alias("ok")) for i, (c, k) in enumerate(keys.items())))
    return pronounced.select("language", "form", "ipa", "usage_rank", *more, a("syllable_count").alias("syllables"), F.explode(F.filter(entries, lambda e: e["ok"])).alias("e")).select(
        "language", "form", "ipa", "usage_rank", *more, "syllables", "e.channel", "e.channel_order", "e.key")


def right_edge_suffixes(pronounced: DataFrame) -> DataFrame:
    """JN-04, SQ-09: a row per hyphenated suffix of the vowel key, for equality joins instead of LIKE."""
    return pronounced.select("language", "form", F.col("a.syllable_count").alias("syllables"), F.explode(F.array_distinct(T.suffix_keys("a.vowel_key"))).alias("suffix"))


def syllable_windows(phrases: DataFrame, phrase_id: str, words: str, language: str, least: int = 2, most: int = 6) -> DataFrame:
    """SQ-01: windows of 2..6 syllables over a phrase's words that cross a word boundary, with their vowel keys and spans.

    A row is a phrase: its words are spoken and cut where it stands, nothing is shuffled."""
    def run(rows: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "length", "vowel_key"), w)) for w in P.crossing_windows(own, g, least, most)] for own, g in zip(rows, languages)], dtype=object)

    found = F.pandas_udf(run, "array<struct<start:int,length:int,vowel_key:string>>")(F.col(words), F.col(language))
    return phrases.select(phrase_id, language, F.explode(found).alias("w")).select(phrase_id, language, "w.start", "w.length", "w.vowel_key")


#: Keys that a task counts before it hands them on.
COUNTED_KEYS = 200_000


def window_counts(phrases: DataFrame, words: str, language: str, least: int = 2, most: int = 6) -> DataFrame:
    """SQ-01: language, vowel_key, n (windows of `syllable_windows`) and phrases (that have one); each row is a phrase of its own.

    A task counts the keys it meets, up to a fixed number at a time, so what is shuffled are counts and not windows."""
    kind = dict(phrases.dtypes)[language]

    def run(frames):
        counts = {}

        def counted():
            out = pd.DataFrame([(*k, n, m) for k, (n, m) in counts.items()], columns=[language, "vowel_key", "n", "phrases"])
            counts.clear()
            return out

        for pdf in frames:
            for own, g in zip(pdf[words], pdf[language]):
                met = {}
                for _, _, key in P.crossing_windows(own, g, least, most):
                    met[key] = met.get(key, 0) + 1
                for key, n in met.items():
                    was = counts.get((g, key))
                    if was is None:
                        counts[g, key] = [n, 1]
                    else:
                        was[0] += n
                        was[1] += 1
                if len(counts) >= COUNTED_KEYS:
                    yield counted()
        yield counted()

    parts = phrases.select(language, words).mapInPandas(run, f"`{language}` {kind}, vowel_key string, n long, phrases long")
    return parts.groupBy(language, "vowel_key").agg(F.sum("n").alias("n"), F.sum("phrases").alias("phrases"))
