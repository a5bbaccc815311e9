"""Rhyme analysis of songs: groups of lines in order (SC, WN-11, AG-20)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import phonology as P
from klangwerk.functions import text as T

from . import lexicon as L
from . import workspace as W
from .grouped import by_group


def settled_words(lines: DataFrame, song: str, line: str, text: str = "text") -> DataFrame:
    """`line_words`, written once for plans that read the words again and again."""
    return W.settled(line_words(lines, song, line, text), f"{W.shared_dir(lines.sparkSession)}/klangwerk-words-{uuid.uuid4().hex}")


def line_words(lines: DataFrame, song: str, line: str, text: str = "text") -> DataFrame:
    """SC-05: the end word of each line; null where a line has none."""
    word = T.end_word(F.coalesce(F.col(text), F.lit("")))
    return lines.select(song, line, F.when(word != "", word).alias("word"))


#: Ranks of the relations between end words, the closest first.
RELATION_TIERS = {"identity": -1, "multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3, "assonance": 4, "consonance": 5}


def word_relations(words: DataFrame, song: str, language: str) -> DataFrame:
    """SC-02: song, a, b, type, score, primary: the relation of two different end words of a song, both ways round.

    Words are looked up by their retrieval keys, so only those that share one are compared; each pair is scored once, in
    the order of its letters."""
    own = words.where("word IS NOT NULL").select(song, "word").distinct()
    forms = own.select(F.lit(language).alias("language"), F.col("word").alias("form"), F.lit(None).cast("long").alias("usage_rank")).distinct()
    keyed = own.join(L.channels(L.pronounce(forms)).select(F.col("form").alias("word"), "ipa", "channel", "key"), "word")
    side = lambda n: keyed.select(song, "channel", "key", F.col("word").alias(n), F.col("ipa").alias(f"ipa_{n}"))
    pairs = side("a").join(side("b"), [song, "channel", "key"]).where("a < b").select(song, "a", "b", "ipa_a", "ipa_b").distinct()
    scored = pairs.withColumn("s", P.pair_score(F.col("ipa_a"), F.col("ipa_b"), F.lit(language)))
    kind = F.when(F.col("s.type") != "weak", F.col("s.type")).when(F.col("s.assonance").isNotNull(), "assonance").when(F.col("s.consonance_relation").isNotNull(), "consonance")
    found = scored.select(song, "a", "b", kind.alias("type"), F.round("s.overall", 4).alias("score"), (F.col("s.type") != "weak").alias("primary")).where("type IS NOT NULL")
    return found.unionByName(found.select(song, F.col("b").alias("a"), F.col("a").alias("b"), "type", "score", "primary"))


def strongest_pairs(words: DataFrame, song: str, line: str, language: str) -> DataFrame:
    """SC-04: song, line, prior, type, score, primary: of each line the closest earlier line, however far back; of equally
    close ones the first.  An equal end word is closest of all.

    Only the first line of each word can be that line, so a line meets the related words of its song once each."""
    lines = words.where("word IS NOT NULL")
    first = lines.groupBy(song, "word").agg(F.min(line).alias("prior"))
    same = lines.join(first, [song, "word"]).select(song, line, "prior", F.lit("identity").alias("type"), F.lit(1.0).alias("score"), F.lit(True).alias("primary"))
    related = lines.join(word_relations(words, song, language).withColumnRenamed("a", "word"), [song, "word"])
    other = related.join(first.withColumnRenamed("word", "b"), [song, "b"]).select(song, line, "prior", "type", "score", "primary")
    tier = F.create_map(*(x for k, v in RELATION_TIERS.items() for x in (F.lit(k), F.lit(v))))
    every = same.unionByName(other).where(F.col("prior") < F.col(line))
    best = F.min_by(F.struct("prior", "type", "score", "primary"), F.struct(tier[F.col("type")], -F.col("score"), F.col("prior")))
    return every.groupBy(song, line).agg(best.alias("m")).select(song, line, "m.*")


def occurrence_relations(occurrences: DataFrame, relations: DataFrame, song: str, place: str) -> DataFrame:
    """JN-19: relations of words carried over to their occurrences: song, left, right (places, left first), type, score.

    ``relations``: song, a, b, type, score, both ways round; equal words are related by identity.  The result lists pairs of
    one document's occurrences, as many as it has; documents are bounded."""
    side = lambda n, w: occurrences.where("word IS NOT NULL").select(song, F.col(place).alias(n), F.col("word").alias(w))
    same = side("left", "word").join(side("right", "word"), [song, "word"]).select(song, "left", "right", F.lit("identity").alias("type"), F.lit(1.0).alias("score"))
    other = side("left", "a").join(relations.select(song, "a", "b", "type", "score"), [song, "a"]).join(side("right", "b"), [song, "b"]).select(song, "left", "right", "type", "score")
    return same.unionByName(other).where(F.col("left") < F.col("right"))


def relation_counts(relations: DataFrame, keys: list[str]) -> DataFrame:
    """SC-06: number of relations of each type."""
    return relations.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def chains(labelled: DataFrame, song: str, line: str) -> DataFrame:
    """SC-07: lines that share a label, two and more: their number, first and last line, and the widest gap between neighbours."""
    own = labelled.where(F.col("label") != NO_WORD)
    gap = F.col(line) - F.lag(line).over(Window.partitionBy(song, "label").orderBy(line))
    return own.withColumn("gap", gap).groupBy(song, "label").agg(F.count("*").alias("lines"), F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.max("gap").alias("widest_gap")).where("lines > 1")


#: The label of a line without a word.
NO_WORD = "—"


def scheme(words: DataFrame, matches: DataFrame, song: str, line: str) -> DataFrame:
    """SC-03: labels: a line takes that of its closest earlier line if the relation is a rhyme, else the next letter.  In order
    by definition, so per song; lines without a word are marked."""
    rhymes = matches.where("primary") if "primary" in matches.columns else matches
    joined = words.select(song, line, "word").join(rhymes.select(song, line, "prior"), [song, line], "left")
    kinds = dict(joined.dtypes)

    def label(rows):
        names, n = {}, 0
        for own, at, word, prior in rows:
            if word is None:
                yield own, at, -1
                continue
            if prior is not None and prior in names:
                names[at] = names[prior]
            else:
                names[at], n = n, n + 1
            yield own, at, names[at]

    placed = by_group(joined.select(song, line, "word", "prior"), [song], label, f"`{song}` {kinds[song]}, `{line}` {kinds[line]}, `group` int", (line,))
    return placed.withColumn("label", F.when(F.col("group") < 0, NO_WORD).otherwise(T.scheme_label("group"))).drop("group")


def structure(lines: DataFrame, song: str, line: str, section: str, section_no: str, tokens: str) -> dict[str, DataFrame]:
    """AG-20: what songs are made of: lines and tokens by section type, the walk of section types with first and last ones, and
    how far apart equal end words are (one to four lines)."""
    from .aggregates import distribution, repeat_distance, transitions

    sections = lines.groupBy(song, section_no, section).agg(F.count("*").alias("lines"), F.avg(tokens).alias("tokens"))
    ends = repeat_distance(lines.where("word IS NOT NULL"), [song], [line], "word")
    return {"lines": distribution(sections, [section], "lines"), "tokens": distribution(lines, [section], tokens), "walk": transitions(sections, [song], [section_no], section),
            "distance": ends.where("distance IS NOT NULL").groupBy("distance").agg(F.count("*").alias("n"))}
