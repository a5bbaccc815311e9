"""Word forms: compounds, inflections and aliases as joins against a lexicon (JN-16..18, JN-25/26, PH-30, PH-34/35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T

from .relational import best_per_group


def compound_heads(words: DataFrame, lexicon: DataFrame, word: str = "form", least: int = 3) -> DataFrame:
    """JN-17: the best attested split of each word: right part in the lexicon, a variant of the left part too; the longest
    right part wins, then the more used one.  Splits are exploded and joined by equality."""
    splits = words.select(word, F.explode(T.split_candidates(word, least)).alias("s")).select(word, "s.left", "s.right")
    right = lexicon.select(F.col("form").alias("right"), F.col("n").alias("right_n"))
    variants = splits.join(right, "right").select(word, "right", "right_n", F.col("left").alias("written"), F.explode(T.left_variants("left")).alias("left"))
    both = variants.join(lexicon.select(F.col("form").alias("left"), F.col("n").alias("left_n")), "left")
    order = [F.desc(F.length("right")), F.desc("right_n"), F.desc("left_n"), F.asc("left")]
    return best_per_group(both, [word], order).select(word, "left", "written", "right")


def longest_known_suffix(words: DataFrame, lexicon: DataFrame, word: str = "form", least: int = 3) -> DataFrame:
    """PH-30: the longest proper suffix of a word that the lexicon holds."""
    s = words.select(word, F.explode(T.split_candidates(word, least)).alias("s")).select(word, F.col("s.right").alias("suffix"))
    return s.join(lexicon.select(F.col("form").alias("suffix")), "suffix", "left_semi").groupBy(word).agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))


#: Regular English endings, what the lemma ends with instead, and the inflection.
ENDINGS = (("ies", "y", "s"), ("es", "", "s"), ("s", "", "s"), ("ied", "y", "d"), ("ed", "", "d"), ("ed", "e", "d"), ("ing", "", "ing"), ("ing", "e", "ing"))


def inflected_from(words: DataFrame, lexicon: DataFrame, word: str = "form") -> DataFrame:
    """PH-34: known lemmas of regularly inflected forms: word, lemma and inflection."""
    w = F.col(word)
    options = F.array_compact(F.array(*(F.when(w.endswith(e) & (F.length(w) >= len(e) + 2), F.struct(F.concat(F.left(w, F.length(w) - len(e)), F.lit(put)).alias("lemma"), F.lit(kind).alias("inflection"))) for e, put, kind in ENDINGS)))
    each = words.select(word, F.explode(options).alias("o")).select(word, "o.lemma", "o.inflection")
    return each.join(lexicon.select(F.col("form").alias("lemma")), "lemma", "left_semi").distinct()


def inflected_phones(phones: Column, inflection: Column) -> Column:
    """PH-34: a lemma's phones with the ending's: [ɪz ɪd] after like sounds, voiceless after voiceless ones, else voiced."""
    last = F.element_at(F.split(phones, " "), -1)
    voiceless = last.isin("p", "t", "k", "f", "θ", "s", "ʃ", "tʃ")
    s = F.when(last.isin("s", "z", "ʃ", "ʒ", "tʃ", "dʒ"), "ɪ z").when(voiceless, "s").otherwise("z")
    d = F.when(last.isin("t", "d"), "ɪ d").when(voiceless, "t").otherwise("d")
    return F.concat(phones, F.lit(" "), F.when(inflection == "s", s).when(inflection == "d", d).otherwise("ɪ ŋ"))


def punctuation_aliases(words: DataFrame, lexicon: DataFrame, word: str = "form") -> DataFrame:
    """PH-35: known forms that a word equals without its punctuation, or without a possessive ending."""
    bare = F.regexp_replace(F.col(word), r"[^\p{L}\p{N}]", "")
    owner = F.regexp_extract(F.col(word), r"^(.+?)['’]s?$", 1)
    each = words.select(word, F.explode(F.array(F.struct(bare.alias("target"), F.lit("punctuation").alias("kind")), F.struct(owner.alias("target"), F.lit("possessive").alias("kind")))).alias("a")).select(word, "a.*")
    known = each.where((F.col("target") != "") & (F.col("target") != F.col(word)))
    return known.join(lexicon.select(F.col("form").alias("target")), "target", "left_semi").groupBy(word, "target").agg(F.max("kind").alias("kind"))


def best_form(tokens: DataFrame, options: DataFrame, on: str, priority: list[Column]) -> DataFrame:
    """JN-16/26: for each token the option of highest priority."""
    return best_per_group(tokens.select(on).distinct().join(options, on), [on], priority)


def prefix_cover(words: DataFrame, lexicon: DataFrame, word: str = "form", least: int = 3, most_parts: int = 6) -> DataFrame:
    """PH-30: a word that no entry holds, from entries: its longest known proper suffix, and what is before it covered from the
    left, each time by the longest known beginning; word, parts (in order, the suffix last).  Words that leave a rest have no
    row.  A beginning must have ``least`` letters; each of the at most ``most_parts`` steps is one equi-join."""
    tail = longest_known_suffix(words, lexicon, word, least)
    known = lexicon.select(F.col("form").alias("part"))
    open_ = tail.withColumn("rest", F.expr(f"left(`{word}`, length(`{word}`) - length(suffix))")).withColumn("parts", F.array().cast("array<string>"))
    done = None
    for _ in range(most_parts):
        cut = F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("rest"))), lambda i: F.left("rest", i))
        each = open_.where(F.length("rest") >= least).select(word, "suffix", "rest", "parts", F.explode(F.array_distinct(cut)).alias("part"))
        best = each.join(known, "part", "left_semi").groupBy(word, "suffix", "rest", "parts").agg(F.max_by("part", F.length("part")).alias("part"))
        step = best.select(word, "suffix", F.expr("substr(rest, length(part) + 1)").alias("rest"), F.concat("parts", F.array("part")).alias("parts"))
        ready = step.where("rest = ''").select(word, F.concat("parts", F.array("suffix")).alias("parts"))
        done = ready if done is None else done.unionByName(ready)
        open_ = step.where("rest != ''")
    return done


#: Word classes that take each regular ending.
ENDING_CLASSES = {"s": ("noun", "verb"), "d": ("verb",), "ing": ("verb",)}


def tagged_inflections(words: DataFrame, lexicon: DataFrame, word: str = "form", classes: str = "classes") -> DataFrame:
    """PH-34: `inflected_from`, for lemmas whose classes (an array in ``lexicon``) take the ending only."""
    found = inflected_from(words, lexicon, word).join(lexicon.select(F.col("form").alias("lemma"), F.col(classes).alias("_c")), "lemma")
    fits = F.coalesce(*(F.when(F.col("inflection") == k, F.arrays_overlap("_c", F.array(*map(F.lit, v)))) for k, v in ENDING_CLASSES.items()), F.lit(False))
    return found.where(fits).select(word, "lemma", "inflection")


def compound_evidence(analyses: DataFrame, words: DataFrame, lexicon: DataFrame, analysis: str = "analysis", word: str = "form") -> DataFrame:
    """AG-33: per form the heads that its analyses say or, where one says none, that attested splits show: state (unresolved,
    converged, conflict), heads and where they come from.  ``analyses``: form, analysis, head (null if not said)."""
    attested = compound_heads(words, lexicon, word).select(word, F.col("right").alias("_split"))
    each = analyses.join(attested, word, "left").withColumn("_head", F.coalesce("head", "_split")).withColumn("_from", F.when(F.col("head").isNotNull(), "stated").when(F.col("_split").isNotNull(), "attested_split"))
    sets = each.groupBy(word).agg(F.countDistinct(analysis).alias("analyses"), F.array_sort(F.collect_set("_head")).alias("heads"), F.array_sort(F.collect_set("_from")).alias("evidence"))
    return sets.withColumn("state", F.when(F.size("heads") == 0, "unresolved").when(F.size("heads") == 1, "converged").otherwise("conflict"))


#: How well a lexicon form answers a phrase's token, the best first.
FORM_LEVELS = ("exact_current_ranked", "exact_current", "lower_current_ranked", "lower_current", "alias_current", "exact_historical", "lower_historical", "alias_historical")


def token_forms(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """JN-16: for each different token the best form: as written before lower case before alias, current before historical,
    with a usage rank before without; then the better rank, then the form.  ``lexicon``: form, kind (form or alias of the key),
    key, historical, usage_rank."""
    t = tokens.select(token).where(F.col(token).isNotNull()).distinct()
    hits = t.join(lexicon, F.lower(F.col(token)) == F.lower("key"))
    exact, current, ranked = F.col("form") == F.col(token), ~F.coalesce("historical", F.lit(False)), F.col("usage_rank").isNotNull()
    alias = F.col("kind") == "alias"
    level = (F.when(alias & current, 4).when(alias, 7).when(exact & current & ranked, 0).when(exact & current, 1).when(current & ranked, 2).when(current, 3).when(exact, 5).otherwise(6))
    best = best_per_group(hits.withColumn("level", level), [token], [F.asc("level"), F.asc_nulls_last("usage_rank"), F.asc("form")])
    return best.select(token, "form", F.element_at(F.array(*map(F.lit, FORM_LEVELS)), F.col("level") + 1).alias("level"), "usage_rank")


def dictionary_options(headwords: DataFrame, listed: DataFrame, surface: DataFrame, word: str = "surface") -> DataFrame:
    """JN-25: dictionary records that answer a surface, as their headword or as a form that they list; surface, record, match_kind.

    ``headwords``: record, headword; ``listed``: record, form."""
    key = lambda c: T.normalize_surface(c)
    s = surface.select(word).distinct().withColumn("_k", key(word))
    own = headwords.select("record", key("headword").alias("_k"), F.lit("headword").alias("match_kind"))
    other = listed.select("record", key("form").alias("_k"), F.lit("listed_form").alias("match_kind"))
    return s.join(own.unionByName(other), "_k").groupBy(word, "record").agg(F.min("match_kind").alias("match_kind"))


#: Sources of an English name's pronunciation, the first preferred.
NAME_SOURCES = ("curated", "accepted_en_form", "accepted_en_token_composition", "espeak_ng_generated_secondary")


def name_resolution(names: DataFrame, options: DataFrame, name: str = "name") -> DataFrame:
    """JN-26: for each name the pronunciation of the best source; unknown sources stand last.  ``options``: name, source, ipa."""
    rank = F.coalesce(*(F.when(F.col("source") == s, i) for i, s in enumerate(NAME_SOURCES)), F.lit(len(NAME_SOURCES)))
    return best_form(names, options.where(F.col("ipa").isNotNull()).withColumn("_s", rank), name, [F.asc("_s"), F.asc("ipa")]).drop("_s")
