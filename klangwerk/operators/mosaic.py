"""Phrases: their pronunciation, syllable windows and retrieval by anchors (SQ-01..03, 07, 10, JN-07, JN-23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import phonology as P

from .grouped import flat_rows
from .relational import top_per_group

#: Retrieval channels, the closest first.
CHANNELS = ("exact_tail", "vowel_coda", "vowel", "vowel_family_coda_class", "final_nucleus_coda_class")
PER_CHANNEL, MOST_CANDIDATES = 192, 512
#: Tiers of the rhyme classes.
TIERS = {"multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3, "weak": 9}


def phrase_pronunciations(phrases: DataFrame, lexicon: DataFrame, phrase: str, tokens: str, language: str) -> DataFrame:
    """SQ-07: phrase, ipa, status, a (analysis) and token_ends (syllables up to the end of each token).

    ``lexicon``: language, form, ipa, one row a form.  All tokens must be known; their pronunciations are joined, and the
    whole must have as many sounds and syllables as its parts.  Statuses: ready, empty, unresolved_token,
    analysis_failed, boundary_mismatch."""
    each = phrases.select(phrase, language, F.posexplode_outer(tokens).alias("at", "form"))
    # a form is analysed once, not wherever it stands
    forms = lexicon.select(F.col("language").alias(language), "form", "ipa").withColumn("p", P.extent(F.col("ipa"), F.col(language)))
    part = each.join(forms, [language, "form"], "left")
    row = F.struct("at", F.col("p.ipa").alias("ipa"), F.col("p.sounds").alias("sounds"), F.col("p.syllables").alias("syllables"))
    whole = part.groupBy(phrase, language).agg(F.count("at").alias("n"), F.count_if(F.col("at").isNotNull() & F.col("ipa").isNull()).alias("unknown"), F.count_if(F.col("ipa").isNotNull() & F.col("p.ipa").isNull()).alias("failed"),
                                               F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), row))).alias("parts"))
    ready = (F.col("n") > 0) & (F.col("unknown") == 0) & (F.col("failed") == 0)
    joined = whole.withColumn("joined", F.when(ready, F.array_join(F.transform("parts", lambda x: x["ipa"]), "‿"))).withColumn("a", P.analysis(F.col("joined"), F.col(language)))
    total = lambda k: F.aggregate("parts", F.lit(0), lambda n, x: n + F.coalesce(x[k], F.lit(0)))
    status = (F.when(F.col("n") == 0, "empty").when(F.col("unknown") > 0, "unresolved_token").when((F.col("failed") > 0) | F.col("a.ipa").isNull(), "analysis_failed")
              .when((F.size("a.phonemes") != total("sounds")) | (F.col("a.syllable_count") != total("syllables")), "boundary_mismatch").otherwise("ready"))
    ends = F.transform("parts", lambda x, i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0), lambda n, y: n + y["syllables"]))
    out = joined.withColumn("status", status)
    done = F.col("status") == "ready"
    return out.select(phrase, language, "status", F.when(done, F.col("joined")).alias("ipa"), F.when(done, F.col("a")).alias("a"), F.when(done, ends).alias("token_ends"))


def phrase_windows(pronounced: DataFrame, phrase: str, language: str) -> DataFrame:
    """SQ-01/02/10: a row per window of two to six syllables that crosses a word boundary: its span, boundaries and keys."""
    least, most = P.WINDOW_SYLLABLES
    ready = pronounced.where("status = 'ready'").select(phrase, language, "ipa", "token_ends", F.col("a.syllables").alias("syllables"))
    kinds, names = dict(ready.dtypes), [k.split(":")[0] for k in P.WINDOW_KEYS[7:-1].split(",")]

    def run(own, g, ipa, ends, syllables):
        for i in range(len(syllables) if g in P.PROFILES else 0):
            for j in range(i + least, min(len(syllables), i + most) + 1):
                if crossed := sum(i < e < j for e in ends):
                    w = P.window_analysis(syllables, i, j, g)
                    yield own, g, ipa, i, j, crossed, i > 0 and i not in ends, j not in ends, *(w[k] for k in names)

    schema = f"`{phrase}` {kinds[phrase]}, `{language}` {kinds[language]}, ipa string, start int, end int, crossed int, starts_inside boolean, ends_inside boolean, {P.WINDOW_KEYS[7:-1]}"
    return flat_rows(ready, run, schema)


def _channels(keys: str, family: bool) -> dict:
    k = lambda c: F.col(f"{keys}{c}")
    own = {"exact_tail": k("exact_key"), "vowel_coda": F.concat_ws("\u001f", k("vowel_key"), k("coda_key")), "vowel": k("vowel_key"),
           "vowel_family_coda_class": F.concat_ws("\u001f", k("vowel_family"), k("coda_class")), "final_nucleus_coda_class": F.concat_ws("\u001f", k("final_nucleus"), k("coda_class"))}
    return own if family else {c: v for c, v in own.items() if c != "vowel_family_coda_class"}


def _keyed(df: DataFrame, keys: str, columns: list, family: bool) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(CHANNELS.index(c)).alias("channel_order"), v.alias("key")) for c, v in _channels(keys, family).items()))
    return df.select(*columns, F.explode(rows).alias("e")).select("*", "e.*").drop("e")


def retrieve_windows(queries: DataFrame, windows: DataFrame, query: str, phrase: str, language: str, family: bool = True, per_channel: int = PER_CHANNEL) -> DataFrame:
    """JN-07 (JN-23 without ``family``): windows that a query's anchors find: query, anchor, window, channels.

    ``queries``: query, language, ipa.  The first four channels ask for equal syllable counts, the last for one more or less
    within two to six.  Of each channel an anchor takes its ``per_channel`` first windows (by syllables in the last, then by
    phrase and span); every posting is cut to so many of each syllable count before the join, which changes no result."""
    least, most = P.WINDOW_SYLLABLES
    asked = queries.select(query, language, F.col("ipa").alias("query_ipa"), F.explode(P.anchors_of(F.col("ipa"), F.col(language))).alias("x"))
    q = _keyed(asked, "x.keys.", [query, language, "query_ipa", F.col("x.anchor").alias("anchor"), F.col("x.position").alias("position"), F.col("x.keys.syllable_count").alias("n")], family)
    wide = F.col("channel") == CHANNELS[-1]
    q = q.withColumn("syllable_count", F.explode(F.when(wide, F.sequence(F.greatest(F.lit(least), F.col("n") - 1), F.least(F.lit(most), F.col("n") + 1))).otherwise(F.array("n"))))
    order = [F.asc(phrase), F.asc("start"), F.asc("end")]
    w = _keyed(windows, "", [phrase, language, "ipa", "start", "end", "syllable_count"], family)
    cut = top_per_group(w, [language, "channel", "key", "syllable_count"], order, per_channel, "_at").select(phrase, language, "ipa", "start", "end", "syllable_count", "channel", "key")
    hits = q.join(cut, [language, "channel", "key", "syllable_count"])
    bounded = top_per_group(hits, [query, "anchor", "channel"], [F.asc("syllable_count"), *order], per_channel, "_at")
    return bounded.groupBy(query, language, "query_ipa", "anchor", "position", phrase, "ipa", "start", "end").agg(F.min("channel_order").alias("channel_order"), F.array_sort(F.collect_set("channel")).alias("channels"))


def ranked_windows(found: DataFrame, query: str, phrase: str, language: str, limit: int = MOST_CANDIDATES, weak: bool = False) -> DataFrame:
    """JN-07, RK-11: the best anchor of each window by tier, score, relations, channel and anchor; weak windows without a sound
    relation only if asked for; numbered by tier, score, channel and window."""
    s = found.withColumn("s", P.window_score(F.col("query_ipa"), F.col("position"), F.col("ipa"), F.col("start"), F.col("end"), F.col(language)))
    relations = F.when(F.col("s.assonance").isNotNull(), 1).otherwise(0) + F.when(F.col("s.consonance_relation").isNotNull(), 1).otherwise(0)
    tier = F.create_map(*(x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v))))
    scored = s.withColumns({"type": F.col("s.type"), "tier": tier[F.col("s.type")], "score": F.round("s.overall", 4), "relations": relations})
    scored = scored if weak else scored.where("type != 'weak' OR relations > 0")
    best = F.row_number().over(Window.partitionBy(query, phrase, "start", "end").orderBy("tier", F.desc("score"), F.desc("relations"), "channel_order", "anchor"))
    once = scored.withColumn("_b", best).where("_b = 1")
    order = [F.asc("tier"), F.desc("score"), F.desc("relations"), F.asc("channel_order"), F.asc(phrase), F.asc("start"), F.asc("end")]
    return top_per_group(once, [query], order, limit).select(query, language, phrase, "start", "end", "anchor", "channels", "type", "tier", "score", "rank")
