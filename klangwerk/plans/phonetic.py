"""Phonology and search over the corpus lexicon.  Their rules are beyond SQL; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T
from klangwerk.operators import corpus as C
from klangwerk.operators import entities as N
from klangwerk.operators import index as I
from klangwerk.operators import lexicon as L
from klangwerk.operators import ranking as R
from klangwerk.operators import relational as O
from klangwerk.operators import search as S
from klangwerk.operators import song as G

from .registry import query


@query()
def ph29_lexicon_pronunciations(t) -> DataFrame:
    p = L.pronounce(L.lexicon(t.documents))
    return p.select("language", "form", "n", "usage_rank", "ipa", "a.exact_key", "a.vowel_key", "a.vowel_family", "a.coda_class", "a.stress_pattern", "a.syllable_count")


def _index(t) -> I.Index:
    """The built index of the corpus lexicon; built by the first query that asks, read by all others."""
    return I.open_or_build(t.spark, "lexicon", I.files_of(t.documents), lambda: L.lexicon(t.documents))


def _frequent(index: I.Index) -> DataFrame:
    return O.top_per_group(index.words.select("language", "form", "usage_rank").where(F.length("form") >= 5), ["language"], [F.asc("usage_rank")], 20).drop("rank")


@query()
def search_frequent_words(t) -> DataFrame:
    """Rhymes of the 20 most used words of five letters and more of each language."""
    index = _index(t)
    return I.search(_frequent(index), index)


@query()
def sc01_end_word_search(t) -> DataFrame:
    """The five best rhymes of the corpus lexicon for every end word of a turn, one search for all words of all conversations."""
    ends = G.line_words(t.conversations, "conv_id", "turn").where("word IS NOT NULL").select(F.lit("en").alias("language"), F.col("word").alias("form")).distinct()
    return I.search(ends, _index(t), 5)


@query()
def ph23_bounded_scoring(t) -> DataFrame:
    """How many candidates of these words the bounds leave to be scored."""
    index = _index(t)
    best = S.best_scored(I.lookup(I.asked(_frequent(index)), index))
    return best.groupBy("language", "query").agg(F.max("n_candidates").alias("candidates"), F.max("n_scored").alias("scored"), F.count("*").alias("kept"))


@query()
def sq01_cross_word_windows(t) -> DataFrame:
    """The vowel keys of the windows of all lines: how many windows, and in how many lines."""
    lines = C.sentence_tokens(t.documents.where(F.col("lang").isin(*L.LANGUAGES)), "lang")
    return L.window_counts(lines, "tokens", "lang")


@query()
def sq09_suffix_postings(t) -> DataFrame:
    return L.right_edge_suffixes(L.pronounce(L.lexicon(t.documents))).groupBy("language", "suffix").agg(F.count("*").alias("forms"), F.min("syllables").alias("least"), F.max("syllables").alias("most"))


@query()
def sc03_rhyme_scheme(t) -> DataFrame:
    words = G.settled_words(t.conversations, "conv_id", "turn")
    return G.scheme(words, G.strongest_pairs(words, "conv_id", "turn", "en"), "conv_id", "turn")


@query()
def rk15_entity_results(t) -> DataFrame:
    """Parts as entities of their brand: order, then one per name and one per size."""
    p = R.tie_percentile_ppm(t.part, ["p_type"], "p_retailprice")
    rows = p.select(F.col("p_brand").alias("query"), F.col("p_name").alias("entity"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_type").alias("surface"), (F.col("p_size") % 4).alias("tier"),
                    (F.col("p_partkey") % 97 / 97.0).alias("score"), (F.col("p_size") % 3).alias("distance"), (F.col("ppm") / 1e6).alias("percentile"), F.col("p_retailprice").alias("popularity"))
    return N.diverse(N.ordered(rows, "query"), "query").select("query", "entity", "surface", "rank", "kept_rank")


@query()
def wn09_near_tie_bands(t) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", (F.col("p_retailprice") / 1000.0).alias("score"))
    return R.near_tie_bands(rows, ["p_brand"], "score", ["p_partkey"])


@query()
def mk01_backoff(t) -> DataFrame:
    """The best continuation of each line's last words, from contexts of up to four and their 128 best continuations."""
    lines = C.sentence_tokens(t.documents, "doc_id").withColumn("id", F.concat_ws(":", "doc_id", "line_no"))
    contexts = lines.select("id", F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - 4), 4).alias("context"))
    # a context's best continuation tells whether the model knows it
    best = C.model(lines.select("tokens"), 4, asked=contexts).where("rank = 1")
    return C.backoff(contexts, best, 4).select("id", "length", "next", "n", "total")
