"""Orders of results (RK-01..05, 16..18, 20..25) and channel merges (ST-03/04, WN-13) as sort keys and windows.

The product's pairwise comparator for current words falls back to another order for some pairs, so it is no total order; here
each row gets a key such that any two rows compare as the comparator does wherever its own answers agree with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klangwerk.functions import text as T

from .base import as_col

#: Fixed value: how many powers of ten rarer than the query a word may be.
COMMONNESS_HORIZON = 1.0


def usage_order(tier: str = "tier", distance: str = "distance", usage: str = "usage_rank", score: str = "score", word: str = "word") -> list[Column]:
    """RK-01, RK-22: tier, syllable distance, usage (unranked last), score, word."""
    return [F.asc(tier), F.asc(distance), F.asc_nulls_last(usage), F.desc(score), F.asc(word)]


def score_band_order(tier: str = "tier", score: str = "score", usage: str = "usage_rank", word: str = "word", width: float = 0.05) -> list[Column]:
    """RK-22: tier, score band, usage (unranked last), score, word."""
    return [F.asc(tier), T.score_band(score, width).desc(), F.asc_nulls_last(usage), F.desc(score), F.asc(word)]


def commonness_delta(rank: Column | str, query_rank: Column | str) -> Column:
    """Powers of ten by which a word is rarer than the query; null where either has no rank."""
    r, q = as_col(rank), as_col(query_rank)
    return F.when((r > 0) & (q > 0), F.log10(r / q))


def modern_order(query_rank: Column | str, modern: Column | str, tags: Column | str, primary: Column | str, tier: str = "tier", distance: str = "distance", usage: str = "usage_rank", score: str = "score", word: str = "word") -> list[Column]:
    """RK-02: tier and syllable distance; then for ranked words with a rhyme class, below the best tier of a ranked current
    query: those within the commonness horizon before others, not rare before rare, score bands of .05, usage, score, word.

    All other rows, and those beyond the horizon, take the usage order; unranked ones stand behind ranked ones."""
    u, q = F.col(usage), as_col(query_rank)
    applies = F.coalesce(as_col(modern) & (q > 0), F.lit(False)) & (F.col(tier) != 0) & as_col(primary).isNotNull() & u.isNotNull()
    beyond = applies & (commonness_delta(u, q) > COMMONNESS_HORIZON)
    within = applies & ~beyond
    rare = F.coalesce(F.exists(as_col(tags), lambda t: F.lower(F.trim(t)) == "rare"), F.lit(False))
    return [F.asc(tier), F.asc(distance), F.when(u.isNull(), 2).when(beyond, 1).otherwise(0).asc(), F.when(within & rare, 1).otherwise(0).asc(),
            F.when(within, -T.score_band(score)).otherwise(0).asc(), F.asc_nulls_last(usage), F.desc(score), F.asc(word)]


def type_order(types: Column | str, kind: str, strength: str, relation_score: str, recommended: list[Column], distance: str = "distance", usage: str = "usage_rank", score: str = "score", word: str = "word") -> list[Column]:
    """RK-03: rows of the type first; sound relations by strength rank and score, then distance, usage, score, word; rhyme
    classes by the recommended order."""
    other = (~F.array_contains(as_col(types), kind)).cast("int").asc()
    if kind in ("assonance", "consonance"):
        return [other, F.asc_nulls_last(strength), F.desc_nulls_last(relation_score), F.asc(distance), F.asc_nulls_last(usage), F.desc(score), F.asc(word)]
    return [other, *recommended]


def user_order(sort: str, index: str = "index", word: str = "word", distance: str = "distance", percentile: str = "percentile", usage: str = "usage_rank", count: str = "usage_count", closeness: str = "relation_score") -> list[Column]:
    """RK-17: alpha, syllables, common, closest or recommended; what is equal keeps its place."""
    ranked = F.when(F.col(usage) > 0, F.col(usage))
    keys = {"recommended": [], "alpha": [F.asc(F.lower(word))], "syllables": [F.asc(distance)],
            "common": [F.desc_nulls_last(percentile), ranked.asc_nulls_last(), F.coalesce(F.col(count), F.lit(0)).desc()], "closest": [F.desc_nulls_last(closeness)]}
    return [*keys[sort], F.asc(index)]


def collated_order(word: str = "word", locale: str = "de") -> list[Column]:
    """SF-26: words as the locale sorts them, equal ones by their characters."""
    return [F.collate(word, {"de": "de", "en": "en"}[locale]).asc(), F.asc(word)]


def log_commonness_score(score: Column | str, rank: Column | str, weight: float) -> Column:
    """RK-20: score less ``weight`` for each power of ten of the usage rank; null for unranked words."""
    r = as_col(rank)
    return F.when(r > 0, as_col(score) - weight * F.log10(r))


def lexical_hybrid_order(weight: float, tier: str = "tier", primary: str = "primary_type", distance: str = "distance", usage: str = "usage_rank", layer: str = "lexicon_layer", score: str = "score", word: str = "word") -> list[Column]:
    """RK-20: tier and distance; rows of the best tier and mere relations by usage, all others by score with commonness;
    unranked words of the current lexicon before other unranked ones."""
    protected = (F.col(tier) == 0) | F.col(primary).isNull()
    unranked = F.when(F.col(usage) > 0, 0).when(F.lower(layer) == "modern", 1).otherwise(2)
    return [F.asc(tier), F.asc(distance), protected.desc(), F.when(protected, F.col(usage).isNull().cast("int")).otherwise(unranked).asc(),
            F.when(~protected, log_commonness_score(score, usage, weight)).desc_nulls_last(), F.asc_nulls_last(usage), F.desc(score), F.asc(word)]


#: The measures by which entities are cut, the first that tells two apart deciding.
ENTITY_MEASURES = ("sitelinks", "wikipedias", "external_ids", "statements")


def entity_control_order(qrank: str = "qrank", entity: str = "entity") -> list[Column]:
    """RK-21: QRank (missing last), sitelinks, Wikipedias, external ids, statements, id."""
    return [F.desc_nulls_last(qrank), *(F.desc_nulls_last(m) for m in ENTITY_MEASURES), F.asc(entity)]


def entity_hybrid_order(score: str = "candidate_ppm", qrank: str = "qrank", entity: str = "entity") -> list[Column]:
    """RK-21: the cut score in millionths, then the control order."""
    return [F.desc(score), *entity_control_order(qrank, entity)]


def evidence_order(tier: str = "tier", quality: str = "quality", usage: str = "usage_rank", distance: str = "distance", word: str = "word") -> list[Column]:
    """RK-23: tier, quality, known usage before unknown, usage, distance, word."""
    return [F.asc(tier), F.desc(quality), F.asc_nulls_last(usage), F.asc(distance), F.asc(word)]


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def merged_limit(parts: list[DataFrame], keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """RK-18: the first ``limit`` rows of several ordered lists, per key; each list is cut before they meet."""
    from .relational import top_per_group

    union = None
    for p in parts:
        own = top_per_group(p, keys, order, limit, "_own").drop("_own")
        union = own if union is None else union.unionByName(own)
    return top_per_group(union, keys, order, limit)


def stratified_tasks(df: DataFrame, query: str, category: str, order: list[Column], top: int, per_category: int, most: int) -> DataFrame:
    """RK-24: tasks of a query: its ``top`` first rows, then the first ``per_category`` of each category, up to ``most``."""
    placed = numbered(numbered(df, [query], order, "_at"), [query, category], order, "_in")
    chosen = placed.where((F.col("_at") <= top) | (F.col("_in") <= per_category))
    fill = [F.when(F.col("_at") <= top, 0).otherwise(1).asc(), *order]
    return numbered(chosen, [query], fill, "task").where(F.col("task") <= most).drop("_at", "_in")


def commands(df: DataFrame, title: str, keywords: str, query: str) -> DataFrame:
    """RK-25: commands that hold the query, those that begin with it first, then those whose title holds it, then by keyword."""
    q, t = query.strip().lower(), F.lower(title)
    level = F.when(t.startswith(q), 0).when(t.contains(q), 1).when(F.exists(keywords, lambda k: F.lower(k).contains(q)), 2)
    return df.withColumn("level", level).where("level IS NOT NULL").orderBy("level", title)


def ordered_union(*arrays: Column | str) -> Column:
    """ST-03: values of several arrays, each once, where first seen; nulls and blanks left out."""
    every = F.flatten(F.array(*(F.coalesce(as_col(a), F.array().cast("array<string>")) for a in arrays)))
    return F.array_distinct(F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))


def channel_merge(words: list[tuple[str, DataFrame]], others: list[tuple[str, DataFrame]], keys: list[str], order: list[Column], normalized: str) -> DataFrame:
    """ST-04, WN-13: word results of several languages interleaved by their rank in their own channel, the first language
    first where ranks are equal; other kinds keep their own lists behind.  A form that two languages hold stays with the
    better rank.  kind, channel_rank and position tell where a row stands."""
    union = None
    for i, (name, df) in enumerate(words):
        own = numbered(df, keys, order, "channel_rank").withColumns({"kind": F.lit("word"), "language": F.lit(name), "_l": F.lit(i)})
        union = own if union is None else union.unionByName(own)
    place = [F.asc("channel_rank"), F.asc("_l"), F.asc(normalized)]
    once = numbered(union, [*keys, normalized], place, "_once").where("_once = 1").drop("_once")
    out = numbered(once, keys, place, "position").drop("_l")
    for kind, df in others:
        own = numbered(df, keys, order, "channel_rank").withColumns({"kind": F.lit(kind), "language": F.lit(None).cast("string"), "position": F.col("channel_rank")})
        out = out.unionByName(own)
    return out
