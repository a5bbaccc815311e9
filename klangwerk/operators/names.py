"""Entity names: pronunciation by exact entry or composition, and retrieval by anchors (SQ-08, PH-37, JN-05, JN-08, JN-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T

from .relational import postings, top_per_group

MOST_TOKENS = 6
#: Channels of the English lookup with the most candidates of each, the first the closest; and of all together.
ENGLISH_CHANNELS = {"exact": 1536, "multi": 1536, "vowel": 128, "family_coda": 128, "coda": 128}
ENGLISH_MOST = 3072


def resolved_names(names: DataFrame, pronunciations: DataFrame, name: str, most_tokens: int = MOST_TOKENS, exact: bool = True) -> DataFrame:
    """SQ-08, PH-37: name, status, tokens, unresolved and ipa of each different name.

    ``pronunciations``: form (lower case), ipa, one row a form.  A name known as a whole is exact_source_backed; else all its
    words must be known and no more than ``most_tokens``: bounded_token_composition, their pronunciations in order.
    Otherwise unresolved_empty_surface, unresolved_too_many_tokens or unresolved_token with the words that are missing."""
    each = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_norm", T.normalize_surface(name)).withColumn("_tokens", F.transform(T.word_tokens(name), F.lower))
    known = pronunciations.select("form", "ipa")
    whole = each.join(known.withColumnRenamed("ipa", "_whole"), F.col("_norm") == F.col("form"), "left").drop("form") if exact else each.withColumn("_whole", F.lit(None).cast("string"))
    words = whole.where(F.col("_whole").isNull() & F.size("_tokens").between(1, most_tokens)).select(name, F.posexplode("_tokens").alias("at", "form")).join(known, "form", "left")
    parts = words.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("at", "form", "ipa"))).alias("p"))
    out = whole.join(parts, name, "left")
    missing = F.transform(F.filter("p", lambda x: x["ipa"].isNull()), lambda x: x["form"])
    status = (F.when(F.col("_norm") == "", "unresolved_empty_surface").when(F.col("_whole").isNotNull(), "exact_source_backed").when(F.size("_tokens") == 0, "unresolved_empty_surface")
              .when(F.size("_tokens") > most_tokens, "unresolved_too_many_tokens").when(F.size(missing) > 0, "unresolved_token").otherwise("bounded_token_composition"))
    ipa = F.when(F.col("_whole").isNotNull(), F.col("_whole")).when(F.size(missing) == 0, F.array_join(F.transform("p", lambda x: x["ipa"]), " "))
    none = F.array().cast("array<string>")
    return out.select(name, status.alias("status"), F.size("_tokens").alias("tokens"), F.coalesce(F.when(F.size("_tokens") > most_tokens, F.col("_tokens")), missing, none).alias("unresolved"), ipa.alias("ipa"))


def limited_channels(queries: DataFrame, targets: DataFrame, query: str, target: str, limits: dict[str, int], order: list, most: int, exclude: str | None = None) -> DataFrame:
    """JN-05: targets by channel with a limit for each, merged by the closest channel, then ``order``, up to ``most`` a query.

    Both sides hold channel and key; a query takes the first rows of a posting, so postings are cut to the largest limit
    (and one for itself, if ``exclude`` names a column that must differ) before the join."""
    ranks = F.create_map(*(x for i, c in enumerate(limits) for x in (F.lit(c), F.lit(i))))
    bound = F.create_map(*(x for c, n in limits.items() for x in (F.lit(c), F.lit(n))))
    known = list(limits)
    cut = targets.where(F.col("channel").isin(*known))
    cut = top_per_group(cut, ["channel", "key"], [*order, F.asc(target)], max(limits.values()) + 1, "_at").where(F.col("_at") <= bound[F.col("channel")] + 1).drop("_at")
    asked = queries.where(F.col("channel").isin(*known)).select(query, "channel", "key", *([F.col(exclude).alias("_not")] if exclude else []))
    hits = asked.join(cut, ["channel", "key"])
    hits = hits.where(~F.col(exclude).eqNullSafe(F.col("_not"))).drop("_not") if exclude else hits
    own = top_per_group(hits, [query, "channel"], [*order, F.asc(target)], max(limits.values()), "_at").where(F.col("_at") <= bound[F.col("channel")])
    rest = [c for c in targets.columns if c not in (target, "channel", "key")]
    merged = own.groupBy(query, target).agg(F.min(ranks[F.col("channel")]).alias("channel_order"), F.array_sort(F.collect_set("channel")).alias("channels"), *(F.first(c).alias(c) for c in rest))
    return top_per_group(merged, [query], [F.asc("channel_order"), *order, F.asc(target)], most)


def entity_postings(names: DataFrame, pronunciation: str, channels: dict) -> DataFrame:
    """JN-08: a row per name's pronunciation and anchor key."""
    return postings(names, pronunciation, channels)


def entity_candidates(queries: DataFrame, anchors: DataFrame, names: DataFrame, query: str, pronunciation: str, order: list, categories: DataFrame | None = None, entity: str = "entity", per_channel: int = 192) -> DataFrame:
    """JN-08: for each query and anchor the most popular names, of the query's categories if it names any: query,
    pronunciation, channels.

    ``queries``: query, channel, key.  ``anchors``: pronunciation, channel, key.  ``categories``: query, category.  Postings are
    cut before the join to what a query can take of them, those of each category apart if queries name categories."""
    ranked = anchors.join(names, pronunciation)
    if categories is None:
        ranked = top_per_group(ranked, ["channel", "key"], order, per_channel, "_at").drop("_at")
        hits = queries.select(query, "channel", "key").join(ranked, ["channel", "key"])
    else:
        ranked = top_per_group(ranked, ["channel", "key", "category"], order, per_channel, "_at").drop("_at")
        asked = queries.select(query, "channel", "key").join(categories.select(query, "category").distinct(), query)
        hits = asked.join(ranked, ["channel", "key", "category"])
        hits = top_per_group(hits, [query, "channel", "key"], order, per_channel, "_at").drop("_at")
    return hits.groupBy(query, pronunciation).agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def hydrated(candidates: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """JN-09: details of the rows that are left after the cut; the candidates are the small side."""
    return details.join(candidates, key)
