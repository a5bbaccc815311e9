"""The English order of results: quality utility, near-tie bands and diversity inside them (RK-09, RK-10, WN-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T

from .ranking import near_tie_bands
from .relational import top_per_group

#: Weights of the guarded-commonness quality, the band and the weight of redundancy.
PHONETIC, SYLLABLE, COMMONNESS, UNKNOWN = 0.80, 0.14, 0.06, 0.015
BAND, DIVERSITY = 0.03, 0.08


def quality(rows: DataFrame) -> DataFrame:
    """RK-09: adds commonness, usage_known and utility.  Columns phonetic, syllable (0..1), zipf, usage_rank."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))))
    known = F.col("zipf").isNotNull() | F.coalesce(F.col("usage_rank") > 0, F.lit(False))
    out = rows.withColumn("commonness", T.usage_utility("zipf", "usage_rank")).withColumn("usage_known", known)
    return out.withColumn("utility", F.round(PHONETIC * unit("phonetic") + SYLLABLE * unit("syllable") + COMMONNESS * F.col("commonness") - F.when(F.col("usage_known"), 0.0).otherwise(UNKNOWN), 8))


def banded(rows: DataFrame, query: str, limit: int = 250) -> DataFrame:
    """RK-09: rows numbered by tier, near-tie band of the phonetic score, utility, score, known usage, usage, id and form.

    Bands are walked per query and tier, over the first ``limit`` rows of a tier by score (what a page can show)."""
    cut = top_per_group(rows, [query, "tier"], [F.desc("phonetic"), F.asc("id"), F.asc("form")], limit, "_at").drop("_at")
    bands = near_tie_bands(cut, [query, "tier"], "phonetic", ["id", "form"], BAND + 1e-12)
    order = [F.asc("tier"), F.asc("band"), F.desc("utility"), F.desc("phonetic"), F.desc("usage_known"), F.asc_nulls_last("usage_rank"), F.asc("id"), F.asc("form")]
    return top_per_group(bands, [query], order, limit)


def redundancy(a: dict, b: dict) -> float:
    """RK-10: 1 for one form, .95 for a shared lemma, else the overlap of bigrams or .9 of the shared beginning."""
    x, y = a["form"], b["form"]
    if x == y:
        return 1.0
    if set(a["lemmas"]) & set(b["lemmas"]):
        return 0.95
    if not x or not y:
        return 0.0
    p, q = ({s[i : i + 2] for i in range(max(1, len(s) - 1))} for s in (x, y))
    shared = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    return min(1.0, max(2 * len(p & q) / (len(p) + len(q)), 0.9 * shared / max(len(x), len(y))))


def diversified(rows: DataFrame, query: str, limit: int = 20, weight: float = DIVERSITY) -> DataFrame:
    """RK-10: the first rows, inside each tier and band by utility less ``weight`` times the redundancy to those chosen before.

    Sequential by definition, per query, on the rows that `banded` numbered; ``lemmas`` is an array."""
    from pyspark.sql.types import DoubleType, LongType, StructType

    schema = StructType([*rows.schema.fields]).add("max_redundancy", DoubleType()).add("position", LongType())

    def choose(pdf):
        left = pdf.sort_values("rank").reset_index(drop=True)
        own = [{"form": f, "lemmas": [] if m is None else [str(x).lower() for x in m], "group": (t, b), "utility": u} for f, m, t, b, u in zip(left["form"], left["lemmas"], left["tier"], left["band"], left["utility"])]
        near, open_, chosen, kept = [0.0] * len(own), list(range(len(own))), [], []
        while open_ and len(chosen) < limit:
            group = [i for i in open_ if own[i]["group"] == own[open_[0]]["group"]]
            best = max(group, key=lambda i: (own[i]["utility"] - weight * near[i], -i))
            open_.remove(best)
            chosen.append(best)
            kept.append(round(near[best], 6))
            for i in open_:
                near[i] = max(near[i], redundancy(own[i], own[best]))
        return left.loc[chosen].assign(max_redundancy=kept, position=range(1, len(chosen) + 1))

    return rows.groupBy(query).applyInPandas(choose, schema)
