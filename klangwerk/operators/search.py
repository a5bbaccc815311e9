"""Batch search: many query words against a lexicon in one plan (JN-01/02, PH-20..26, AG-01, RK-01/05/06/07/09/10, SC-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P
from klangwerk.functions import text as T

from . import lexicon as L
from . import ranking as R
from . import relational as O
from .grouped import by_group

#: Tiers of primary classes and sound relations.
TIERS = {"multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3, "assonance": 4, "consonance": 5}
#: Most targets of one query and channel that are scored; the retrieval's own bounded lookup.
CHANNEL_LIMIT = 128
POOL = 250


def candidates(queries: DataFrame, targets: DataFrame, per_channel: int = CHANNEL_LIMIT) -> DataFrame:
    """JN-01/02: targets that share a key with a query: per channel the nearest in syllables, then the most used.

    Both sides are channel tables.  Each posting is cut to the most used forms of every syllable count before the join, as
    many as any query can take of them (one more: itself), so a key of half the lexicon makes no more rows than others;
    Spark keeps only that many rows of a group before the shuffle (WindowGroupLimit)."""
    q = queries.select("language", F.col("form").alias("query"), F.col("ipa").alias("query_ipa"), F.col("syllables").alias("query_syllables"), F.col("usage_rank").alias("query_rank"), "channel", "channel_order", "key")
    used = [F.asc_nulls_last("usage_rank"), F.asc("form")]
    t = O.top_per_group(targets.select("form", "ipa", "syllables", "usage_rank", "channel", "key"), ["channel", "key", "syllables"], used, per_channel + 1).drop("rank")
    hits = q.join(t, ["channel", "key"]).where("query != form")
    order = [F.abs(F.col("syllables") - F.col("query_syllables")), F.asc("syllables"), *used]
    bounded = O.top_per_group(hits, ["language", "query", "channel"], order, per_channel)
    return bounded.groupBy("language", "query", "form").agg(
        F.first("query_ipa").alias("query_ipa"), F.first("query_syllables").alias("query_syllables"), F.first("query_rank").alias("query_rank"), F.first("ipa").alias("ipa"),
        F.first("syllables").alias("syllables"), F.first("usage_rank").alias("usage_rank"), F.min("channel_order").alias("channel_order"))


def scored(cands: DataFrame) -> DataFrame:
    """Adds the pair score, its types and its tier; pairs that are weak and have no sound relation are dropped."""
    s = cands.withColumn("s", P.pair_score(F.col("query_ipa"), F.col("ipa"), F.col("language")))
    types = F.array_compact(F.array(F.when(F.col("s.type") != "weak", F.col("s.type")), F.when(F.col("s.assonance").isNotNull(), F.lit("assonance")), F.when(F.col("s.consonance_relation").isNotNull(), F.lit("consonance"))))
    tier = F.create_map(*(x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v))))
    return s.withColumn("types", types).where(F.size("types") > 0).withColumn("tier", F.array_min(F.transform("types", lambda t: tier[t]))).withColumn("score", F.round("s.overall", 4))


def ranked(rows: DataFrame, order: str = "usage", limit: int = POOL) -> DataFrame:
    """RK-01 (usage), RK-05 (sound): numbered results of each query."""
    delta = F.abs(F.col("syllables") - F.col("query_syllables"))
    orders = {"usage": [F.asc("tier"), delta, F.asc_nulls_last("usage_rank"), F.desc("score"), F.asc("form")], "sound": [F.asc("tier"), F.desc("score"), delta, F.asc("form")]}
    return O.top_per_group(rows, ["language", "query"], orders[order], limit)


SCORED = "types array<string>, tier int, score double, rank long, n_candidates int, n_scored int"


def best_scored(cands: DataFrame, order: str = "usage", limit: int = POOL) -> DataFrame:
    """The rows of ``ranked(scored(..))``, scored only as far as needed (PH-23): candidates are taken by the best rank that
    their bounds allow, and a query is done when no other can reach its ``limit`` best.

    ``cands`` has the sounds of both sides (`index.lookup`), at most CHANNEL_LIMIT a channel for each query.  n_candidates and
    n_scored tell what the bounds have saved."""
    from decimal import ROUND_HALF_UP, Decimal
    from heapq import heappush, heapreplace

    fields = [f for f in cands.schema.fields if not f.name.endswith("sound")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", " + SCORED
    kept = [cands.columns.index(f.name) for f in fields]
    at_language, at_asked, at_own, at_form, at_sound, at_syllables, at_used = (cands.columns.index(c) for c in ("language", "query_syllables", "query_sound", "form", "sound", "syllables", "usage_rank"))

    def rounded(x: float) -> float:  # as F.round does
        return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))

    class Late:
        """A key in reverse, so that the smallest of the heap is the last of the kept rows."""

        def __init__(self, key):
            self.key = key

        def __lt__(self, other):
            return self.key > other.key

    def run(group):
        rows, heard = list(group), {}

        def vectors(sound):
            if sound not in heard:
                heard[sound] = P.anchored_vectors(P.hear_sound(sound))
            return heard[sound]

        language, waiting = rows[0][at_language], []
        own = vectors(rows[0][at_own])
        asked = int(rows[0][at_asked])
        rhymes, scores = {}, {}
        for i, r in enumerate(rows):
            form, sound, used = r[at_form], r[at_sound], r[at_used]
            # forms with the same sounds from the rhyme on have the same bounds and scores
            rhyme = P.rhyme_of(sound)
            if rhyme not in rhymes:
                other = vectors(sound)
                bound = P.possible_anchored(own, other, language)
                rhymes[rhyme] = bound and (bound[0], rounded(bound[1]), other)
            bound = rhymes[rhyme]
            if bound:
                delta = abs(int(r[at_syllables]) - asked)
                rest = (delta, (1, 0) if used is None else (0, int(used)))
                at = (lambda tier, score, d=rest[0], u=rest[1], f=form: (tier, d, u, -score, f)) if order == "usage" else (lambda tier, score, d=rest[0], f=form: (tier, -score, d, f))
                waiting.append((at(bound[0], bound[1]), i, rhyme, at))
        best, n_scored = [], 0
        for earliest, i, rhyme, at in sorted(waiting, key=lambda w: w[:2]):
            if len(best) == limit and earliest > best[0].key:
                break
            n_scored += 1
            if rhyme not in scores:
                s = P.score_prepared(own, rhymes[rhyme][2], language)
                types = [t for t in (s["type"] if s["type"] != "weak" else None, s["assonance"] and "assonance", s["consonance_relation"] and "consonance") if t]
                scores[rhyme] = types and (types, min(TIERS[t] for t in types), rounded(s["overall"]))
            if scores[rhyme]:
                types, tier, score = scores[rhyme]
                row = Late(at(tier, score))
                row.out = (i, types, tier, score)
                if len(best) < limit:
                    heappush(best, row)
                elif row.key < best[0].key:
                    heapreplace(best, row)
        for rank, (i, types, tier, score) in enumerate((r.out for r in sorted(best, key=lambda r: r.key)), 1):
            yield (*(rows[i][k] for k in kept), types, tier, score, rank, len(rows), n_scored)

    return by_group(cands, ["language", "query"], run, schema)


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _same(a: str, b: str, rows: DataFrame) -> Column:
    """Whether two columns hold the same non-empty name; never where the rows lack them."""
    if a not in rows.columns or b not in rows.columns:
        return F.lit(False)
    return F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))


def lexical_overlap(rows: DataFrame, query: str = "query", form: str = "form") -> DataFrame:
    """RK-06: adds overlap, how much of the query's own wording a form repeats, from lemma, family and spelling.

    Edit distance alone is no evidence, since short rhymes share most letters.  Columns query_lemma, lemma, query_family and
    family count where the rows have them."""
    shorter = F.greatest(F.lit(1), F.least(F.length(query), F.length(form)))
    prefix, suffix, alike = T.common_prefix_length(query, form), T.common_suffix_length(query, form), T.edit_similarity(query, form)
    lemma, family = _same("query_lemma", "lemma", rows), _same("query_family", "family", rows)
    overlap = F.greatest(F.when(lemma, 1.0).otherwise(0.0), F.when(family, 0.92).otherwise(0.0),
                         F.when((prefix >= 6) & (prefix / shorter >= 0.45), _unit(0.50 + 0.45 * prefix / shorter)).otherwise(0.0),
                         F.when((shorter >= 8) & (alike >= 0.88), alike * 0.90).otherwise(0.0), F.when(suffix >= 7, suffix / shorter * 0.45).otherwise(0.0))
    cheap = F.when(lemma, 3).when(family | (overlap >= 0.85), 2).when(overlap >= 0.65, 1).otherwise(0)
    return rows.withColumn("overlap", F.round(_unit(overlap), 4)).withColumn("cheap_tiers", cheap)


def commonness_utility(rank: Column, query_rank: Column) -> Column:
    """RK-06: 1 down to the query's own rank, .15 less for the first power of ten, .30 for each further one; .25 unranked."""
    delta = F.log10(rank / query_rank)
    known = F.when(delta <= 0, 1.0).when(delta <= 1, 1 - 0.15 * delta).otherwise(_unit(0.85 - 0.30 * (delta - 1)))
    return F.when(rank.isNull() | (rank <= 0), 0.25).when(query_rank.isNull() | (query_rank <= 0), _unit(1 - F.log10(F.greatest(rank, F.lit(1))) / 7)).otherwise(known)


def utility(rows: DataFrame) -> DataFrame:
    """RK-06: .72 score + .16 syllables + .12 commonness - .16 overlap with the query - .08 for rare or historical forms.

    writer_tier adds to the tier what cheap rhymes (the query's lemma, family or wording) lose.  A boolean column ``rare``
    counts where the rows have it."""
    near = 1.0 / (1.0 + F.abs(F.col("syllables") - F.col("query_syllables")))
    rare = F.when(F.coalesce(F.col("rare"), F.lit(False)), 0.08).otherwise(0.0) if "rare" in rows.columns else F.lit(0.0)
    sound = 0.72 * _unit(F.col("score")) + 0.16 * near + 0.12 * commonness_utility(F.col("usage_rank"), F.col("query_rank"))
    return lexical_overlap(rows).withColumn("utility", F.round(_unit(sound - 0.16 * F.col("overlap") - rare), 4)).withColumn("writer_tier", F.col("tier") + F.col("cheap_tiers"))


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def redundancy(a: str, b: str, lemmas: tuple = (None, None), families: tuple = (None, None)) -> float:
    """RK-08: 1 for one form or lemma, .92 for one family; else by a shared beginning of six letters, or spelling at least .84 alike."""
    if not a or not b:
        return 0.0
    if a == b or lemmas[0] and lemmas[0] == lemmas[1]:
        return 1.0
    if families[0] and families[0] == families[1]:
        return 0.92
    shared, shorter, longer = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))), min(len(a), len(b)), max(len(a), len(b))
    start = min(1.0, 0.50 + 0.45 * shared / shorter) if shared >= 6 and shared / shorter >= 0.45 else 0.0
    if shorter / longer < max(start, 0.84):  # no spelling so different in length can be more alike
        return round(start, 4)
    alike = 1 - _levenshtein(a, b) / longer
    return round(max(start, alike if alike >= 0.84 else 0.0), 4)


def diversified(rows: DataFrame, limit: int = 50, weight: float = 0.18) -> DataFrame:
    """RK-07: greedy choice by writer tier, then utility less ``weight`` times the redundancy to what is already chosen.

    Sequential by definition, so it runs per query, on at most POOL rows each.  ``weight`` must not be negative."""
    from heapq import heapify, heappop, heapreplace

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*rows.schema.fields]).add("position", LongType())

    at = {c: i for i, c in enumerate(rows.columns)}

    def choose(group):
        left = sorted(group, key=lambda r: (r[at["writer_tier"]], r[at["rank"]]))
        own = [(r[at["form"]], r[at["lemma"]] if "lemma" in at else None, r[at["family"]] if "family" in at else None) for r in left]
        nearest, met, chosen = [0.0] * len(left), [0] * len(left), []

        def key(i):
            # a near copy of a chosen word counts as of a worse tier
            return (left[i][at["writer_tier"]] + (2 if nearest[i] >= 0.88 else 1 if nearest[i] >= 0.58 else 0), weight * nearest[i] - left[i][at["utility"]], i)

        waiting = [key(i) for i in range(len(left))]
        heapify(waiting)
        while waiting and len(chosen) < limit:
            # keys only grow as words are chosen, so a word is compared with these only when it is the first of all
            i = waiting[0][2]
            if met[i] < len(chosen):
                for best in chosen[met[i]:]:
                    (form, lemma, family), (a, b, c) = own[i], own[best]
                    nearest[i] = max(nearest[i], redundancy(form, a, (lemma, b), (family, c)))
                met[i] = len(chosen)
                heapreplace(waiting, key(i))
            else:
                heappop(waiting)
                chosen.append(i)
                yield (*left[i], len(chosen))

    return by_group(rows, ["language", "query"], choose, schema)


def search(queries: DataFrame, lexicon_rows: DataFrame, limit: int = 50, order: str = "usage") -> DataFrame:
    """language, query, form, tier, types, score, utility, position: rhymes of every query word in its language.

    ``queries``: language, form (and usage_rank).  ``lexicon_rows``: as `lexicon.lexicon` gives them."""
    targets = L.channels(L.pronounce(lexicon_rows))
    asked = queries if "usage_rank" in queries.columns else queries.withColumn("usage_rank", F.lit(None).cast("long"))
    found = scored(candidates(L.channels(L.pronounce(asked)), targets))
    best = diversified(utility(ranked(found, order)), limit)
    return best.select("language", "query", "form", "tier", "types", "score", "utility", "position")
