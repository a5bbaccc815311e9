"""Availability, eligibility, type and search predicates (FP) as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klangwerk.functions import text as T

from . import positional
from .base import as_col

#: The relation types in the order in which they are listed.
PRIMARY_TYPES = ("multisyllabic_perfect", "perfect", "multisyllabic_slant", "family", "slant")
RELATION_TYPES = ("assonance", "consonance")
TYPES = PRIMARY_TYPES + RELATION_TYPES
#: Review states in which a name's pronunciation may be used.
RUNTIME_REVIEW_STATES = ("accepted", "reviewed", "accepted_source_composition", "accepted_source_backed")


def clamp(value, fallback: int = 20, most: int = 250, least: int = 1) -> int:
    """FP-13: a whole number within bounds; the fallback for anything that is no number."""
    try:
        number = int(float(str(value).strip()))
    except (ValueError, OverflowError):
        return fallback
    return max(least, min(most, number))


def available(mode: str, canonical: Column | str, generated: Column | str) -> Column:
    """FP-01: rows of a mode: core (canonical only), generated (generated only, not canonical) or all."""
    c, g = F.coalesce(as_col(canonical), F.lit(False)), F.coalesce(as_col(generated), F.lit(False))
    return {"core": c, "generated": g & ~c, "all": c | g}[mode]


def preferred(mode: str, canonical: Column | str, canonical_preferred: Column | str, generated_preferred: Column | str) -> Column:
    """FP-02: the preference that holds: the canonical row's where there is one or only such rows count, else the generated row's."""
    c = F.coalesce(as_col(canonical), F.lit(False))
    own, other = (F.coalesce(as_col(x), F.lit(False)) for x in (canonical_preferred, generated_preferred))
    return own if mode == "core" else F.when(c, own).otherwise(other)


def pronunciation_filter(preferred_flag: Column | str, historical: Column | str, flags: Column | str, variants: bool = False, with_historical: bool = False, generated_only: bool = False) -> Column:
    """FP-02: preferred and current pronunciations unless variants or historical ones are asked for; those marked as a second choice alone if so asked."""
    keep = F.lit(True) if variants else F.coalesce(as_col(preferred_flag), F.lit(False))
    keep = keep if with_historical else keep & ~F.coalesce(as_col(historical), F.lit(False))
    return keep & F.coalesce(as_col(flags).contains("secondary_opt_in"), F.lit(False)) if generated_only else keep


def prefix_search(df: DataFrame, normalized: str, query: str, count: list[Column] = (), limit: int = 20) -> DataFrame:
    """FP-03, AG-05: forms that are or begin with the query, one row a form with aggregates over its rows; exact ones first.

    The prefix is a pushed-down filter, so only row groups that can hold it are read."""
    found = df.where(F.col(normalized).startswith(query)).groupBy(normalized).agg(F.count("*").alias("rows"), *count)
    return found.withColumn("exact", F.col(normalized) == query).orderBy(F.desc("exact"), normalized).limit(clamp(limit))


def contains_search(df: DataFrame, surface: str, needle: str, types: str | None = None, kind: str | None = None, evidence: Column | None = None) -> DataFrame:
    """FP-05: surfaces that hold the needle as it is written (wildcards are plain characters), of a type and with evidence."""
    keep = F.col(surface).contains(needle)
    keep = keep & F.array_contains(types, kind) if kind else keep
    return df.where(keep & evidence if evidence is not None else keep)


def name_index(names: DataFrame, key: str, name: str) -> DataFrame:
    """FP-06: the positional index of names: key, place, word, next; it can be kept as a table and asked again."""
    return positional.postings(names, key, F.transform(T.word_tokens(name), F.lower))


def name_search(names: DataFrame, key: str, name: str, queries: DataFrame, query: str, order: list[Column], limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """FP-06: names that hold the query's words side by side, in order of popularity (``order``, total), up to ``limit`` a query.

    The index is asked for keys and places alone; ``order`` columns join what was found, all columns what is left."""
    words = F.transform(T.word_tokens(query), F.lower)
    asked = queries.select(F.col(query).alias("query"), words.alias("_want")).where(F.size("_want") > 0).distinct()
    found = positional.holders(name_index(names, key, name) if index is None else index, key, asked, "query", "_want")
    from .relational import top_per_group

    return top_per_group(found.join(names.hint("merge"), key), ["query"], order, clamp(limit, 20, 100)).select("query", *names.columns, "rank")


def result_types(primary: Column | str, relations: Column | str) -> Column:
    """FP-07: the types of a result in listing order: its primary type and its sound relations, unknown ones left out."""
    p, r = as_col(primary), F.coalesce(as_col(relations), F.array().cast("array<string>"))
    listed = F.array(*map(F.lit, TYPES))
    return F.filter(listed, lambda t: (F.coalesce(p == t, F.lit(False)) & t.isin(*PRIMARY_TYPES)) | (F.array_contains(r, t) & t.isin(*RELATION_TYPES)))


def matches_type(types: Column | str, kind: str) -> Column:
    """FP-07."""
    return F.lit(True) if kind == "all" else F.array_contains(as_col(types), kind)


def writer_rows(rows: DataFrame, types: str, kind: str = "all", syllables: str = "syllables", mode: str = "all", query_syllables: Column | int = 0) -> DataFrame:
    """FP-08: results of a type whose syllables fit the mode."""
    return rows.where(matches_type(types, kind) & T.syllable_filter(mode, syllables, query_syllables))


def admission(decision: Column | str) -> Column:
    """FP-09: rank of a decision: admit before review before reject; unknown ones count as rejected."""
    d = as_col(decision)
    return F.when(d == "admit", 0).when(d == "review", 1).otherwise(2)


def admitted(df: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """FP-09: the decision of each scope: the best of its rows."""
    best = F.min(admission(decision))
    return df.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, ("admit", "review", "reject"))), best + 1).alias("decision"))


def publish_eligibility(analysed: Column, current: Column, historical: Column, proper: Column, common: Column, invalid: Column) -> Column:
    """FP-10: struct of default_eligible and the reasons against it, of an English record's evidence counts."""
    count = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(analysed, F.lit(False)), "no_analyzed_en_us_pronunciation"), F.when((count(current) == 0) & (count(historical) > 0), "historical_only"),
        F.when((count(proper) > 0) & (count(common) == 0), "explicit_proper_name_only"), F.when(F.coalesce(invalid, F.lit(False)), "esdb_invalid_variant")))
    return F.struct((F.size(reasons) == 0).alias("default_eligible"), reasons.alias("exclusion_reasons"))


def compatibility_views(tables: dict[str, DataFrame], projections: dict[str, tuple[str, list[Column | str]]], where: dict[str, Column] | None = None) -> list[str]:
    """FP-12: a temporary view for each projection (name: table, columns), filtered where asked; returns the names."""
    for name, (table, columns) in projections.items():
        df = tables[table] if not where or name not in where else tables[table].where(where[name])
        df.select(*columns).createOrReplaceTempView(name)
    return sorted(projections)


def active_generated(status: Column | str, method: Column | str, tier: Column | str) -> Column:
    """FP-14: whether a generated row serves: resolved by the generator with quality A or B."""
    return F.coalesce((as_col(status) == "resolved") & (as_col(method) == "espeak_ng") & as_col(tier).isin("A", "B"), F.lit(False))


def deferred_bucket(status: Column | str, method: Column | str, tier: Column | str) -> Column:
    """FP-14: why a row does not serve yet; null for rows of the generator."""
    s, m, t = as_col(status), as_col(method), as_col(tier)
    return (F.when((s == "unresolved") | (t == "U"), "U_unresolved").when(m == "espeak_ng", None).when(t == "B", "client_B_source_backed")
            .when(t == "C", "client_C_rules").when(t == "D", "client_D_grapheme").otherwise("other_non_espeak"))


def dependency_bucket(found: Column, decision: Column | str, status: Column | str, method: Column | str, tier: Column | str) -> Column:
    """FP-14: state of a phrase's token that has no pronunciation."""
    d = as_col(decision)
    return (F.when(~found, "missing_backfill_dependency").when(F.coalesce(d == "admit", F.lit(False)) & active_generated(status, method, tier), "active_espeak_ab_token_missing_from_writer")
            .when(~F.coalesce(d == "admit", F.lit(False)), F.concat(F.lit("admission_"), F.coalesce(d, F.lit("unknown")))).otherwise(F.coalesce(deferred_bucket(status, method, tier), F.lit("non_active_token"))))


def entity_runtime_eligible(locale: Column | str, review_state: Column | str, language: str = "de") -> Column:
    """FP-15: whether a name's pronunciation may be used in a language."""
    return F.coalesce((as_col(locale) == ("en-US" if language == "en" else "de-DE")) & as_col(review_state).isin(*RUNTIME_REVIEW_STATES), F.lit(False))


def quality_tier(high: Column, good: Column, fair: Column) -> Column:
    """FP-16: A, B, C by the first condition that holds, else D."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(high), "A").when(no(good), "B").when(no(fair), "C").otherwise("D")
