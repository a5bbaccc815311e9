"""Surface checks, normalisation of generated pronunciations and rhythm metrics (SF-12/13/32, PH-25/31/32/36/38, SQ-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klangwerk.operators.base import as_col

from . import text as T
from .profiles import PROFILES

#: Symbols of a generator that the inventories write otherwise, in the order of replacement.
GENERATED_SYMBOLS = {
    "en": (("ɫ", "l"), ("ɾ", "t"), ("ᵻ", "ɪ"), ("ᵊ", "ə"), ("ɡ", "g"), ("əː", "ɜ"), ("ɹ̩", "ɚ"), ("oː", "oʊ"), ("eː", "eɪ"), ("ɛː", "ɛ"), ("ɪː", "i"), ("ʊː", "u")),
    "de": (("ɡ", "g"), ("ɾ", "r"), ("ɫ", "l"), ("ᵊ", "ə"), ("ɑː", "aː"), ("ɒː", "aː"), ("ɜː", "ɐ"), ("ɜ", "ɐ")),
}
#: Artifacts of dictionary displays, first that matches.
ARTIFACTS = (("wiktionary_numbered_display", r"^\[\d+\]\s*"), ("ellipsis_placeholder", r"\.\.\.|…"), ("markup_fragment", r"\{\{|\}\}|<[^>]+>"), ("pronoun_template", r"(?i)\b(?:er|sie|es)(?:/(?:er|sie|es)){1,2}\b"))
#: Numerals of names and their words.
ROMAN = {
    "i": "one", "ii": "two", "iii": "three", "iv": "four", "v": "five", "vi": "six", "vii": "seven", "viii": "eight", "ix": "nine", "x": "ten",
    "xi": "eleven", "xii": "twelve", "xiii": "thirteen", "xiv": "fourteen", "xv": "fifteen", "xvi": "sixteen", "xvii": "seventeen", "xviii": "eighteen", "xix": "nineteen", "xx": "twenty",
}
CARDINALS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten",
    "11": "eleven", "12": "twelve", "13": "thirteen", "14": "fourteen", "15": "fifteen", "16": "sixteen", "17": "seventeen", "18": "eighteen", "19": "nineteen", "20": "twenty",
}


def generated_ipa(ipa: Column | str, language: str) -> Column:
    """PH-32: marks and pauses to spaces, symbols to the inventory's."""
    s = F.regexp_replace(as_col(ipa), r"\p{Cf}", "")
    s = F.trim(F.regexp_replace(s, r"[\r\n‖|_\s]+", " "))
    for symbol, put in GENERATED_SYMBOLS[language]:
        s = F.replace(s, F.lit(symbol), F.lit(put))
    return s


def identity_key(analysis: Column | str) -> Column:
    """PH-31: phonemes and stress; pronunciations with the same key are one."""
    a = as_col(analysis)
    return F.concat_ws("|", F.array_join(a["phonemes"], " "), a["stress_pattern"])


def rendered_ipa(analysis: Column | str) -> Column:
    """PH-38: syllables with stress marks, parted by dots."""
    syllable = lambda s: F.concat(F.when(s["stress"] == 2, "ˈ").when(s["stress"] == 1, "ˌ").otherwise(""), F.array_join(s["onset"], ""), s["nucleus"], F.array_join(s["coda"], ""))
    return F.array_join(F.transform(as_col(analysis)["syllables"], syllable), ".")


def right_edge_keys(analysis: Column | str) -> Column:
    """PH-25: vowel keys from each later stressed syllable: of two nuclei and more, and with the one before of three and more.

    Longest first, each key once."""
    a = as_col(analysis)
    nuclei, n = F.transform(a["syllables"], lambda s: s["nucleus"]), F.size(a["syllables"])
    later = F.filter(F.transform(a["syllables"], lambda s, i: F.when((s["stress"] > 0) & (i >= a["primary_stress"]), i)), lambda i: i.isNotNull())
    own = F.transform(later, lambda i: F.struct((n - i).alias("size"), i.alias("at"), F.array_join(F.slice(nuclei, i + 1, n), "-").alias("key"), F.lit(2).alias("least")))
    wider = F.transform(later, lambda i: F.struct((n - i + 1).alias("size"), i.alias("at"), F.array_join(F.slice(nuclei, i, n), "-").alias("key"), F.lit(3).alias("least")))
    fits = F.filter(F.concat(own, wider), lambda k: k["size"] >= k["least"])
    return F.array_distinct(F.transform(F.array_sort(fits, lambda x, y: F.when(x["size"] != y["size"], y["size"] - x["size"]).otherwise(x["at"] - y["at"])), lambda k: k["key"]))


def entity_anchors(analysis: Column | str) -> Column:
    """SQ-04: array<struct<channel, key>> by which an entity name is found; empty keys are left out."""
    a = as_col(analysis)
    nucleus = F.element_at(a["syllables"], -1)["nucleus"]
    entry = lambda c, k: F.struct(F.lit(c).alias("channel"), k.alias("key"))
    fixed = F.array(entry("exact_tail", a["exact_key"]), entry("vowel_sequence", a["vowel_key"]), entry("vowel_family", a["vowel_family"]), entry("final_nucleus_coda", F.concat_ws("|", nucleus, a["coda_class"])), entry("final_nucleus", nucleus))
    edges = F.transform(right_edge_keys(a), lambda k: F.struct(F.lit("right_edge").alias("channel"), k.alias("key")))
    return F.array_distinct(F.filter(F.concat(fixed, edges), lambda e: F.coalesce(e["key"], F.lit("")) != ""))


def artifact(surface: Column | str) -> Column:
    """SF-12: which artifact of a dictionary display a surface is; null for a plain one."""
    s = F.trim(F.coalesce(as_col(surface), F.lit("")))
    out = F.when(s == "", "empty_surface")
    for name, pattern in ARTIFACTS:
        out = out.when(s.rlike(pattern), name)
    return out


def safety(surface: Column | str, historical: Column) -> Column:
    """SF-13: struct of class (safe, marked, restricted) and sorted reasons."""
    s = F.coalesce(as_col(surface), F.lit(""))
    single = F.size(F.filter(T.word_tokens(s), lambda t: t.rlike(r"^\p{L}$")))
    marks, dense = F.length(F.regexp_replace(s, r"[\p{L}\p{N}\s'’\-]", "")), F.length(F.regexp_replace(s, r"\s", ""))
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(historical, F.lit("historical_only")), F.when(s.rlike(r"\p{N}"), F.lit("digit_bearing")), F.when(s.rlike(r"(?:\p{L}\.(?:[-–—]?)){2,}"), F.lit("dotted_single_letter_sequence")),
        F.when(single >= 2, F.lit("multiple_single_letter_tokens")), F.when((marks >= 2) & (dense > 0) & (marks >= dense * 0.15), F.lit("punctuation_heavy")))))
    return F.struct(F.when(historical, "restricted").when(F.size(reasons) > 0, "marked").otherwise("safe").alias("class"), reasons.alias("reasons"))


def lookup_units(surface: Column | str) -> Column:
    """PH-36: words under which the parts of an entity name are looked up: roman and small numbers spelled out, hyphens split."""
    s = F.regexp_replace(F.regexp_replace(F.trim(as_col(surface)), "&", " and "), "[/:+]", " ")
    pieces = F.filter(F.transform(F.split(s, r"\s+"), lambda p: F.regexp_replace(F.lower(p), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda p: p != "")
    spelled = F.create_map(*(x for k, v in (ROMAN | CARDINALS).items() for x in (F.lit(k), F.lit(v))))
    return F.flatten(F.transform(pieces, lambda p: F.when(spelled[p].isNotNull(), F.array(spelled[p])).otherwise(F.filter(F.split(p, "[‐‑‒–—-]+"), lambda x: x != ""))))


def step_ms(bpm: Column, grid: Column, step: Column, triplet: Column, scale: Column) -> Column:
    """SF-32: duration of a step: quarter over its subdivisions; in triplet feel long and short steps take turns."""
    base = 60000.0 / bpm / (grid / 4.0) / scale
    return F.when(~triplet, base).when(step % 2 == 0, base * 4 / 3).otherwise(base * 2 / 3)


def syllables_per_second(syllables: Column, duration_ms: Column) -> Column:
    """SF-32: 0 where nothing lasts."""
    return F.when(duration_ms > 0, F.greatest(syllables, F.lit(0)) / (duration_ms / 1000.0)).otherwise(0.0)


def known_symbols(language: str) -> list[str]:
    """PH-39: what an external pronunciation may hold."""
    p = PROFILES[language]
    return sorted({*p.nuclei, *p.consonants})
