"""String, array and score functions as column expressions (SF, PH-33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from klangwerk.operators.base import as_col

#: Words of letters and digits, hyphens and apostrophes inside; possessive, since no shorter match can be one.
WORD = r"[\p{L}\p{N}]++(?:[-'’][\p{L}\p{N}]++)*+"


def word_tokens(text: Column | str) -> Column:
    """SF-02: words of a text."""
    return F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(WORD), F.lit(0))


def normalize_surface(text: Column | str) -> Column:
    """SF-01: trimmed, white space runs to one space, apostrophes unified, lower case.  NFKC is `functions.unicode.nfkc`."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(as_col(text), "[‘’ʼ´`]", "'"), r"\s+", " ")))


def rhyme_proxy(word: Column | str) -> Column:
    """PH-33: a word from its last vowel group on, else its last three letters."""
    low = F.lower(as_col(word))
    tail = F.regexp_extract(low, "[aeiouyäöü]+[^aeiouyäöü]*$", 0)
    return F.when(tail != "", tail).otherwise(F.right(low, F.lit(3)))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """SF-06: 1 - Levenshtein distance / longer length; 1 for two empty strings."""
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    """SF-07."""
    a, b = as_col(a), as_col(b)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    return F.size(F.filter(places, lambda i: (F.left(a, i) == F.left(b, i)) & (i <= F.length(a)) & (i <= F.length(b))))


def common_suffix_length(a: Column | str, b: Column | str) -> Column:
    """SF-07."""
    return common_prefix_length(F.reverse(as_col(a)), F.reverse(as_col(b)))


def character_bigrams(text: Column | str) -> Column:
    """Distinct neighbouring character pairs; the text itself below two characters."""
    t = as_col(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 1)), lambda i: F.substring(t, i, F.lit(2)))
    return F.array_distinct(pairs)


def bigram_dice(a: Column | str, b: Column | str) -> Column:
    """SF-08: 2 |A & B| / (|A| + |B|) over distinct character bigrams."""
    x, y = character_bigrams(a), character_bigrams(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """SF-09: of two arrays as sets; 0 if both are empty."""
    a, b = as_col(a), as_col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_overlap(query: Column | str, candidate: Column | str) -> Column:
    """SF-10: share of the candidate's distinct tokens that the query holds."""
    q, c = F.array_distinct(as_col(query)), F.array_distinct(as_col(candidate))
    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, c)) / F.size(c))


def token_shape(token: Column | str) -> Column:
    """SF-04: upper, title, lower or fixed."""
    t = as_col(token)
    has = F.lower(t) != F.upper(t)
    return (F.when(~has, "fixed").when((F.upper(t) == t) & (F.length(t) > 1), "upper")
            .when((F.left(t, F.lit(1)) == F.upper(F.left(t, F.lit(1)))) & (F.substring(t, 2, 1 << 20) == F.lower(F.substring(t, 2, 1 << 20))), "title")
            .when(F.lower(t) == t, "lower").otherwise("fixed"))


def surface_class(surface: Column | str, tokens: Column | int = 1) -> Column:
    """SF-11: shape of a surface, first rule that holds: letters of other scripts, other punctuation, digits among letters,
    digits, several words, hyphens or apostrophes inside, one character, nothing lexical, a plain word."""
    s = F.trim(as_col(surface))
    count = tokens if isinstance(tokens, Column) else F.lit(tokens)
    letters, digits = s.rlike(r"\p{L}"), s.rlike(r"\p{N}")
    return (F.when(s.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), "non_latin_letters").when(s.rlike(r"[^\p{L}\p{M}\p{N}\s'’\-‐‑‒–—]"), "other_punctuation").when(digits & letters, "mixed_alnum").when(digits, "numeric")
            .when((count > 1) | s.rlike(r"\s"), "multiword").when(s.rlike(r"[-‐‑‒–—'’]"), "joined_lexeme").when(F.length(s) <= 1, "single_character").when(~letters, "nonlexical").otherwise("clean_single"))


def length_bucket(surface: Column | str) -> Column:
    """SF-11: bucket of a surface's length."""
    n = F.length(F.trim(as_col(surface)))
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").when(n <= 31, "16-31").otherwise("32+")


def score_band(score: Column | str, width: float = 0.05) -> Column:
    """SF-17: floor((score + 1e-9) / width)."""
    return F.floor((as_col(score) + 1e-9) / width).cast("long")


def deficit_band(score: Column | str, width: float = 0.02) -> Column:
    """SF-17: floor((1 - score + 1e-9) / width)."""
    return F.floor((1.0 - as_col(score) + 1e-9) / width).cast("long")


def commonness(rank: Column | str, query_rank: Column | str) -> Column:
    """SF-18: 1 for a word as common as the query, less by each power of ten it is rarer, within 0..1; 0 without a rank."""
    delta = F.log10(F.greatest(as_col(rank), F.lit(1.0))) - F.log10(F.greatest(F.coalesce(as_col(query_rank), F.lit(1.0)), F.lit(1.0)))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), delta) / 3.0)), F.lit(0.0))


def zipf_utility(zipf: Column | str) -> Column:
    """SF-18: (zipf - 1.5) / 5 within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (as_col(zipf) - 1.5) / 5.0))


def usage_utility(zipf: Column | str, rank: Column | str) -> Column:
    """SF-18: by Zipf frequency; without one by rank, 1 - (log10(rank + 9) - 1) / 5.5; .25 without either; within 0..1."""
    r = as_col(rank)
    by_rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.log10(r + 9) - 1) / 5.5))
    return F.when(as_col(zipf).isNotNull(), zipf_utility(zipf)).when(r > 0, by_rank).otherwise(0.25)


def log_scaled(count: Column | str, most: Column | float) -> Column:
    """SF-18: log1p(count) / log1p(most) within 0..1."""
    top = most if isinstance(most, Column) else F.lit(float(most))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(as_col(count)) / F.log1p(top)))


#: Weights of the popularity blend.
POPULARITY_WEIGHTS = {"qrank": 0.60, "sitelinks": 0.15, "bilingual": 0.10, "external": 0.10, "statements": 0.05}


def popularity(**signals: Column) -> Column:
    """SF-19: weighted sum of signals between 0 and 1, missing ones 0, to six decimals."""
    total = F.lit(0.0)
    for name, weight in POPULARITY_WEIGHTS.items():
        total = total + weight * F.coalesce(signals[name], F.lit(0.0))
    return F.round(total, 6)


#: Syllable filter modes and the differences they allow.
SYLLABLE_MODES = {"same": 0, "near": 1, "near1": 1, "near2": 2, "near3": 3}


def syllable_filter(mode: str, syllables: Column | str, query_syllables: Column | int) -> Column:
    """SF-21: all, same, near.., or an exact count where 3 means three and more."""
    s = as_col(syllables)
    if mode == "all":
        return F.lit(True)
    if mode in SYLLABLE_MODES:
        return F.abs(s - query_syllables) <= SYLLABLE_MODES[mode]
    return s >= 3 if mode == "3" else s == int(mode)


def sequence_hash(tokens: Column | str) -> Column:
    """SF-22: digest of a token sequence."""
    return F.sha2(F.array_join(as_col(tokens), "\u0001").cast("binary"), 256)


def stable_score(seed: str, key: Column | str) -> Column:
    """SF-23: a digest that orders keys the same way in every run."""
    return F.sha2(F.concat(F.lit(seed + "\u0000"), as_col(key).cast("string")).cast("binary"), 256)


def end_word(line: Column | str) -> Column:
    """SF-15: last word of a line, lower case."""
    # tried where a run of letters begins and nowhere inside it
    return F.lower(F.regexp_extract(as_col(line), rf"(?<![\p{{L}}\p{{N}}])({WORD})[^\p{{L}}\p{{N}}]*+$", 1))


def scheme_label(index: Column | str) -> Column:
    """SF-16: 0 to A, 25 to Z, 26 to AA."""
    i = as_col(index).cast("int")
    letter = lambda n: F.char(n + 65)
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor((i - 26) / 26).cast("int")), letter(i % 26))).otherwise(
        F.concat(letter(F.floor((i - 702) / 676).cast("int")), letter((F.floor((i - 702) / 26) % 26).cast("int")), letter(i % 26)))


#: Penalties of pronunciation markers.
EVIDENCE_PENALTIES = {"context": 30, "colloquial": 40, "regional": 80, "connected": 1000}


def evidence_penalty(tags: Column | str) -> Column:
    """SF-27: sum of the penalties of an array of markers."""
    return sum((F.when(F.array_contains(as_col(tags), k), v).otherwise(0) for k, v in EVIDENCE_PENALTIES.items()), F.lit(0))


def split_candidates(word: Column | str, least: int = 3) -> Column:
    """SF-30: array<struct<left, right>> of all splits with parts of at least ``least`` letters."""
    w = as_col(word)
    places = F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(w) - least)), lambda i: i <= F.length(w) - least)
    return F.transform(places, lambda i: F.struct(F.left(w, i).alias("left"), F.substring(w, i + 1, F.length(w)).alias("right")))


#: Linking elements between the parts of a compound.
LINKERS = ("", "es", "en", "er", "s", "n", "e")


def left_variants(left: Column | str) -> Column:
    """SF-30: the left part without each linking element it ends with, and with a final e restored."""
    s = as_col(left)
    cut = [F.when(s.endswith(x) & (F.length(s) >= len(x) + 3), F.left(s, F.length(s) - len(x))) for x in LINKERS if x]
    return F.array_distinct(F.array_compact(F.array(s, *cut, F.concat(s, F.lit("e")))))


def suffix_keys(key: Column | str) -> Column:
    """SQ-09: suffixes of a hyphenated vowel key that hold a hyphen inside, the whole key first."""
    # bound once, as in `ngrams`; where the last hyphen stands tells which suffixes hold one
    places = lambda k: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(k) - F.instr(F.reverse(k), "-") + 1))
    each = F.transform(F.array(as_col(key)), lambda k: F.when(k.contains("-"), F.filter(F.transform(places(k), lambda i: F.substring(k, i, F.length(k))), lambda s: ~s.startswith("-"))).when(k.isNotNull(), F.array().cast("array<string>")))
    return F.get(each, F.lit(0))


def ngrams(tokens: Column | str, n: int) -> Column:
    """Arrays of n consecutive tokens."""
    # bound once: what stands in a lambda is worked out again for each element
    each = F.transform(F.array(as_col(tokens)), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>")))
    return F.get(each, F.lit(0))


def neighbours(tokens: Column | str) -> Column:
    """Each two neighbouring tokens as one text with a space between."""
    each = F.transform(F.array(as_col(tokens)), lambda t: F.when(F.size(t) >= 2, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    return F.get(each, F.lit(0))


def padded_contexts(tokens: Column | str, order: int = 4) -> Column:
    """SQ-05: array<struct<context, next>> of a sequence after ``order`` start marks and before an end mark."""
    padded = F.concat(F.array_repeat(F.lit("<s>"), order), as_col(tokens), F.array(F.lit("</s>")))
    each = F.transform(F.array(padded), lambda t: F.transform(F.sequence(F.lit(order + 1), F.size(t)), lambda i: F.struct(F.slice(t, i - order, order).alias("context"), F.element_at(t, i).alias("next"))))
    return F.get(each, F.lit(0))
