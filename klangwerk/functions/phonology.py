"""Pronunciation analysis and pair scoring (PH): one algorithm for all languages, calibrated by `profiles`.

The pure functions here work on single pronunciations or pairs.  `g2p`, `analysis` and `pair_score` apply them to Arrow
batches; each distinct pronunciation or pair of a batch is computed once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F

from .profiles import ENGLISH_FOR_GERMAN, ARPABET, ARPABET_BY_STRESS, ARPABET_VOWELS, G2P_DEVOICED, G2P_FRONT, G2P_LAST_E, G2P_MULTI, G2P_SINGLE, G2P_SOFT, G2P_STRESSABLE, PROFILES, Profile

BOUNDARY = "|"
ANALYSIS = ("struct<ipa:string,phonemes:array<string>,syllables:array<struct<position:int,onset:array<string>,nucleus:string,coda:array<string>,stress:int>>,"
            "syllable_count:int,stress_pattern:string,primary_stress:int,stressed_tail:string,final_tail:string,exact_key:string,multi_key:string,vowel_key:string,"
            "vowel_family:string,coda_key:string,coda_class:string,rhyme_syllables:int>")
SCORE = "struct<overall:double,type:string,vowel:double,coda:double,stress:double,syllable:double,onset:double,consonance:double,assonance:string,assonance_score:double,consonance_relation:string,consonance_score:double>"


@lru_cache(maxsize=None)
def _scanner(language: str):
    multi = "|".join(map(regex.escape, PROFILES[language].multi))
    # a mark of syllabicity or length belongs to its symbol; other combining marks are dropped
    single = r"[\s\S](?:ː|[̩̍])?" if language == "de" else r"[\s\S]"
    skip = r"(?:(?![̩̯̍])\p{M})*" if language == "de" else ""
    return regex.compile(rf"(?P<stress>[ˈˌ])|(?P<gap>[ \-.‿])|(?P<multi>{multi})|(?P<one>{single}){skip}")


_FORMAT, _SPACE, _MARK, _BACK = (regex.compile(x) for x in (r"\p{Cf}", r"\s+", r"\p{M}", "[aou]$"))
_UNSPELLED = {True: regex.compile(r"[^a-zäöüß'’\-]"), False: regex.compile(r"[^a-z'’\-]")}


def _bare(value: str | None, language: str) -> str:
    s = unicodedata.normalize("NFC", value or "")
    if language == "en":
        s = _FORMAT.sub("", s)
    s = s.strip()
    if len(s) > 1 and s[0] + s[-1] in ("[]", "//"):
        s = s[1:-1].strip()
    return s


def segments(value: str | None, language: str) -> list[tuple[str, int]] | None:
    """PH-01/02/07: canonical symbols with their stress (0, 1, 2), and boundaries; None if invalid."""
    p, out, stress = PROFILES[language], [], 0
    for m in _scanner(language).finditer(_bare(value, language)):
        if m["stress"]:
            stress = 2 if m[0] == "ˈ" else max(stress, 1)
            continue
        if m["gap"]:
            if out and out[-1][0] != BOUNDARY:
                out.append((BOUNDARY, 0))
            continue
        raw = m["multi"] or m["one"]
        if language == "de" and raw in "()[]/" or language == "en" and raw in "ʰ̃̚":
            continue
        symbol = p.canonical.get(raw, raw)
        if p.strict and symbol not in p.nuclei and symbol not in p.consonants:
            return None
        nucleus = symbol in p.nuclei
        out.append((symbol, stress if nucleus else 0))
        stress = 0 if nucleus else stress
    while out and out[-1][0] == BOUNDARY:
        out.pop()
    return out


def arpabet_segments(value: str | None) -> list[tuple[str, int]] | None:
    """PH-06: ARPAbet phones; None for an unknown phone, a misplaced stress digit or nothing at all."""
    out = []
    for token in (value or "").upper().split():
        m = regex.fullmatch(r"([A-Z]+)([012])?", token)
        if not m or m[2] and m[1] not in ARPABET_VOWELS:
            return None
        symbol = ARPABET_BY_STRESS[m[1]][m[2] in ("1", "2")] if m[1] in ARPABET_BY_STRESS else ARPABET.get(m[1])
        if symbol is None:
            return None
        out.append((symbol, {"1": 2, "2": 1}.get(m[2], 0) if m[1] in ARPABET_VOWELS else 0))
    return out or None


def _coda_length(cluster: list[str], p: Profile) -> int:
    """PH-03: consonants between two nuclei that stay with the first: all before the longest legal onset of at most three."""
    for n in range(min(3, len(cluster)), 0, -1):
        if p.onset_join.join(p.canonical.get(x, x) for x in cluster[-n:]) in p.onsets:
            return len(cluster) - n
    return len(cluster)


def syllabify(segs: list[tuple[str, int]], p: Profile) -> list[dict]:
    """Syllables of a segment list: consonants before the first nucleus open it, those after the last close it."""
    at = [i for i, (s, _) in enumerate(segs) if s in p.nuclei]
    out, onset = [], [s for s, _ in segs[: at[0]] if s != BOUNDARY] if at else []
    for k, i in enumerate(at):
        until = at[k + 1] if k + 1 < len(at) else len(segs)
        between = [s for s, _ in segs[i + 1 : until]]
        if k + 1 == len(at):
            coda, following = [s for s in between if s != BOUNDARY], []
        elif BOUNDARY in between:
            cut = between.index(BOUNDARY)
            coda, following = between[:cut], [s for s in between[cut:] if s != BOUNDARY]
        else:
            cut = _coda_length(between, p)
            coda, following = between[:cut], between[cut:]
        out.append({"position": k + 1, "onset": onset, "nucleus": segs[i][0], "coda": coda, "stress": segs[i][1]})
        onset = following
    if len(out) == 1 and out[0]["stress"] == 0:
        out[0]["stress"] = 2
    return out


def rhyme_start(stresses: list[int], last: bool) -> int:
    """Where the rhyme begins: primary stress, else secondary, else the first syllable."""
    for level in (2, 1):
        places = [i for i, s in enumerate(stresses) if s == level]
        if places:
            return places[-1 if last else 0]
    return 0


def coda_class(coda: list[str], p: Profile) -> str:
    """PH-10: place and manner of each final consonant."""
    place = {"bilabial": "LAB", "labial": "LAB", "labiodental": "LAB", "alveolar": "COR", "postalveolar": "COR", "palatal": "DOR", "velar": "DOR", "uvular": "UV"}
    manner = {"stop": "STOP", "affricate": "AFF", "fricative": "FRIC", "nasal": "NAS", "lateral": "SON", "rhotic": "SON", "approximant": "SON"}
    name = lambda c: f"{place.get(p.consonants[c][0], 'GLO')}-{manner[p.consonants[c][1]]}" if c in p.consonants else f"?{c}"
    return "+".join(map(name, coda)) or "OPEN"


def tail(syllables: list[dict]) -> str:
    """Sounds from the first nucleus on, syllables parted by dots."""
    parts = [" ".join([*(s["onset"] if i else []), s["nucleus"], *s["coda"]]) for i, s in enumerate(syllables)]
    return " . ".join(parts)


def analyze(value: str | None, language: str, notation: str = "ipa") -> dict | None:
    """PH-04/08/09: syllables and retrieval keys of a pronunciation; None if it is invalid or has no nucleus."""
    p = PROFILES[language]
    segs = arpabet_segments(value) if notation == "arpabet" else segments(value, language)
    syllables = syllabify(segs, p) if segs else []
    if not syllables:
        return None
    stresses = [s["stress"] for s in syllables]
    start = rhyme_start(stresses, p.last_stress)
    rhyme, final = syllables[start:], syllables[-1]
    stressed = tail(rhyme)
    exact = stressed.replace(" ", "")
    return {
        "ipa": (value or "").strip() if notation == "arpabet" else _bare(value, language), "phonemes": [s for s, _ in segs if s != BOUNDARY], "syllables": syllables,
        "syllable_count": len(syllables), "stress_pattern": "".join(map(str, stresses)), "primary_stress": start + 1, "stressed_tail": stressed,
        "final_tail": " ".join([final["nucleus"], *final["coda"]]), "exact_key": exact, "multi_key": exact if len(rhyme) > 1 else None,
        "vowel_key": "-".join(s["nucleus"] for s in rhyme), "vowel_family": "-".join(p.family.get(s["nucleus"], s["nucleus"]) for s in rhyme),
        "coda_key": " ".join(final["coda"]), "coda_class": coda_class(final["coda"], p), "rhyme_syllables": len(rhyme),
    }


@lru_cache(maxsize=200_000)
def vowel_similarity(a: str, b: str, language: str, relaxed: bool = False) -> float:
    """PH-11/13/14: 1 minus weighted feature differences; ``relaxed`` floors pairs of reduced nuclei."""
    p = PROFILES[language]
    if a == b:
        return 1.0
    x, y = p.vowels.get(a), p.vowels.get(b)
    if x is None or y is None:
        found = p.unknown[0]
    elif 5 in (x[0], y[0]):
        found = p.syllabic_match[x[0] != y[0]]
    else:
        steps = [abs(x[0] - y[0]) / 4, abs(x[1] - y[1]) / 2, *(float(i != j) for i, j in zip(x[2:], y[2:]))]
        found = min(1.0, max(0.0, 1 - sum(w * d for w, d in zip(p.vowel_weights, steps))))
        if p.diphthong_penalty and x[4] and y[4]:
            found = max(0.0, found - p.diphthong_penalty)
    return max(found, p.reduced_floor) if relaxed and a in p.reduced and b in p.reduced else found


@lru_cache(maxsize=200_000)
def consonant_similarity(a: str, b: str, language: str) -> float:
    """PH-12/14."""
    p = PROFILES[language]
    if a == b:
        return 1.0
    x, y = p.consonants.get(a), p.consonants.get(b)
    if x is None or y is None:
        return p.unknown[1]
    near = lambda table, i: min(1.0, abs(table[x[i]] - table[y[i]]) / 2.5)
    steps = (near(p.places, 0), near(p.manners, 1), float(x[2] != y[2]), float(x[3] != y[3]))
    return min(1.0, max(0.0, 1 - sum(w * d for w, d in zip(p.consonant_weights, steps))))


def sequence_similarity(a, b, alike, both_empty: float) -> float:
    """PH-15: 1 - weighted edit distance / longer length; a substitution costs what the symbols lack in similarity."""
    if not a or not b:
        return both_empty if not a and not b else 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + 1 - alike(x, y))
    return min(1.0, max(0.0, 1 - row[-1] / max(len(a), len(b))))


#: Pairs of sequences whose similarity a worker keeps; codas, onsets and vowel sequences come again and again.
KEPT_PAIRS = 200_000


@lru_cache(maxsize=KEPT_PAIRS)
def _vowels_alike(a: tuple, b: tuple, language: str) -> float:
    return sequence_similarity(a, b, lambda x, y: vowel_similarity(x, y, language, True), 1.0)


@lru_cache(maxsize=KEPT_PAIRS)
def _consonants_alike(a: tuple, b: tuple, language: str, both_empty: float) -> float:
    return sequence_similarity(a, b, lambda x, y: consonant_similarity(x, y, language), both_empty)


def stress_similarity(a: list[int], b: list[int], adjacent: float) -> float:
    """PH-16: aligned from the right."""
    n = max(len(a), len(b), 1)
    pairs = zip(reversed(a), reversed(b))
    return sum(1.0 if x == y else adjacent if abs(x - y) == 1 else 0.0 for x, y in pairs) / n


def rhyme_vector(syllables: list[dict], start: int) -> dict:
    """PH-17: what is compared: syllables from the rhyme's start, without the first onset."""
    own = [{**s, "onset": tuple(s["onset"]) if i else (), "coda": tuple(s["coda"])} for i, s in enumerate(syllables[start:])]
    return {"syllables": own, "vowels": tuple(s["nucleus"] for s in own), "consonants": tuple(c for s in own for c in (*s["onset"], *s["coda"])), "stress": [s["stress"] for s in own], "codas": {c for s in own for c in s["coda"]}}


def relations(a: dict, b: dict, language: str, exact: bool) -> tuple[str | None, float, str | None, float]:
    """PH-22: assonance and consonance, each strong, partial or None, with their scores; both None for exact rhymes."""
    p = PROFILES[language]
    alike = lambda x, y: vowel_similarity(x, y, language, True)
    cover = lambda x, y: min(len(x), len(y)) / max(len(x), len(y)) if x and y else 0.0
    first = alike(a["vowels"][0], b["vowels"][0]) if a["vowels"] and b["vowels"] else 0.0
    vowels, of_vowels = _vowels_alike(a["vowels"], b["vowels"], language), cover(a["vowels"], b["vowels"])
    consonants = _consonants_alike(a["consonants"], b["consonants"], language, 1.0)
    of_consonants = cover(a["consonants"], b["consonants"])
    t, u = p.assonance, p.consonance
    grade = lambda strong, partial: None if exact else "strong" if strong else "partial" if partial else None
    assonance = grade(first == 1 and of_vowels == 1 and vowels >= t["strong"], first >= t["nucleus"] and vowels >= t["sequence"] and of_vowels >= t["coverage"])
    some = bool(a["consonants"] and b["consonants"])
    consonance = grade(some and consonants >= u["strong"] and of_consonants >= u["strong_coverage"] and vowels <= u["strong_vowels"] and first <= u["strong_nucleus"],
                       some and consonants >= u["sequence"] and of_consonants >= u["coverage"] and vowels <= u["vowels"] and first <= u["nucleus"])
    return assonance, round(0.5 * first + 0.4 * vowels + 0.1 * of_vowels, 4), consonance, round(0.7 * consonants + 0.15 * of_consonants + 0.15 * (1 - vowels), 4)


def primary_class(language: str, multi: bool, overall: float, vowel: float, coda: float, shared_coda: bool) -> str:
    """PH-18/19."""
    t = PROFILES[language].primary
    if multi and overall >= t["multi_slant"]:
        return "multisyllabic_slant"
    if multi and overall >= t.get("multi_family", 2):
        return "family"
    closed = shared_coda if "family_coda" not in t else coda >= t["family_coda"]
    if overall >= t["family"] and vowel >= t["family_vowel"] and closed:
        return "family"
    return "slant" if overall >= t["slant"] and vowel >= t["slant_vowel"] else "weak"


def score_vectors(a: dict, b: dict, language: str, exact: bool) -> dict:
    """PH-20/21: similarity of two rhyme vectors; syllables are paired from the right, a missing one scores 0."""
    p = PROFILES[language]
    assonance, a_score, consonance, c_score = relations(a, b, language, exact)
    multi = len(a["syllables"]) > 1 and len(b["syllables"]) > 1
    out = {"assonance": assonance, "assonance_score": a_score, "consonance_relation": consonance, "consonance_score": c_score}
    if exact:
        return {"overall": 1.0, "type": "multisyllabic_perfect" if multi else "perfect", "vowel": 1.0, "coda": 1.0, "stress": 1.0, "syllable": 1.0, "onset": 1.0, "consonance": 1.0, **out}
    x, y = a["syllables"], b["syllables"]
    n = max(len(x), len(y), 1)
    vowel = coda = onset = 0.0
    for k in range(1, min(len(x), len(y)) + 1):
        s, t = x[-k], y[-k]
        vowel += vowel_similarity(s["nucleus"], t["nucleus"], language, len(x) > k and len(y) > k)
        coda += _consonants_alike(s["coda"], t["coda"], language, 0.6)
        onset += _consonants_alike(s["onset"], t["onset"], language, 0.6)
    vowel, coda, onset = vowel / n, coda / n, onset / n
    stress = stress_similarity(a["stress"], b["stress"], p.adjacent_stress)
    syllable = 1 - abs(len(x) - len(y)) / n
    overall = min(1.0, max(0.0, sum(w * v for w, v in zip(p.score_weights, (vowel, coda, stress, syllable, onset)))))
    kind = primary_class(language, multi, overall, vowel, coda, bool(a["codas"] & b["codas"]))
    return {"overall": overall, "type": kind, "vowel": vowel, "coda": coda, "stress": stress, "syllable": syllable, "onset": onset, "consonance": sum(w * v for w, v in zip(p.consonance_weights, (coda, onset))), **out}


def score(a: dict, b: dict, language: str) -> dict:
    """PH-20/21 for two analyses."""
    return score_vectors(rhyme_vector(a["syllables"], a["primary_stress"] - 1), rhyme_vector(b["syllables"], b["primary_stress"] - 1), language, a["exact_key"] == b["exact_key"])


def anchors(syllables: list[dict], start: int) -> list[int]:
    """PH-24: the rhyme's start and every later stressed syllable."""
    return [start, *(i for i in range(start + 1, len(syllables)) if syllables[i]["stress"] > 0)]


def score_anchored(a: dict, b: dict, language: str) -> dict:
    """PH-26: the best score over pairs of anchors whose tails differ by at most one syllable: class, score, primary anchors."""
    tier = {"multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3, "weak": 9}
    found = []
    for i in anchors(a["syllables"], a["primary_stress"] - 1):
        for j in anchors(b["syllables"], b["primary_stress"] - 1):
            if abs((len(a["syllables"]) - i) - (len(b["syllables"]) - j)) <= 1:
                exact = tail(a["syllables"][i:]) == tail(b["syllables"][j:])
                s = score_vectors(rhyme_vector(a["syllables"], i), rhyme_vector(b["syllables"], j), language, exact)
                found.append((tier[s["type"]], -s["overall"], i + j, s))
    return min(found, key=lambda x: x[:3])[3] if found else score(a, b, language)


def window_analysis(syllables: list[dict], start: int, end: int, language: str) -> dict:
    """SQ-02: keys of the syllables start..end-1 as a phrase of their own, whose rhyme begins at the first of them."""
    p = PROFILES[language]
    own, nuclei = syllables[start:end], [s["nucleus"] for s in syllables[start:end]]
    exact = tail(own).replace(" ", "")
    return {"syllables": own, "syllable_count": len(own), "exact_key": exact, "multi_key": exact if len(own) > 1 else None, "vowel_key": "-".join(nuclei),
            "vowel_family": "-".join(p.family.get(n, n) for n in nuclei), "final_nucleus": nuclei[-1], "coda_key": " ".join(own[-1]["coda"]), "coda_class": coda_class(own[-1]["coda"], p)}


#: Syllables of the windows and of the query's tails that are matched with them.
WINDOW_SYLLABLES = (2, 6)


def query_anchors(a: dict, language: str) -> list[dict]:
    """SQ-03: the tails by which a query is looked up: from the rhyme's start, from each later stress, and the whole word, of
    two to six syllables; tails with equal keys once, in that order."""
    n, first, out, seen = len(a["syllables"]), a["primary_stress"] - 1, [], set()
    starts = [(i, "primary" if i == first else "secondary") for i in anchors(a["syllables"], first)]
    for at, kind in [*sorted(starts, key=lambda x: (x[1] != "primary", x[0])), (0, "full_surface")]:
        if WINDOW_SYLLABLES[0] <= n - at <= WINDOW_SYLLABLES[1]:
            own = window_analysis(a["syllables"], at, n, language)
            key = tuple(own[k] for k in ("syllable_count", "exact_key", "vowel_key", "vowel_family", "coda_class"))
            if key not in seen:
                seen.add(key)
                out.append({"anchor": f"{kind}:{at + 1}", "position": at + 1, "kind": kind, **own})
    return out


def clipped_anchors(a: dict, most: int | None = None) -> list[dict]:
    """PH-27: start, end and kind of the tails of a word; if the rightmost one has more than ``most`` syllables, it comes again
    with only so many."""
    n, first = len(a["syllables"]), a["primary_stress"] - 1
    out = [{"start": i, "end": n, "kind": "primary" if i == first else "secondary"} for i in anchors(a["syllables"], first)]
    last = out[-1]
    if most and n - last["start"] > most:
        out.append({"start": last["start"], "end": last["start"] + most, "kind": last["kind"] + "_clipped"})
    return out


def score_clipped(query: dict, target: dict, language: str, most: int | None = None) -> dict:
    """PH-26/27: as `score_anchored`, with the query's clipped tail as well."""
    tier = {"multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3, "weak": 9}
    found = []
    for c in clipped_anchors(query, most):
        own = query["syllables"][: c["end"]]
        for j in anchors(target["syllables"], target["primary_stress"] - 1):
            if abs((c["end"] - c["start"]) - (len(target["syllables"]) - j)) <= 1:
                s = score_vectors(rhyme_vector(own, c["start"]), rhyme_vector(target["syllables"], j), language, tail(own[c["start"] :]) == tail(target["syllables"][j:]))
                found.append((tier[s["type"]], -s["overall"], c["start"] + j, s))
    return min(found, key=lambda x: x[:3])[3] if found else score(query, target, language)


def to_english(ipa: str | None) -> dict | None:
    """PH-28: a German pronunciation's rightmost tail that English sounds can say, analysed as English: ipa, position, analysis;
    the whole pronunciation read as English if none can; None if that fails too."""
    a = analyze(ipa, "de")
    for at in sorted(anchors(a["syllables"], a["primary_stress"] - 1), reverse=True) if a else []:
        parts = ["".join(ENGLISH_FOR_GERMAN.get(x, x) for x in [*(s["onset"] if i else []), s["nucleus"], *s["coda"]]) for i, s in enumerate(a["syllables"][at:])]
        adapted = "ˈ" + ".".join(parts)
        found = analyze(adapted, "en")
        if found:
            return {"ipa": adapted, "position": at + 1, "analysis": found}
    plain = unicodedata.normalize("NFC", ipa or "").replace("̯", "").strip()
    found = analyze(plain, "en")
    return {"ipa": plain, "position": None, "analysis": found} if found else None


def score_bound(a: dict, b: dict, language: str) -> float:
    """PH-23: no score of two analyses can be above this: vowels and lengths as they are, all else taken as equal."""
    if a["exact_key"] == b["exact_key"]:
        return 1.0
    p = PROFILES[language]
    x, y = (t["syllables"][t["primary_stress"] - 1 :] for t in (a, b))
    n = max(len(x), len(y), 1)
    vowel = sum(vowel_similarity(x[-k]["nucleus"], y[-k]["nucleus"], language, len(x) > k and len(y) > k) for k in range(1, min(len(x), len(y)) + 1)) / n
    share = min(len(x), len(y)) / n
    return min(1.0, max(0.0, sum(w * v for w, v in zip(p.score_weights, (vowel, share, share, share, share)))))


def _length_bound(a, b, both_empty: float) -> float:
    """What `sequence_similarity` cannot exceed: sequences of unequal length lose an edit for each symbol too many."""
    return min(len(a), len(b)) / max(len(a), len(b)) if a or b else both_empty


#: Tiers of primary classes; relations follow with 4 and 5.
TIER_OF = {"multisyllabic_perfect": 0, "perfect": 0, "multisyllabic_slant": 1, "family": 2, "slant": 3}


def possible(a: dict, b: dict, language: str, exact: bool) -> tuple[int, float] | None:
    """PH-23 for two rhyme vectors: the best tier and score that `score_vectors` may give them, None if it must reject them.

    Vowels, stress and lengths are as in the score; consonant sequences count as alike as their lengths allow."""
    if exact:
        return 0, 1.0
    p = PROFILES[language]
    x, y = a["syllables"], b["syllables"]
    n, multi = max(len(x), len(y), 1), len(x) > 1 and len(y) > 1
    vowel = coda = onset = 0.0
    for k in range(1, min(len(x), len(y)) + 1):
        s, t = x[-k], y[-k]
        vowel += vowel_similarity(s["nucleus"], t["nucleus"], language, len(x) > k and len(y) > k)
        coda += _length_bound(s["coda"], t["coda"], 0.6)
        onset += _length_bound(s["onset"], t["onset"], 0.6)
    vowel, coda, onset = vowel / n, coda / n, onset / n
    parts = (vowel, coda, stress_similarity(a["stress"], b["stress"], p.adjacent_stress), 1 - abs(len(x) - len(y)) / n, onset)
    most = min(1.0, max(0.0, sum(w * v for w, v in zip(p.score_weights, parts)))) + 1e-9  # sums may round the other way
    tier = TIER_OF.get(primary_class(language, multi, most, vowel + 1e-9, coda + 1e-9, bool(a["codas"] & b["codas"])), 9)
    if tier > 3:
        alike = lambda v, w: vowel_similarity(v, w, language, True)
        t, u = p.assonance, p.consonance
        first = alike(a["vowels"][0], b["vowels"][0]) if a["vowels"] and b["vowels"] else 0.0
        cover = _length_bound(a["vowels"], b["vowels"], 0.0)
        covered = _length_bound(a["consonants"], b["consonants"], 0.0) if a["consonants"] and b["consonants"] else -1.0
        if first >= t["nucleus"] and cover >= t["coverage"] and cover >= t["sequence"]:
            tier = 4
        elif covered >= min(u["coverage"], u["strong_coverage"]) and covered >= min(u["sequence"], u["strong"]) and first <= max(u["nucleus"], u["strong_nucleus"]):
            tier = 5
    return (tier, most) if tier < 9 else None


def spell_sound(syllables: list[dict], primary_stress: int) -> str:
    """Syllables in one text: where the rhyme begins, then onset, nucleus, coda and stress of each, as `hear_sound` reads it."""
    return "\t".join([str(primary_stress), *("|".join([" ".join(s["onset"]), s["nucleus"], " ".join(s["coda"]), str(s["stress"])]) for s in syllables)])


def hear_sound(sound: str) -> dict:
    """What scoring needs of an analysis, from `spell_sound`'s text."""
    start, *parts = sound.split("\t")
    syllables = []
    for i, part in enumerate(parts):
        onset, nucleus, coda, stress = part.split("|")
        syllables.append({"position": i + 1, "onset": onset.split(), "nucleus": nucleus, "coda": coda.split(), "stress": int(stress)})
    return {"syllables": syllables, "primary_stress": int(start)}


def rhyme_of(sound: str) -> str:
    """The part of `spell_sound`'s text that scores depend on: from the rhyme's start, without its first onset."""
    start, *parts = sound.split("\t")
    rhyme = parts[int(start) - 1 :]
    rhyme[0] = rhyme[0][rhyme[0].index("|") :]
    return "\t".join(rhyme)


def anchored_vectors(a: dict) -> list[tuple[int, int, str, dict]]:
    """PH-24: every anchor of an analysis with its number of syllables, its sounds and its rhyme vector."""
    own = a["syllables"]
    return [(i, len(own) - i, tail(own[i:]), rhyme_vector(own, i)) for i in anchors(own, a["primary_stress"] - 1)]


def _anchor_pairs(a: list, b: list):
    """Pairs that `score_anchored` compares: tails that differ by at most a syllable, else the first ones."""
    near = [(x, y) for x in a for y in b if abs(x[1] - y[1]) <= 1]
    return near or [(a[0], b[0])]


def possible_anchored(a: list, b: list, language: str) -> tuple[int, float] | None:
    """PH-23 for anchored vectors: the best tier and the best score of all pairs, None if every pair must be rejected."""
    found = [f for x, y in _anchor_pairs(a, b) if (f := possible(x[3], y[3], language, x[2] == y[2]))]
    return (min(f[0] for f in found), max(f[1] for f in found)) if found else None


def score_prepared(a: list, b: list, language: str) -> dict:
    """PH-26 for anchored vectors."""
    best = None
    for x, y in _anchor_pairs(a, b):
        s = score_vectors(x[3], y[3], language, x[2] == y[2])
        key = (TIER_OF.get(s["type"], 9), -s["overall"], x[0] + y[0])
        if best is None or key < best[0]:
            best = (key, s)
    return best[1]


def spelling(surface: str | None, language: str) -> str:
    s = _SPACE.sub(" ", unicodedata.normalize("NFKC", surface or "").strip()).lower()
    if language == "en":
        s = _MARK.sub("", unicodedata.normalize("NFKD", s))
    return _UNSPELLED[language == "de"].sub("", s)


def _sound(text: str, i: int, language: str) -> tuple[int, str]:
    """Letters read at place i, and their sound."""
    if language == "de":
        if text.startswith("ch", i):
            return 2, "x" if _BACK.search(text[:i]) else "ç"
        if i == 0 and text[:2] in ("sp", "st"):
            return 2, "ʃ" + text[1]
    for letters, sound in G2P_MULTI[language]:
        if text.startswith(letters, i):
            return len(letters), sound
    c = text[i]
    if c == "e" and i == len(text) - 1:
        return 1, G2P_LAST_E[language]
    if c == "y" and i == 0 and language == "en":
        return 1, "j"
    if c in G2P_SOFT[language] and text[i + 1 : i + 2] and text[i + 1] in G2P_FRONT[language]:
        return 1, G2P_SOFT[language][c]
    return 1, G2P_SINGLE[language].get(c, "")


def grapheme_to_ipa(surface: str | None, language: str) -> str:
    """PH-29: pronunciation by spelling rules; stress on the last vowel of words of ten letters and more, else in front."""
    text, out, i = spelling(surface, language), "", 0
    while i < len(text):
        n, sound = _sound(text, i, language)
        out, i = out + sound, i + n
    if language == "de" and out:
        if text[-1:] in G2P_DEVOICED and out.endswith(text[-1]):
            out = out[:-1] + G2P_DEVOICED[text[-1]]
        at = out.rfind("a")
        if text.endswith("ag") and not text.endswith("arg") and at >= 0 and "ː" not in out[at : at + 2]:
            out = out[:at] + "aː" + out[at + 1 :]
    if not out:  # letters without a rule: each spoken by itself
        single = G2P_SINGLE[language]
        out = "".join(single[c] + ("" if c in "aeiouyäöü" else "ə") for c in text if c in single) or "ə"
    at = max((k for k, c in enumerate(out) if c in G2P_STRESSABLE), default=0) if len(text) >= 10 else 0
    return out[:at] + "ˈ" + out[at:]


@lru_cache(maxsize=200_000)
def nuclei(word: str, language: str) -> tuple:
    """PH-29 and PH-04: the nuclei of a word's syllables; none for what cannot be spoken.  Frequent words are spoken once a worker."""
    segs = segments(grapheme_to_ipa(word, language), language) if language in PROFILES and word is not None else None
    return tuple(s["nucleus"] for s in syllabify(segs, PROFILES[language])) if segs else ()


def crossing_windows(words, language: str, least: int, most: int):
    """SQ-01: (start, length, vowel key) of the windows of least..most syllables of a phrase that cross a word boundary."""
    own, place = [], []
    for i, word in enumerate(words if words is not None else ()):
        found = nuclei(word, language)
        own += found
        place += [i] * len(found)
    for i, first in enumerate(own):
        key = first
        for j in range(i + 1, min(len(own), i + most)):
            key = f"{key}-{own[j]}"
            if j - i + 1 >= least and place[j] != place[i]:
                yield i, j - i + 1, key


def _once(f, *columns):
    """f over rows of columns, each distinct row once."""
    known = {}
    out = []
    for row in zip(*columns):
        if row not in known:
            known[row] = f(*row)
        out.append(known[row])
    return out


def _g2p(surface: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series(_once(lambda s, g: grapheme_to_ipa(s, g) if g in PROFILES else None, surface, language), dtype=object)


def _analysis(value: pd.Series, language: pd.Series) -> pd.DataFrame:
    names = ("ipa phonemes syllables syllable_count stress_pattern primary_stress stressed_tail final_tail exact_key multi_key vowel_key vowel_family coda_key coda_class rhyme_syllables").split()
    rows = _once(lambda v, g: analyze(v, g) if g in PROFILES and v is not None else None, value, language)
    return pd.DataFrame([[r[n] if r else None for n in names] for r in rows], columns=names)


def _score(a: pd.Series, b: pd.Series, language: pd.Series) -> pd.DataFrame:
    """Scores of pronunciations (IPA) a and b, each distinct pair once per batch."""
    names, parsed = [x.split(":")[0] for x in SCORE[7:-1].split(",")], {}

    def of(v, g):
        if (v, g) not in parsed:
            parsed[v, g] = analyze(v, g)
        return parsed[v, g]

    def one(v, w, g):
        x, y = of(v, g), of(w, g)
        return score_anchored(x, y, g) if x and y else None

    rows = _once(one, a, b, language)
    return pd.DataFrame([[r[n] if r else None for n in names] for r in rows], columns=names)


def g2p(surface, language):
    """PH-29 as a column."""
    return F.pandas_udf(_g2p, "string")(surface, language)


def analysis(ipa, language):
    """PH-04/08 as a column of ANALYSIS."""
    return F.pandas_udf(_analysis, ANALYSIS)(ipa, language)


def extent(ipa, language):
    """PH-04 as a column of (ipa, sounds, syllables): a pronunciation as its analysis has it, and how long it is."""

    def one(v, g):
        a = analyze(v, g) if g in PROFILES and v is not None else None
        return (a["ipa"], len(a["phonemes"]), a["syllable_count"]) if a else (None, None, None)

    def run(v: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(*x) for x in zip(v, g)], columns=["ipa", "sounds", "syllables"])
        return out.astype({"sounds": "Int32", "syllables": "Int32"})

    return F.pandas_udf(run, "struct<ipa:string,sounds:int,syllables:int>")(ipa, language)


def spoken(surface, language):
    """PH-29 and PH-04/08 in one pass over Python: (ipa, a)."""
    names = ("ipa phonemes syllables syllable_count stress_pattern primary_stress stressed_tail final_tail exact_key multi_key vowel_key vowel_family coda_key coda_class rhyme_syllables").split()

    def one(s, g):
        ipa = grapheme_to_ipa(s, g) if g in PROFILES else None
        found = analyze(ipa, g) if ipa is not None else None
        return ipa, {n: found[n] for n in names} if found else None

    def run(s: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_once(one, s, g), columns=["ipa", "a"])

    # marked, or a filter on the result would be pushed below it as a second run of the rules
    return F.pandas_udf(run, f"struct<ipa:string,a:{ANALYSIS}>").asNondeterministic()(surface, language)


def sound(syllables, primary_stress):
    """`spell_sound` as a column."""
    each = F.transform(syllables, lambda s: F.concat_ws("|", F.array_join(s["onset"], " "), s["nucleus"], F.array_join(s["coda"], " "), s["stress"].cast("string")))
    return F.concat_ws("\t", primary_stress.cast("string"), F.array_join(each, "\t"))


def pair_score(a, b, language):
    """PH-26 as a column of SCORE."""
    return F.pandas_udf(_score, SCORE)(a, b, language)


WINDOW_KEYS = "struct<syllable_count:int,exact_key:string,multi_key:string,vowel_key:string,vowel_family:string,final_nucleus:string,coda_key:string,coda_class:string>"
_KEYS = [x.split(":")[0] for x in WINDOW_KEYS[7:-1].split(",")]


def windows(syllables, language, least: int = WINDOW_SYLLABLES[0], most: int = WINDOW_SYLLABLES[1]):
    """SQ-01/02 as a column: array of (start, end, keys) of all windows of least..most syllables."""
    kind = "array<struct<start:int,end:int,keys:" + WINDOW_KEYS + ">>"

    def run(rows: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for own, g in zip(rows, languages):
            own = [] if own is None or g not in PROFILES else [{**s, "onset": list(s["onset"]), "coda": list(s["coda"])} for s in own]
            found = []
            for i in range(len(own)):
                for j in range(i + least, min(len(own), i + most) + 1):
                    w = window_analysis(own, i, j, g)
                    found.append({"start": i, "end": j, "keys": {k: w[k] for k in _KEYS}})
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)(syllables, language)


def anchors_of(ipa, language):
    """SQ-03 as a column: array of (anchor, position, kind, keys)."""

    def one(v, g):
        a = analyze(v, g) if g in PROFILES else None
        return [{**{k: x[k] for k in ("anchor", "position", "kind")}, "keys": {k: x[k] for k in _KEYS}} for x in query_anchors(a, g)] if a else []

    return F.pandas_udf(lambda v, g: pd.Series(_once(one, v, g), dtype=object), "array<struct<anchor:string,position:int,kind:string,keys:" + WINDOW_KEYS + ">>")(ipa, language)


def window_score(query_ipa, position, ipa, start, end, language):
    """The SCORE of a query's tail from a syllable on and a window of another pronunciation."""
    names = [x.split(":")[0] for x in SCORE[7:-1].split(",")]

    def one(v, at, w, i, j, g):
        a, b = analyze(v, g), analyze(w, g)
        if not a or not b:
            return None
        own, other = a["syllables"][int(at) - 1 :], b["syllables"][int(i) : int(j)]
        return score_vectors(rhyme_vector(own, 0), rhyme_vector(other, 0), g, tail(own) == tail(other))

    def run(v: pd.Series, at: pd.Series, w: pd.Series, i: pd.Series, j: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = _once(one, v, at, w, i, j, g)
        return pd.DataFrame([[r[n] if r else None for n in names] for r in rows], columns=names)

    return F.pandas_udf(run, SCORE)(query_ipa, position, ipa, start, end, language)


def english_bridge(ipa):
    """PH-28 as a column: (ipa, position)."""

    def run(v: pd.Series) -> pd.DataFrame:
        rows = _once(to_english, v)
        return pd.DataFrame({"ipa": [r["ipa"] if r else None for r in rows], "position": pd.array([r["position"] if r else None for r in rows], dtype="Int32")})

    return F.pandas_udf(run, "ipa string, position int")(ipa)
