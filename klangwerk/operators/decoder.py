"""Line generation over an n-gram model (MK-06..15, SF-25).

Pools, reservoirs, length fits and draft scores are columns of DataFrames; the beam over the model's tables is in `beam`.  What
is sequential by definition - seeded draws, the choice of diverse drafts, plans - is a function of one request's bounded rows."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Line lengths of the profile, in tokens.
COMPACT, COMMON, LONG, DEFAULT, LONGEST = 3, 9, 12, 6, 28
START, END = "<s>", "</s>"


def string_hash(text: str) -> int:
    """SF-25: 32-bit FNV-1a over code points."""
    h = 2166136261
    for ch in text:
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    return h


def seeded_random(seed):
    """SF-25: a generator of numbers in [0, 1) that a seed determines (mulberry32)."""
    state = string_hash(str(seed)) or 0x6D2B79F5
    mul = lambda a, b: a * b & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = state + 0x6D2B79F5 & 0xFFFFFFFF
        t = mul(state ^ state >> 15, state | 1)
        t ^= t + mul(t ^ t >> 7, t | 61) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw


def _unit(x):
    """Within 0..1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))) if isinstance(x, Column) else min(1.0, max(0.0, x))


def usage_quality(percentile: Column, commonness: Column, rank: Column, count: Column) -> Column:
    """MK-06: the first known of popularity, commonness, 1 - log10(rank + 1) / 7 and log10(count + 1) / 6, within 0..1; else .5."""
    return F.coalesce(_unit(percentile), _unit(commonness), F.when(rank > 0, _unit(1 - F.log10(rank + 1) / 7)), F.when(count > 0, _unit(F.log10(count + 1) / 6)), F.lit(0.5))


def mode_score(mode: str, score: Column, kind: Column, primary: Column, assonance: Column, consonance: Column) -> Column:
    """MK-06: how well a result suits a mode of rhyming."""
    base, a, c = (_unit(F.coalesce(x, F.lit(0.0))) for x in (score, assonance, consonance))
    p = F.lower(F.coalesce(primary, F.lit("")))
    return {
        "multi": F.when(p.contains("multi"), F.greatest(base, F.lit(0.94))).otherwise(base * 0.72),
        "mosaic": F.when(kind == "phrase", F.greatest(base, F.lit(0.9))).otherwise(base * 0.48),
        "slant": F.when(p.rlike("slant|family"), F.greatest(base, F.lit(0.9))).otherwise(base * 0.68),
        "assonance": F.greatest(a, base * 0.55), "chain": F.greatest(a, base * 0.62), "consonance": F.greatest(c, base * 0.55),
        "internal": _unit(F.greatest(a, c) * 0.7 + base * 0.3), "end": base,
    }.get(mode, _unit(base * 0.72 + a * 0.16 + c * 0.12))


def candidate_pool(rows: DataFrame, query: str, order: list[Column], target: str | None = None, entities: bool = True, phrases: bool = True, categories: list[str] = ()) -> DataFrame:
    """MK-06: results that may end a line: the first row of each kind and form, without the target itself, blank surfaces and
    kinds that are switched off; entities of the wanted categories only.

    Columns kind, surface, normalized and, for categories, the array categories."""
    keep = (F.trim("surface") != "") & (F.lit(True) if target is None else ~F.col("normalized").eqNullSafe(F.col(target)))
    if categories:
        keep = keep & ((F.col("kind") != "entity") | F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, categories))), F.lit(False)))
    keep = keep & (F.lit(True) if entities else F.col("kind") != "entity") & (F.lit(True) if phrases else F.col("kind") != "phrase")
    first = F.row_number().over(Window.partitionBy(query, "kind", "normalized").orderBy(*order))
    return rows.where(keep).withColumn("_n", first).where("_n = 1").drop("_n")


def tail_reservoir(pool: DataFrame, query: str, naturalness: float = 0.72, weirdness: float = 0.38, pressure: float = 0.65, mosaic: bool = False, ties: tuple = ("kind", "normalized")) -> DataFrame:
    """MK-07: pool rows (phonetic, usage, support within 0..1) with quality and place: at least 24, at most 48 and 80 times the
    weirdness more, of those whose quality is not too far below the best.  Qualities are compared to nine decimals, so that the
    last bits of a sum do not order equal rows; what is equal in surface too goes by ``ties``."""
    n, w, r = naturalness, weirdness, pressure
    bonus = F.when(F.col("kind") == "phrase", 0.08).otherwise(0.0) if mosaic else F.lit(0.0)
    quality = _unit(F.col("phonetic") * (0.5 + r * 0.32) + F.col("usage") * (0.16 + n * 0.12) + F.col("support") * (0.18 + n * 0.18) + bonus)
    own = Window.partitionBy(query)
    placed = pool.withColumn("quality", quality).withColumn("place", F.row_number().over(own.orderBy(F.desc(F.round("quality", 9)), F.desc("phonetic"), "surface", *ties)).cast("long"))
    best = F.max("quality").over(own)
    floor = F.when(best > 0, best).otherwise(1.0) * (0.44 + n * 0.18)
    good = F.count_if(F.col("quality") >= floor).over(own)
    size = F.greatest(F.lit(24), F.least(F.lit(math.floor(48 + w * 80 + 0.5)), good))
    return placed.withColumn("_size", size).where(F.col("place") <= F.col("_size")).drop("_size")


def target_bounds(target: Column | int, weirdness: float = 0.0) -> Column:
    """MK-15: struct of target, tolerance, min and max of a line's tokens."""
    t = F.greatest(F.lit(COMPACT), F.least(F.lit(LONGEST), F.coalesce(target if isinstance(target, Column) else F.lit(target), F.lit(DEFAULT)).cast("int")))
    slack = F.greatest(F.lit(1), F.floor(t * (0.10 + _unit(weirdness) * 0.08) + 0.5).cast("int"))
    return F.struct(t.alias("target"), slack.alias("tolerance"), F.greatest(F.lit(COMPACT), t - slack).alias("min"), F.least(F.lit(LONGEST), t + slack).alias("max"))


def length_fit(actual: Column, target: Column) -> Column:
    """MK-15: 1 for the asked length, less by the exponential of the distance, a tenth by the shape of the profile."""
    a, t = F.greatest(F.lit(0), actual), target_bounds(target)["target"]
    asked = F.exp(-F.abs(a - t) / F.greatest(F.lit(1.5), t * 0.28))
    longest = F.greatest(F.lit(LONG), t)
    shape = F.when(a < COMPACT, a / COMPACT).when(a > longest, F.exp(-(a - longest) / 4)).when((t <= COMMON) & (a > COMMON), 0.92).otherwise(1.0)
    return _unit(asked * 0.9 + shape * 0.1)


def draft_scores(drafts: DataFrame, naturalness: float = 0.72, weirdness: float = 0.38, pressure: float = 0.65) -> DataFrame:
    """MK-11: adds transition, natural, novelty, copied and utility to drafts with their evidence.

    Columns within 0..1: forward (probability), zero_rate, context_depth, shape_fit (null without a pattern), phrase_support,
    start, tail_fit, usage, rhyme, support, window_novelty; and matched_windows, longest_run, exact_source, target, entity (null
    without one)."""
    n, w, r = naturalness, weirdness, pressure
    shape = F.coalesce("shape_fit", F.lit(0.5))
    transition = _unit(F.pow(F.greatest(F.col("forward"), F.lit(1e-9)), F.lit(0.24)) * (1 - F.col("zero_rate")))
    natural = _unit(F.col("transition") * 0.42 + F.col("context_depth") * 0.18 + shape * 0.15 + F.col("phrase_support") * 0.05 + F.col("start") * 0.09 + F.col("tail_fit") * 0.06 + F.col("usage") * 0.05)
    novelty = F.when(F.col("exact_source"), 0.0).otherwise(_unit(F.col("window_novelty") * 0.72 + (1 - F.least(F.lit(1.0), F.col("matched_windows") / 6)) * 0.28))
    weights = {"natural": 0.38 + n * 0.3, "rhyme": 0.22 + r * 0.32, "shape": 0.12, "novelty": 0.12 + w * 0.05, "support": 0.08}
    total = F.col("natural") * weights["natural"] + F.col("rhyme") * weights["rhyme"] + shape * weights["shape"] + F.col("novelty") * weights["novelty"] + F.col("support") * weights["support"]
    bonus = F.coalesce(_unit(F.col("entity")) * 0.025, F.lit(0.0))
    most = F.when(F.col("target") >= 14, 7).when(F.col("target") >= 10, 6).otherwise(5)
    out = drafts.withColumn("transition", transition).withColumn("natural", natural).withColumn("novelty", novelty)
    return out.withColumn("copied", F.col("exact_source") | (F.col("longest_run") >= most)).withColumn("utility", _unit(total / sum(weights.values()) + bonus))


@dataclass
class Controls:
    target: int = DEFAULT
    naturalness: float = 0.72
    weirdness: float = 0.38
    pressure: float = 0.65
    opening: tuple = ()


def choose(reservoir: list[dict], draw, c: Controls, used: dict) -> dict | None:
    """MK-08: a row (form, final, family, quality, in order) by weight; what was used before and lower places weigh less."""
    if not reservoir:
        return None
    heat = max(0.08, 0.78 + c.weirdness * 1.35)
    weights = [max(1e-9, r["quality"]) ** (1 / heat) / (1 + used.get(("form", r["form"]), 0) * 3.2 + used.get(("final", r["final"]), 0) * 1.15 + used.get(("family", r["family"]), 0) * 0.45) / (1 + i * 0.012)
               for i, r in enumerate(reservoir)]
    point, chosen = draw() * sum(weights), reservoir[-1]
    for r, w in zip(reservoir, weights):
        point -= w
        if point <= 0:
            chosen = r
            break
    for k in ("form", "final", "family"):
        used[k, chosen[k]] = used.get((k, chosen[k]), 0) + 1
    return chosen


def draft_similarity(a: dict, b: dict) -> float:
    """MK-12: of two drafts (tokens, form, family of the tail): shared words, equal endings of one to three words, equal tails."""
    x, y = set(a["tokens"]), set(b["tokens"])
    if a["form"] == b["form"]:
        return 1.0
    same = (len(x & y) / len(x | y) if x | y else 1.0) * 0.42
    same += sum(w for n, w in ((1, 0.2), (2, 0.22), (3, 0.16)) if len(a["tokens"]) >= n <= len(b["tokens"]) and a["tokens"][-n:] == b["tokens"][-n:])
    return _unit(same + (0.08 if a["family"] and a["family"] == b["family"] else 0.0))


def diverse_drafts(drafts: list[dict], count: int, weirdness: float = 0.38) -> list[dict]:
    """MK-12: drafts by utility less what they repeat of those chosen before; near copies (.92 and more) are dropped."""
    left, out = sorted(drafts, key=lambda d: (-d["utility"], -d["natural"], " ".join(d["tokens"]))), []
    while left and len(out) < count:
        near = [max((draft_similarity(d, x) for x in out), default=0.0) for d in left]
        gains = [d["utility"] - n * (0.28 + weirdness * 0.18) - (0.38 if any(d["form"] == x["form"] for x in out) else 0.0) for d, n in zip(left, near)]
        best = max(range(len(left)), key=lambda i: (gains[i], -i))
        picked, alike = left.pop(best), near[best]
        if not out or alike < 0.92:
            out.append({**picked, "rank": len(out) + 1, "diversity": _unit(1 - alike)})
    return out


def plan_section(section: str, lines: int, tokens: int, scheme: str = "ABAB", seed=0, language: str = "de") -> list[dict]:
    """MK-13: line, slot of the scheme and length of each line of a section; lengths vary by one word, but not in a hook."""
    slots = [x for x in scheme.upper() if x.isascii() and x.isalpha()] or list("ABAB")
    draw, length = seeded_random(f"section|{language}|{section}|{scheme}|{seed}|{tokens}"), max(COMPACT, min(LONGEST, tokens))
    out = []
    for i in range(max(1, min(64, lines))):
        change = 0 if section == "hook" or draw() >= 0.32 else -1 if draw() < 0.5 else 1
        out.append({"line": i + 1, "slot": slots[i % len(slots)], "tokens": max(COMPACT, min(LONGEST, length + change)), "section": section})
    return out


def _weighted(weights: dict, draw) -> str | None:
    rows = [(k, v) for k, v in weights.items() if v > 0]
    point = draw() * sum(v for _, v in rows) if rows else 0
    for k, v in rows:
        point -= v
        if point <= 0:
            return k
    return rows[-1][0] if rows else None


def plan_song(profile: dict, sections: int, seed=0, scheme: str = "ABAB", language: str = "de") -> list[dict]:
    """MK-13: a song's sections as a walk: ``profile`` has start, end and transition weights of section types and, for each
    type, lines and tokens (what `plans.corpus` measures of songs).  The last section favours types that end songs."""
    n, draw = max(2, min(16, sections)), seeded_random(f"song|{language}|{seed}|{sections}")
    kinds = [_weighted(profile["start"], draw) or "verse"]
    while len(kinds) < n:
        weights = profile["transitions"].get(kinds[-1], {})
        if len(kinds) == n - 1:
            ending = {k: w * (0.35 + profile["end"].get(k, 0) * 2.5) for k, w in weights.items()}
            weights = ending if any(v > 0 for v in ending.values()) else profile["end"]
        kinds.append(_weighted(weights, draw) or _weighted(profile["end"], draw) or "verse")
    size = lambda k: profile["sections"].get(k, {"lines": 4, "tokens": DEFAULT})
    return [{"index": i + 1, "type": k, "lines": plan_section(k, size(k)["lines"], size(k)["tokens"], scheme, f"{seed}|{i}", language)} for i, k in enumerate(kinds)]


def noise(seed: str, prefix: list[str], token: str) -> float:
    """A number in [0, 1) that a seed, the words so far and the next word determine, in whatever order states are grown."""
    return zlib.crc32("\x01".join([seed, " ".join(prefix), token]).encode()) / 4294967296


def continuations(counts: DataFrame, k: int = 128, *keys: str) -> DataFrame:
    """context, next, n of the k best continuations of every context (as `corpus.transitions` counts them) of each model (keys)."""
    own = Window.partitionBy(*keys, "length", "context").orderBy(F.desc("n"), "next")
    return counts.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k).select(*keys, "context", "next", "n")


def backward_counts(tokens: DataFrame, order: int, *keys: str, gaps: bool = False) -> DataFrame:
    """AG-12: counts of (following words, word before them), contexts in reading order; what ends a line follows its last word."""
    from .corpus import transitions

    swap = lambda x: F.when(x == START, END).when(x == END, START).otherwise(x)
    counts = transitions(tokens.select(*keys, F.reverse("tokens").alias("tokens")), order, *keys, gaps=gaps)
    return counts.select(*keys, "length", F.array_join(F.reverse(F.transform(F.split("context", " "), swap)), " ").alias("context"), swap(F.col("next")).alias("next"), "n")
