"""The decoder for one request in plain Python, which the DataFrame beam must equal."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

from klangwerk.operators.beam import draft
from klangwerk.operators.decoder import COMPACT, END, LONGEST, START, Controls, _unit, choose, diverse_drafts, noise, seeded_random


@dataclass
class Model:
    """Continuations of contexts in both directions, in memory."""

    order: int
    rows: dict = field(default_factory=lambda: defaultdict(dict))  # (direction, context) to {next: n}
    counts: dict = field(default_factory=lambda: defaultdict(int))

    @classmethod
    def of(cls, forward, backward, order: int):
        """From two tables of best continuations (context, next, n)."""
        model = cls(order)
        for direction, df in (("forward", forward), ("reverse", backward)):
            for context, nxt, n in df.select("context", "next", "n").collect():
                model.add(direction, context, nxt, n)
        return model

    def add(self, direction: str, context: str, nxt: str, n: int) -> None:
        self.rows[direction, context][nxt] = n
        self.counts[nxt] += n

    def choices(self, direction: str, context: list[str], most: int = 96) -> tuple[list[tuple[str, int]], int]:
        own = self.rows.get((direction, " ".join(context)), {})
        return sorted(own.items(), key=lambda x: (-x[1], x[0]))[:most], sum(own.values())

    def contexts(self, direction: str, around: list[str]):
        """The context nearest to the open place, from the longest to one word."""
        for k in range(min(self.order, len(around)), 0, -1):
            yield k, around[-k:] if direction == "forward" else around[:k]

    def probability(self, direction: str, around: list[str], nxt: str) -> tuple[float, int]:
        for k, context in self.contexts(direction, around):
            own = self.rows.get((direction, " ".join(context)), {})
            if nxt in own:
                return own[nxt] / sum(own.values()), k
        return 0.0, 0

    def support(self, token: str) -> float:
        return _unit(math.log1p(self.counts.get(token, 0)) / math.log(1024))

    def bridges(self, left: list[str], right: list[str], most: int = 96) -> list[tuple[str, float, int]]:
        """JN-20: tokens seen after the left and before the right context, with sqrt(p q) and the shorter context's length."""
        ahead = next((c for c in (({t: n / total for t, n in rows}, k) for k, context in self.contexts("forward", left) for rows, total in [self.choices("forward", context, most)] if rows)), ({}, 0))
        behind = next((c for c in (({t: n / total for t, n in rows}, k) for k, context in self.contexts("reverse", right) for rows, total in [self.choices("reverse", context, most)] if rows)), ({}, 0))
        found = [(t, math.sqrt(p * behind[0][t]), min(ahead[1], behind[1])) for t, p in ahead[0].items() if t in behind[0]]
        return sorted(found, key=lambda x: (-x[1], x[0]))

    def forward_score(self, tokens: list[str]) -> tuple[float, float]:
        """MK-05 of a line: geometric mean of the transitions and the share of unseen ones."""
        padded = [START] * self.order + tokens
        p = [self.probability("forward", padded[: self.order + i], t)[0] for i, t in enumerate([*tokens, END])]
        return math.exp(sum(math.log(max(x, 1e-9)) for x in p) / len(p)), sum(x == 0 for x in p) / len(p)




def _repetition(prefix: list[str], token: str) -> float:
    n = prefix.count(token)
    return math.inf if n > 1 else (0.65 if n else 0.0) + (1.2 if len(prefix) > 1 and prefix[-1] == token else 0.0)


def _openings(model: Model, around: list[str], prefix: list[str], seed, c: Controls) -> list[tuple[str, float, int]]:
    """Tokens that may stand before a context, with probability and context length: the longest context first; if it knows
    few, one shorter adds others.  Far less likely ones than the best are left out."""
    found = {}
    for k, context in model.contexts("reverse", around):
        rows, total = model.choices("reverse", context)
        rows = [(t, n) for t, n in rows if t not in (START, END) and _repetition(prefix, t) < math.inf]
        if not rows:
            continue
        least = rows[0][1] / total * (0.015 + c.naturalness * 0.12)
        for t, n in rows:
            p = n / total
            if p >= least:
                base = max(1e-9, p) * (0.78 + k / model.order * (0.32 + c.naturalness * 0.52)) * (0.85 + model.support(t) * 0.3) * math.exp(-_repetition(prefix, t))
                if t not in found or k > found[t][1] or base > found[t][3]:
                    found[t] = (p, k, n, base)
        if len(found) >= 10:
            break
    scored = [(t, p, k, round(math.log(max(base, 1e-12)) + c.weirdness * (noise(seed, prefix, t) - 0.5) * 0.7, 9), n) for t, (p, k, n, base) in found.items()]
    scored.sort(key=lambda x: (-x[3], -x[2], -x[4], x[0]))
    return [(t, p, k) for t, p, k, *_ in scored[: max(5, min(20, math.floor(7 + c.weirdness * 13 + 0.5)))]]


def reverse_beam(model: Model, tail: list[str], seed, c: Controls) -> list[dict]:
    """MK-09: lines of the target length that end in ``tail``, built from right to left; the word next to a fixed opening must
    have been seen on both sides.  The best states by mean score stay, one for each beginning."""
    length = max(COMPACT, min(LONGEST, c.target))
    missing = length - len(c.opening) - len(tail)
    if missing <= 0:
        return [] if missing < 0 else [{"tokens": [*c.opening, *tail], "prefix": [], "context_mean": 0.0}]
    width = max(10, min(36, math.floor(14 + c.weirdness * 22 + 0.5)))
    beam = [([], 0.0, 0)]
    for step in range(missing):
        grown = []
        for prefix, score, depth in beam:
            around = [*prefix, *tail, END]
            options = _openings(model, around, prefix, seed, c)
            if c.opening and step == missing - 1:
                options = [x for x in model.bridges(list(c.opening), around) if x[0] not in (START, END)] or options
            grown += [([t, *prefix], round(score + math.log(max(p, 1e-9)) + k / model.order * 0.24, 9), depth + k) for t, p, k in options]
        grown.sort(key=lambda x: (-x[1], -x[2], " ".join(x[0])))
        beam, seen = [], set()
        for state in grown:
            key = tuple(state[0][: model.order + 1])
            if key not in seen and len(beam) < width:
                seen.add(key)
                beam.append(state)
        if not beam:
            return []
    return [{"tokens": [*c.opening, *prefix, *tail], "prefix": prefix, "context_mean": depth / missing} for prefix, _, depth in beam]


def with_entities(model: Model, line: dict, entities: list[dict], seed, most: int = 6) -> list[dict]:
    """MK-10: the line, and variants in which an entity (tokens, quality) takes the place of as many words of its beginning,
    if few transitions of the new line are unseen."""
    out = []
    for e in sorted(entities, key=lambda e: (-e["quality"], " ".join(e["tokens"])))[:24]:
        n = len(e["tokens"])
        for i in range(len(line["prefix"]) - n + 1) if 1 <= n <= min(4, len(line["prefix"])) else ():
            prefix = [*line["prefix"][:i], *e["tokens"], *line["prefix"][i + n :]]
            lead = len(line["tokens"]) - len(line["prefix"])
            at = next(k for k in range(lead + 1) if line["tokens"][k : k + len(line["prefix"])] == line["prefix"])
            tokens = [*line["tokens"][:at], *prefix, *line["tokens"][at + len(line["prefix"]) :]]
            unseen = model.forward_score(tokens)[1]
            if unseen <= 0.18:
                out.append({**line, "tokens": tokens, "prefix": prefix, "entity": e["quality"] * 0.58 + (1 - unseen) * 0.34 + zlib.crc32("\x01".join([seed, " ".join(tokens), " ".join(e["tokens"])]).encode()) / 4294967296 * 0.08, "entity_at": i})
    return [line, *sorted(out, key=lambda x: -x["entity"])[: most - 1]]




def generate_lines(model, reservoir, c, count=8, attempts=128, seed="1337|q"):
    """MK-14 for one request."""
    draw, used, drafts = seeded_random(seed), {}, {}
    for i in range(attempts):
        tail = choose(reservoir, draw, c, used)
        if tail is None:
            break
        for line in reverse_beam(model, tail["tokens"], f"{seed}|{i}", c)[:2]:
            padded = [START] * model.order + line["tokens"]
            p = [model.probability("forward", padded[: model.order + j], t)[0] for j, t in enumerate([*line["tokens"], END])]
            row = {"p": p, "start": model.probability("reverse", line["prefix"], START)[0], "end": model.probability("forward", tail["tokens"], END)[0], "prefix_size": len(line["prefix"]), "context_mean": line["context_mean"], **{k: tail[k] for k in ("phonetic", "usage", "support")}}
            natural, utility = draft(row, c, model.order)
            key = " ".join(line["tokens"])
            if key not in drafts or drafts[key]["raw"] < utility:
                drafts[key] = {"tokens": line["tokens"], "form": tail["form"], "family": tail["family"], "raw": utility, "utility": round(utility, 6), "natural": round(natural, 6)}
        if len(drafts) >= 4 * count:
            break
    return diverse_drafts(list(drafts.values()), count, c.weirdness)
