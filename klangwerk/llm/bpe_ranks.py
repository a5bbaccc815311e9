"""Merges of a byte-level BPE vocabulary, and which of them a word can need.

Every token of several bytes is made by one merge: of the two parts into which the merges ranked before it bring its
bytes.  Applied to a word in rank order, each once and to all its places from the left, the merges give the word's
tokens: a part always ranks before what it is part of, so no merge can become possible again after its turn.  A word can
need only merges of tokens that it contains.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_TOKENS = 1 << 16


@dataclass(frozen=True)
class RankTable:
    tokens: tuple[bytes, ...]  # by id, which is the rank
    byte_ids: tuple[int, ...]  # id of each single byte
    parts: tuple[tuple[int, int] | None, ...]  # by id: the two ids that are merged
    longest: int  # bytes


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _two_parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while True:
        best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
        if best[0] >= rank:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {rank} is not made by one merge")
    return ranks[parts[0]], ranks[parts[1]]


@lru_cache(maxsize=4)
def rank_table(path: str) -> RankTable:
    ranks = read_ranks(path)
    if len(ranks) > MAX_TOKENS or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1 with n at most 65536")
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    parts = tuple(_two_parts(t, k, ranks) if len(t) > 1 else None for k, t in enumerate(tokens))
    return RankTable(tuple(tokens), tuple(ranks[bytes([i])] for i in range(256)), parts, max(map(len, tokens)))


def _hashes(letters: np.ndarray) -> np.ndarray:
    h = np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(letters.shape[1]):
            h = (h + letters[:, i] + np.uint64(1)) * _BASE
    return h


class MergeFinder:
    """Which tokens of several bytes a word contains, for many words at once."""

    def __init__(self, tokens):
        by_length: dict[int, list[int]] = {}
        for k, t in enumerate(tokens):
            if len(t) > 1:
                by_length.setdefault(len(t), []).append(k)
        hashes, ids = [], []
        for n, own in by_length.items():
            hashes.append(_hashes(np.frombuffer(b"".join(tokens[k] for k in own), np.uint8).reshape(-1, n).astype(np.uint64)))
            ids += own
        flat = np.concatenate(hashes)
        order = np.argsort(flat)
        self.hashes, self.ids, self.longest = flat[order], np.array(ids)[order], max(by_length)
        self.maybe = np.zeros(1 << 20, bool)  # by high bits: most substrings end here
        self.maybe[(flat >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the merges that each word may need, ascending and once each, flat; and where each word's begin.

        Substrings of one length are hashed together over all words, each from the one that is a byte shorter."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(words)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))  # bytes from here to the word's end
        place, keys = np.arange(len(letters)), []
        with np.errstate(over="ignore"):
            h = letters * _BASE
            for n in range(2, self.longest + 1):
                open_ = left[place] >= n
                place = place[open_]
                if not len(place):
                    break
                h = (h[open_] + letters[place + (n - 1)]) * _BASE
                some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                same = self.hashes[at] == h[some]
                keys.append(owner[place[some[same]]] * MAX_TOKENS + self.ids[at[same]])
        flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        flat = flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat
        return (flat % MAX_TOKENS).astype(np.int32), np.searchsorted(flat, np.arange(len(words) + 1) * MAX_TOKENS)
