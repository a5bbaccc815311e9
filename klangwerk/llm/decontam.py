"""Benchmark decontamination by SimHash of item-sized windows (operator 7).

Every benchmark item gets a 64-bit SimHash of its five-word shingles (weight: number of occurrences), and every document
the SimHashes of windows as long as the items, at every ``STRIDE``-th word.  Window lengths are the items' lengths,
rounded to a multiple of the stride.  An index of the items' fingerprints by Hamming blocks finds, for each window, all items
within ``RADIUS`` bits: two fingerprints at most RADIUS bits apart differ in at most RADIUS // BLOCKS bits of one of
BLOCKS blocks, and each block's table lists the items for every block value within that distance.  Candidates that lie
within the radius are verified exactly: the weighted Jaccard similarity (sum of minima over sum of maxima of shingle
counts) of the item and the best-aligned window of the item's length near the hit must reach ``MIN_SIMILARITY``.

A fingerprint of few shingles says little, so items of up to ``LOOKED_UP`` shingles are not fingerprinted: every shingle
of the documents is looked up among theirs, and each window of the item's exact length, at every word, that holds enough
of them is verified.  For these items all windows that reach MIN_SIMILARITY are found.

The benchmark is sent to the tasks in blocks of ``ITEMS_PER_PASS`` items, so what is broadcast has a fixed bound however
large the benchmark is.  One pass over the documents per block and no shuffle; no row meets another row.

Defined cases: words are lower-cased A-Z between ASCII white space; null or blank texts and items match nothing; texts or
items of fewer than five words count as one shingle; repeated rows match alike, those of one item_id as one item; each
row with a null item_id is an item of its own, with a null item_id in the result; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, settle, small_side, unused
from .wordcodes import gather, hashed_words, slices

SHINGLE = 5
MIN_SIMILARITY = 0.75
RADIUS = 16  # bits of 64
BLOCKS = 4
STRIDE = 4  # words between windows
LOOKED_UP = 24  # shingles of an item up to which its own shingles are looked up
ITEMS_PER_PASS = 4096
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)

MATCHES = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def shingle_hashes(h: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of the five (or fewer) words that begin at each place, mixed so that every bit counts."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        k = min(words, len(h))
        n = len(h) - k + 1
        x = np.zeros(n, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + n]) * _K[i]
            x ^= x >> np.uint64(29)
        x ^= x >> np.uint64(32)
        x *= _K[4]
        return x ^ (x >> np.uint64(29))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1)


def simhash(x: np.ndarray) -> int:
    """Of shingle hashes with repeats: a bit is set where more than half of them have it."""
    return int.from_bytes(np.packbits(2 * _bits(x).sum(axis=0, dtype=np.int64) > len(x)).tobytes(), "big")


def similarity(a: np.ndarray, b: Counter) -> float:
    """Weighted Jaccard of shingle hashes (an array) and counts."""
    own = Counter(a.tolist())
    low = sum(min(n, b.get(k, 0)) for k, n in own.items())
    return low / (len(a) + sum(b.values()) - low)


def window_length(n: int) -> int:
    """The window length, in shingles, that stands for items of n shingles: a multiple of STRIDE within some 8 % of n."""
    step = STRIDE
    while step * 12 < n:
        step *= 2
    return max(STRIDE, round(n / step) * step)


class HammingIndex:
    """Items by the values of BLOCKS blocks of their fingerprints; finds all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        width = 64 // BLOCKS
        flips = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)], np.int64)
        self.tables = np.zeros(((len(prints) + 63) // 64, BLOCKS, 1 << width), np.uint64)
        for i, own in enumerate(prints.view(f"<u{width // 8}").reshape(-1, BLOCKS).astype(np.int64)):
            for block, value in enumerate(own):
                self.tables[i // 64, block, value ^ flips] |= np.uint64(1 << (i % 64))

    def within(self, windows: np.ndarray):
        """(windows, item) for each item that has any within the radius."""
        blocks = windows.view(f"<u{8 // BLOCKS}").reshape(-1, BLOCKS)
        for column, table in enumerate(self.tables):
            found = table[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                found |= table[b][blocks[:, b]]
            some = np.flatnonzero(found)
            found = found[some]
            for bit in range(min(64, len(self.prints) - 64 * column)):
                w = some[(found >> np.uint64(bit) & np.uint64(1)).astype(bool)]
                w = w[np.bitwise_count(windows[w] ^ self.prints[64 * column + bit]) <= RADIUS]
                if len(w):
                    yield w, 64 * column + bit


class ShingleLookup:
    """The shingles of short items (id, shingle hashes); finds every window of an item's length that is similar enough."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(item, Counter(x.tolist()), len(x)) for item, x in items]
        pairs = sorted((k, i) for i, (_, counts, _) in enumerate(self.items) for k in counts)
        self.keys, self.begin = np.unique(np.array([k for k, _ in pairs], np.uint64), return_index=True)
        self.begin = np.append(self.begin, len(pairs))
        self.owners = np.array([i for _, i in pairs], np.int64)
        self.maybe = np.zeros(1 << 20, bool)  # by low bits: most shingles of the documents end here
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _hits(self, x: np.ndarray):
        """(item number, places in order) of the items of which any shingle stands in x."""
        at = np.flatnonzero(self.maybe[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        same = self.keys[key] == x[at]
        at, key = at[same], key[same]
        n = self.begin[key + 1] - self.begin[key]
        owner = gather(self.owners, self.begin[:-1], np.diff(self.begin), key)
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], np.repeat(at, n)[order]
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            if len(part):
                yield int(owner[part[0]]), at[part]

    def windows(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(row, item, similarity, first word, words) of each similar window."""
        for i, at in self._hits(x):
            item, counts, n = self.items[i]
            least = int(np.ceil(MIN_SIMILARITY * n))  # similar windows hold so many hits, also where the text is shorter
            for j in np.flatnonzero(at[least - 1 :] - at[: max(0, len(at) - least + 1)] < n).tolist():
                row = int(np.searchsorted(starts, at[j], side="right")) - 1
                lo, end = int(starts[row]), int(ends[row]) - SHINGLE + 1
                before = int(at[j - 1]) if j else -1
                if end - lo < n:
                    places = [lo] if before < lo else []
                else:  # those whose first hit is this one
                    places = range(max(lo, before + 1, int(at[j + least - 1]) - n + 1), min(end - n, int(at[j])) + 1)
                for p in places:
                    stop = min(p + n, end)
                    if stop > p and (alike := similarity(x[p:stop], counts)) >= MIN_SIMILARITY:
                        yield row, item, alike, p - lo, stop - p + SHINGLE - 1


def aligned(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with gaps between the texts, so that each text begins at a multiple of STRIDE and the windows inside it are the
    same in whatever company it comes; where the texts begin and end."""
    n = np.diff(starts)
    begin = np.concatenate([[0], np.cumsum(-(-n // STRIDE) * STRIDE)])
    out = np.zeros(int(begin[-1]), np.uint64)
    out[np.arange(len(h)) + np.repeat(begin[:-1] - starts[:-1], n)] = h
    return out, begin, begin[:-1] + n


class Items:
    """A block of benchmark items, by window length."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, starts = hashed_words(pa.array(texts, pa.string()))
        self.short, looked_up, grouped = defaultdict(list), [], defaultdict(list)  # by number of words; any; by window length
        first = {}
        for i, name in enumerate(ids):
            item = i if name is None else first.setdefault(name, i)  # rows of one id are one item
            own = h[starts[i] : starts[i + 1]]
            if not len(own):
                continue
            x = shingle_hashes(own)
            if len(own) < SHINGLE:
                self.short[len(own)].append((item, x[0]))
            elif len(x) <= LOOKED_UP:
                looked_up.append((item, x))
            else:
                grouped[window_length(len(x))].append((item, x))
        self.looked_up = ShingleLookup(looked_up) if looked_up else None
        self.classes = {w: (HammingIndex(np.array([simhash(x) for _, x in own], np.uint64)), [(i, Counter(x.tolist()), len(x)) for i, x in own]) for w, own in grouped.items()}

    def matches(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, place of the item in ids) to (similarity, first word, words) of the best window."""
        h, starts, ends = aligned(*hashed_words(texts))
        best = {}

        def put(row, item, found):
            if found > best.get((row, item), (0.0,)):
                best[row, item] = found

        for k, items in self.short.items():
            if len(h) >= k:
                grams = shingle_hashes(h, k)
                for item, x in items:
                    for at in np.flatnonzero(grams == x).tolist():
                        row = int(np.searchsorted(starts, at, side="right")) - 1
                        if at + k <= ends[row]:
                            put(row, item, (1.0, -(at - int(starts[row])), k))
        if len(h) < SHINGLE:
            return best
        x = shingle_hashes(h)
        if self.looked_up:
            for row, item, alike, first, n in self.looked_up.windows(x, starts, ends):
                put(row, item, (alike, -first, n))
        if not self.classes:
            return best
        whole = -(-len(x) // STRIDE) * STRIDE
        bits = np.zeros((whole, 64), np.uint8)
        bits[: len(x)] = _bits(x)
        width = np.uint16 if max(self.classes) < 1 << 16 else np.uint32
        sums = np.zeros((whole // STRIDE + 1, 64), width)  # wraps; differences are at most the longest window
        np.cumsum(bits.reshape(-1, STRIDE, 64).sum(axis=1, dtype=width), axis=0, dtype=width, out=sums[1:])
        del bits
        for w, (index, items) in self.classes.items():
            k = min(w // STRIDE, len(sums) - 1)
            prints = np.packbits(sums[k:] - sums[:-k] > w // 2, axis=1).view(">u8").astype(np.uint64).ravel()
            for windows, i in index.within(prints):
                item, counts, n = items[i]
                for s in (windows * STRIDE).tolist():
                    row = int(np.searchsorted(starts, min(s + w // 2, len(h) - 1), side="right")) - 1
                    lo, stop = int(starts[row]), int(ends[row]) - SHINGLE + 1
                    last = max(lo, min(stop - n, s + STRIDE + max(0, w - n)))  # places where the item's length fits
                    first = max(lo, s - STRIDE)
                    # a similar window holds at least so many of the item's shingles, with repeats
                    if sum(k in counts for k in x[first : min(last + n, stop)].tolist()) < MIN_SIMILARITY * n:
                        continue
                    for at in range(first, last + 1):
                        end = min(at + n, stop)
                        if end > at and (alike := similarity(x[at:end], counts)) >= MIN_SIMILARITY:
                            put(row, item, (alike, -(at - lo), end - at + SHINGLE - 1))
        return best


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item found in it: place and length (words) of the best window, and its similarity."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one_pass(rows) -> DataFrame:
        ids, items_texts = [r[0] for r in rows], [r[1] for r in rows]

        def run(batches):
            items = Items(ids, items_texts)
            for part in slices(batches, 1, 300, 1_000_000):  # bounds the bit sums held at once
                found = items.matches(part.column(1))
                if found:
                    doc_ids = part.column(0).to_pylist()
                    rows = ((doc_ids[row], ids[item], -at, n, alike) for (row, item), (alike, at, n) in sorted(found.items()))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return in_arrow(texts, run, MATCHES)

    out, rows = None, []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == ITEMS_PER_PASS:
            out, rows = one_pass(rows) if out is None else out.unionByName(one_pass(rows)), []
    if rows:
        out = one_pass(rows) if out is None else out.unionByName(one_pass(rows))
    return out if out is not None else spark.createDataFrame([], MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items and best similarity of the documents in which an item was found."""
    return find_matches(docs, benchmark).groupBy("doc_id").agg((F.countDistinct("item_id") + F.count_if(F.col("item_id").isNull())).alias("n_items"), F.max("similarity").alias("similarity"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no item was found."""
    (name,) = unused(docs, "_found")
    found = settle(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)), "contaminated")
    return docs.join(small_side(found), docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")
