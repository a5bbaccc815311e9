"""Cross-tokenizer alignment (operator 12).

Each text, with a space before it, is encoded by a byte-level BPE tokenizer (A) and by a sentence piece model (B); both
token sequences tile the same bytes.  The ends of both are united (``union1d``) into elementary intervals, ``searchsorted``
finds the owners of each interval, every interval is one overlap of an A and a B token, and an end that both share closes a
group.  The product of a group's A and B tokens holds the token pairs that may stand for each other; the pair of its last
tokens, which end together, is its link.

No token of either side crosses a space that follows a character which is no white space, so texts fall into chunks there:
a chunk is encoded and aligned once per task, and a text's groups are those of its chunks in a row.  The model is asked for
this (no piece holds a space after another character) when it is loaded; else the chunk is the text.

The corpus-wide counts of linked id pairs come from the pairs of each text, settled once; a table of pairs is broadcast only
when counted to be small, otherwise pairs in so many rows that only a bounded number of them can exist are broadcast and the
rest meet in a shuffle join.

Defined cases: null or empty texts and those whose tokens do not spell the text (U+2581 stands for a space in B) have no
tokens: zeros and ''; repeated rows are counted each; very long texts are taken whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, settle
from .tokenbin import byte_letters
from .wordcodes import gather, slices

#: Documents and bytes of text that are aligned at once, and distinct chunks after which a task begins anew.
SLICE_DOCS, SLICE_BYTES, MAX_KNOWN = 1000, 2_000_000, 200_000
#: Chunks that go to the tokenizers at once; their results are large while they are held.
ENCODED = 8192
#: Pairs of ids up to which their counts are broadcast; beyond it only pairs in more than 1 / MAX_BROADCAST_PAIRS of all rows.
MAX_BROADCAST_PAIRS = 500_000
SPACE = "▁"


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        self.by_chunk = self.b_bytes[self.space] == b" " and not any(p != SPACE and q == SPACE for piece in pieces for p, q in zip(piece, piece[1:]))
        self.a_size, self.b_size = (np.array([len(x) for x in each], np.int64) for each in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space; B adds that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids or [self.space] for ids in b]  # B has nothing for the space alone

    def spell(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole


def elementary(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, their A and B owners, and whether both owners end there."""
    ends = np.union1d(a_end, b_end)
    a, b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return ends, a, b, (a_end[a] == ends) & (b_end[b] == ends)


def chunks_of(texts: pa.Array, whole: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the code of every chunk in order, and where each text's begin."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    cut = np.flatnonzero(data[ends[0] + 3 :] == 32) + ends[0] + 3 if not whole else np.zeros(0, np.int64)
    z, y, x = data[cut - 1], data[cut - 2], data[cut - 3]
    # fixed values: white space beyond ASCII, in UTF-8
    wide = ((y == 0xC2) & ((z == 0x85) | (z == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | (
        (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F))))
    edge = np.zeros(ends[-1] + 1, bool)
    edge[ends], edge[cut[(z > 32) & ~wide]] = True, True
    offsets = np.flatnonzero(edge)
    flat = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), texts.buffers()[2] or pa.py_buffer(b""))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(offsets, ends)


class Chunks:
    """What is known of chunks: numbers of tokens and groups, the groups written out, the linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.a_name, self.b_name = (list(map(str, range(len(x)))) for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.groups: list[str] = []
        self.pair: dict[int, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, whether the tokens spell something else
        self.begin, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, chunks: list[str]) -> np.ndarray:
        """Codes of the chunks."""
        if len(self.code) > MAX_KNOWN:  # bounds a task's memory; chunks are simply aligned again
            self.reset()
        new = [c for c in chunks if c not in self.code]
        if new:
            for i in range(0, len(new), ENCODED):
                self._learn(new[i : i + ENCODED])
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        return np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))

    def _learn(self, new: list[str]) -> None:
        t = self.tokenizers
        a_ids, b_ids = t.encode(new)
        good = np.fromiter(map(t.spell, new, a_ids, b_ids), bool, len(new))
        counts = np.zeros((len(new), 4), np.int64)
        counts[:, 3] = ~good
        kept = np.flatnonzero(good)
        a_ids, b_ids = [a_ids[i] for i in kept], [b_ids[i] for i in kept]
        counts[kept, 0], counts[kept, 1] = [len(x) for x in a_ids], [len(x) for x in b_ids]
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        _, a_own, b_own, shared = elementary(a_end, b_end)
        a_last, b_last = a_own[shared], b_own[shared]  # each group's last tokens
        # a chunk ends where both end, so its groups are those up to its last A token
        past = np.concatenate([[0], np.searchsorted(a_last, np.cumsum(counts[kept, 0]) - 1, side="right")]).astype(np.int64)
        counts[kept, 2] = np.diff(past)
        a_text, b_text = [self.a_name[i] for i in a.tolist()], [self.b_name[i] for i in b.tolist()]
        a_to, b_to = (a_last + 1).tolist(), (b_last + 1).tolist()
        shown = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        edges = past.tolist()
        groups = [""] * len(new)
        for n, i in enumerate(kept.tolist()):
            groups[i] = ";".join(shown[edges[n] : edges[n + 1]])
        number = self.pair
        links = [number.setdefault(p, len(number)) for p in (a[a_last] << 32 | b[b_last]).tolist()]
        self.groups += groups
        self.begin = np.concatenate([self.begin, len(self.links) + np.cumsum(counts[:, 2]) - counts[:, 2]])
        self.links = np.concatenate([self.links, np.array(links, np.int64)])
        self.counts = np.concatenate([self.counts, counts])


ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<struct<pair:long,n:long>>"


def spaced(text: Column) -> Column:
    """The text with a space before it; null if there is none."""
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), text))


def align_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its numbers of tokens and groups, the digest of its groups, and its linked pairs with their numbers."""

    def run(batches):
        tokenizers = Tokenizers(a_path, b_path)
        known = Chunks(tokenizers)
        for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            distinct, codes, starts = chunks_of(b.column(1), whole=not tokenizers.by_chunk)
            code = known.add(distinct.to_pylist())[codes] if len(codes) else codes.astype(np.int64)
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(known.counts[code], axis=0)])[starts]
            n_a, n_b, n_groups, bad = np.diff(sums, axis=0).T
            good = (bad == 0) & (np.diff(starts) > 0)
            n_a, n_b, n_links = n_a * good, n_b * good, n_groups * good
            listed, edges, groups = code.tolist(), starts.tolist(), known.groups
            digests = [hashlib.sha256(";".join([groups[c] for c in listed[edges[i] : edges[i + 1]]]).encode()).hexdigest() if g else "" for i, g in enumerate(good.tolist())]
            used = code[np.repeat(good, np.diff(starts))]
            links = gather(known.links, known.begin, known.counts[:, 2], used) if len(used) else used
            width = max(1, len(known.pair))
            keys, n = np.unique(np.repeat(np.arange(b.num_rows), n_links) * width + links, return_counts=True)
            names = np.fromiter(known.pair, np.int64, len(known.pair))  # in order of their numbers
            per_row = np.searchsorted(keys, np.arange(b.num_rows + 1) * width)
            pairs = pa.StructArray.from_arrays([pa.array(names[keys % width] if len(keys) else keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_links)), pa.array(digests, pa.string()),
                                              pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pairs)], ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return in_arrow(read, run, ALIGNED)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair, n_links, n_rows of all linked id pairs, and whether no other pair of that B id has more links."""
    own = aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("n_links"), F.count("*").alias("n_rows"))
    own = settle(own, "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))  # as many values as B has ids
    most = own.groupBy(b.alias("b")).agg(F.max("n_links").alias("most"))
    return own.join(F.broadcast(most), b == F.col("b")).select("pair", "n_links", "n_rows", (F.col("n_links") == F.col("most")).alias("best"))


def with_counts(own: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """own (row, pair, n) with n_links and best of each pair."""
    most = most or MAX_BROADCAST_PAIRS
    if pairs.count() <= most:
        return own.join(F.broadcast(pairs.drop("n_rows")), "pair")
    total = pairs.agg(F.sum("n_rows")).first()[0]
    hot = F.col("n_rows") * most >= total  # at most `most` pairs
    first = own.join(F.broadcast(pairs.where(hot).drop("n_rows")), "pair", "left")
    rest = first.where(F.col("best").isNull()).drop("n_links", "best").join(pairs.where(~hot).drop("n_rows"), "pair")
    return first.where(F.col("best").isNotNull()).unionByName(rest)


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    aligned = settle(align_digests(docs, a_path, b_path), "aligned")
    pairs = settle(count_pairs(aligned), "counts")
    own = aligned.select("row", F.inline("pairs"))
    sums = with_counts(own, pairs).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


TOKENS = ("a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int,begin:long,end:long>>, "
          "groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int,begin:long,end:long>>")


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id with the ids of both sides, all overlaps and all groups; places count tokens from 0, bytes from the added space, ends exclusive."""

    def run(batches):
        t = Tokenizers(a_path, b_path)
        for batch in slices(batches, 1, 100, SLICE_BYTES):
            rows = []
            for text in batch.column(1).to_pylist():
                a, b = (x[0] for x in t.encode([text])) if text else ([], [])
                if not text or not t.spell(text, a, b):
                    rows.append({"a_ids": [], "b_ids": [], "overlaps": [], "groups": []})
                    continue
                ends, a_own, b_own, shared = elementary(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
                close = np.flatnonzero(shared)
                last = lambda own: np.concatenate([[0], own[close] + 1]).tolist()
                at, a_at, b_at = [0, *ends[close].tolist()], last(a_own), last(b_own)
                rows.append({"a_ids": a, "b_ids": b,
                             "overlaps": [dict(zip(("a", "b", "begin", "end"), x)) for x in zip(a_own.tolist(), b_own.tolist(), [0, *ends.tolist()], ends.tolist())],
                             "groups": [dict(zip(("a_from", "a_to", "b_from", "b_to", "begin", "end"), x)) for x in zip(a_at, a_at[1:], b_at, b_at[1:], at, at[1:])]})
            made = pa.array(rows, pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                                             ("overlaps", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))),
                                             ("groups", pa.list_(pa.struct([(x, pa.int32()) for x in ("a_from", "a_to", "b_from", "b_to")] + [("begin", pa.int64()), ("end", pa.int64())])))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.flatten()], ["doc_id", "a_ids", "b_ids", "overlaps", "groups"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("text")), run, "doc_id long, " + TOKENS)


def products(tokens: DataFrame) -> DataFrame:
    """doc_id, group, a_at, b_at: the product of the A and B tokens of every group of align_tokens."""
    groups = tokens.select("doc_id", F.posexplode("groups").alias("group", "g"))
    each = groups.select("doc_id", "group", "g", F.explode(F.sequence(F.col("g.a_from"), F.col("g.a_to") - 1)).alias("a_at"))
    return each.select("doc_id", "group", "a_at", F.explode(F.sequence(F.col("g.b_from"), F.col("g.b_to") - 1)).alias("b_at"))
