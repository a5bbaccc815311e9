"""Byte-level BPE encoding and decoding (operator 3).

Texts are split into words by the vocabulary's pattern.  Each task gathers its documents into blocks of bounded size; a
block carries the distinct words that the task has not met before, as byte arrays, and for each the ranks of the merges
whose tokens it contains.  Spark higher-order functions fold the ranked merges over every such word by the vocabulary's
literal rank map: a word is a string with one mark (a code point) for each id, and the merge of rank k rewrites the marks
of its two parts as the mark of k.  The ids of the words then make up the ids of the documents.  Decoding concatenates the
binary pieces of the ids.

There is no shuffle: a block is built, folded and taken apart within one task, in order, so the work grows with the input
and a lost executor costs its own tasks only.  What a task remembers of words is forgotten after ``MAX_KNOWN`` of them.
The rank map depends on the vocabulary alone (at most 65,536 tokens, checked) and reaches the executors as a broadcast row
of arrays.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow
from .bpe_ranks import MergeFinder, RankTable, rank_table
from .tokenbin import WORDS, marked_words
from .wordcodes import gather, marked_codes, slices

#: Words (with repeats) and bytes of new distinct words after which a block is closed.
BLOCK_WORDS, BLOCK_BYTES = 300_000, 600_000
#: Distinct words after which a task begins anew.
MAX_KNOWN = 150_000
#: Documents and bytes of text whose words are held as arrays at once.
SLICE_DOCS, SLICE_BYTES = 500, 1_500_000
_BLOCK = "docs array<long>, lengths array<int>, codes binary, words array<struct<bytes:array<int>,merges:array<int>>>, known int, one int"


def mark(k: int) -> str:
    """The code point that stands for an id; surrogates are left out."""
    return chr(k + 1 if k + 1 < 0xD800 else k + 0x801)


def unmarked(text: bytes) -> np.ndarray:
    """The ids of marks, given as UTF-8."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    return (points - np.where(points < 0xD800, 1, 0x801)).astype(np.int32)


def rank_row(spark: SparkSession, table: RankTable) -> DataFrame:
    """The rank map as one row: marks of the bytes; by rank, the marks that are merged and the mark that they become."""
    text = pa.list_(pa.string())
    row = pa.table({"byte_marks": pa.array([[mark(i) for i in table.byte_ids]], text), "merged": pa.array([[mark(p[0]) + mark(p[1]) if p else "" for p in table.parts]], text),
                    "marks": pa.array([[mark(k) for k in range(len(table.tokens))]], text), "one": pa.array([1], pa.int32())})
    return spark.createDataFrame(row)


def fold_word(word: Column) -> Column:
    """Marks of the ids of a word (bytes, merges): its merges are applied in rank order, each to all its places from the left."""
    start = F.array_join(F.transform(word["bytes"], lambda b: F.get("byte_marks", b)), "")
    return F.aggregate(word["merges"], start, lambda s, k: F.replace(s, F.get("merged", k), F.get("marks", k)))


def _words_column(words: list[bytes], finder: MergeFinder) -> pa.StructArray:
    """Words as their bytes and the merges that they may need."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
    found = [finder.find(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    merges = np.concatenate([m for m, _ in found]) if found else np.zeros(0, np.int32)
    edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in found]))]) if found else [0]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]), pa.int32()), pa.array(raw)),
                                       pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(merges))], ["bytes", "merges"])


def _blocks(batches, tokens):
    """Batches of (doc_id, marked text, whole text) to rows of _BLOCK; codes number the distinct words of the task since it last began anew."""
    finder = MergeFinder(tokens)
    number, known, words, docs, lengths, codes, n_words, n_bytes = {}, 0, [], [], [], [], 0, 0
    wrap = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if kind else values)

    def row():
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([wrap(docs, pa.int64()), wrap(lengths, pa.int32()), pa.array([flat.astype("<i4").tobytes()]), wrap(_words_column(words, finder), None),
                                           pa.array([known], pa.int32()), pa.array([1], pa.int32())], ["docs", "lengths", "codes", "words", "known", "one"])

    for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
        distinct, own, starts = marked_codes(b.column(1), b.column(2), WORDS.findall)
        ids = b.column(0).to_pylist()
        size = np.diff(starts)
        begin = 0
        while begin < len(ids):  # rows of the batch that still fit; one at least
            room = BLOCK_WORDS - n_words
            end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + room, side="right")) - 1)
            piece = own[starts[begin] : starts[end]]
            map_to = np.zeros(len(distinct), np.int32)
            for u in np.flatnonzero(np.bincount(piece, minlength=len(distinct))).tolist():
                w = distinct[u]
                k = number.get(w)
                if k is None:
                    k = number[w] = len(number)
                    words.append(w.encode())
                    n_bytes += len(words[-1])
                map_to[u] = k
            codes.append(map_to[piece])
            docs += ids[begin:end]
            lengths += size[begin:end].tolist()
            n_words += len(piece)
            begin = end
            if n_words >= BLOCK_WORDS or n_bytes >= BLOCK_BYTES or begin < len(ids):
                yield row()
                if len(number) > MAX_KNOWN:
                    number = {}
                known, words, docs, lengths, codes, n_words, n_bytes = len(number), [], [], [], [], 0, 0
    if docs:
        yield row()


def fold_blocks(docs: DataFrame, table: RankTable) -> DataFrame:
    """Blocks of documents with the marks of the ids of their new words."""
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *marked_words(F.coalesce("text", F.lit(""))))
    tokens = table.tokens
    blocks = in_arrow(listed, lambda batches: _blocks(batches, tokens), _BLOCK).join(F.broadcast(rank_row(docs.sparkSession, table)), "one")
    return blocks.select("docs", "lengths", "codes", F.transform("words", fold_word).alias("folded"), "known")


def _encoded(batches):
    """(doc_ids, all their ids, where each document's begin) of the blocks, a hundred documents at a time."""
    flat, begin, size, met = np.zeros(4096, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def room(old: np.ndarray, n: int) -> np.ndarray:
        if n <= len(old):
            return old
        new = np.zeros(max(n, 2 * len(old)), old.dtype)
        new[: len(old)] = old
        return new

    for b in batches:
        for i in range(b.num_rows):
            folded, known = b.column(3)[i].values, b.column(4)[i].as_py()
            if known not in (0, met):
                raise ValueError("blocks of a task came out of order")
            used = int(begin[known - 1] + size[known - 1]) if known else 0
            own = pc.utf8_length(folded).to_numpy(zero_copy_only=False).astype(np.int64)
            n, total = len(own), int(own.sum())
            met = known + n
            flat, begin, size = room(flat, used + total), room(begin, known + n), room(size, known + n)
            if n:
                edges = np.frombuffer(folded.buffers()[1], "<i4")[folded.offset : folded.offset + n + 1]
                flat[used : used + total] = unmarked(folded.buffers()[2][int(edges[0]) : int(edges[-1])].to_pybytes())
            size[known : known + n] = own
            begin[known : known + n] = used + np.cumsum(own) - own
            docs, lengths = b.column(0)[i].values.to_pylist(), b.column(1)[i].values.to_numpy().astype(np.int64)
            codes, words = np.frombuffer(b.column(2)[i].as_py(), dtype="<i4"), np.concatenate([[0], np.cumsum(lengths)])
            for k in range(0, len(docs), 100):
                end = min(len(docs), k + 100)
                part = codes[words[k] : words[end]]
                past = np.concatenate([[0], np.cumsum(size[part])])
                yield docs[k:end], gather(flat, begin, size, part), past[words[k : end + 1] - words[k]]


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""
    table = rank_table(ranks_path)

    def run(batches):
        for doc_ids, ids, starts in _encoded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return in_arrow(fold_blocks(docs, table), run, "doc_id long, ids array<int>")


def pieces(ranks_path: str) -> tuple[bytes, ...]:
    return rank_table(ranks_path).tokens


def decode_ids(ids: list[int], tokens) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and bytes (binary): the pieces of the ids, joined."""
    tokens = pieces(ranks_path)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x or [], tokens) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _listed(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    flat = ids.tolist()
    return [flat[i:j] for i, j in zip(starts.tolist(), starts[1:].tolist())]


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of what they decode to."""
    table = rank_table(ranks_path)
    tokens = table.tokens

    def run(batches):
        digits = [str(i) for i in range(len(tokens))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_ids, flat, starts in _encoded(batches):
            rows = [(len(x), sha(" ".join(map(digits.__getitem__, x)).encode()), sha(decode_ids(x, tokens))) for x in _listed(flat, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(fold_blocks(docs, table), run, DIGEST)


CHECKED = "doc_id long, ids array<int>, n_tokens long, text_sha256 string"


def encode_with_check(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the decoded bytes of every document."""
    table = rank_table(ranks_path)
    tokens = table.tokens

    def run(batches):
        for doc_ids, flat, starts in _encoded(batches):
            digests = [hashlib.sha256(decode_ids(x, tokens)).hexdigest() for x in _listed(flat, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(starts), pa.int64()), pa.array(digests, pa.string())],
                                             ["doc_id", "ids", "n_tokens", "text_sha256"])

    return in_arrow(fold_blocks(docs, table), run, CHECKED)
