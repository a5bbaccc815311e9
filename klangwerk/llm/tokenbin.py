"""Token ids in bit-plane files (operator 1).

Texts are encoded with a given tokenizer, an end id is appended to each, and all ids are written in ascending doc_id
order.  A file is a run of blocks of ``BLOCK`` ids.  Each block is transposed into bit planes (plane k holds bit k of
every id), each plane is compressed with zstandard by itself, and the chunk index records where each block's planes lie.
High planes are nearly constant and compress to almost nothing; a reader may fetch any block alone.

    file  = "BPT1", then per block its planes, lowest bit first
    index = Parquet, a row per file: name, part, ids, chunks (offset, ids, plane lengths), docs (doc_id, begin, ids)

Documents are range-partitioned by (doc_id, checksum), so one task owns one range and writes one file; files get a fresh
name per attempt and only those named in the committed index count, so retried or speculative tasks do no harm.  Files
lie in the session's shared folder.  Words are encoded once per task and distinct word: byte-level BPE never merges across
the words of its pattern.

Defined cases: a null or empty text holds the end id alone; the string of an added token becomes its id, as in the library; null doc_ids come first; repeated rows are each written;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, settle, work_path
from .wordcodes import MARK, gather, marked_codes, slices

MAGIC = b"BPT1"
BLOCK = 1 << 16
#: Documents and bytes of text that are encoded at once, and distinct words after which a task begins anew.
SLICE_DOCS, SLICE_BYTES, MAX_KNOWN = 1000, 4_000_000, 400_000
#: The pattern by which the tokenizer's own pre-tokenizer splits a text, with white space as Unicode has it.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for the texts that are split in Python.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def marked_words(text: Column) -> tuple[Column, Column]:
    """A text with a mark after each of its words, and null; or null and the text, if it holds the mark itself.

    One string costs less on its way to Python than a list of words."""
    odd = text.contains(MARK)
    return F.when(~odd, F.regexp_replace(text, WORD, "$0" + MARK)).alias("marked"), F.when(odd, text).alias("whole")


INDEX = ("file string, part long, n_ids long, chunks array<struct<begin:long,n:int,planes:array<int>>>, "
         "docs array<struct<doc_id:long,begin:long,n:int>>")


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Compressed bit planes of one block."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.packbits((ids >> k & 1).astype(np.uint8)).tobytes()) for k in range(max(1, int(ids.max(initial=0)).bit_length()))]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out, unpack = np.zeros(n, dtype="<u4"), zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(unpack.decompress(plane), dtype=np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


def byte_letters() -> dict[int, str]:
    """The letter by which the vocabulary file writes each byte: printable ones stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of words, kept as one flat array; new words go through the BPE model of the tokenizers library.

    A word is what the tokenizer's pre-tokenizer would hand to its model.  Texts that come whole are encoded by the library
    as they are: those with the string of an added token, which it cuts out before it looks for words, or with the mark."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.known: dict[str, int] = {}
        self.begin, self.length, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _room(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(max(n, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def add(self, words: list[str]) -> np.ndarray:
        """Codes of the words in self.begin and self.length."""
        tokenize, letters, known = self.model.tokenize, self.letters, self.known
        ids, lengths, fresh = [], [], [w for w in words if w not in known]
        for w in fresh:
            before = len(ids)
            ids += [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]
            lengths.append(len(ids) - before)
        k, total, size = len(known), len(ids), np.array(lengths, np.int64)
        self._room("flat", self.used + total)[self.used : self.used + total] = np.array(ids, np.uint32)
        self._room("length", k + len(size))[k : k + len(size)] = size
        self._room("begin", k + len(size))[k : k + len(size)] = self.used + np.cumsum(size) - size
        self.used += total
        known.update(zip(fresh, range(k, k + len(fresh))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, marked: pa.Array, whole: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by end_id, and the number of ids of each."""
        distinct, codes, starts = marked_codes(marked, whole, lambda text: [])
        if len(self.known) > MAX_KNOWN:  # bounds a task's memory; words are simply encoded again
            self.known, self.used = {}, 0
        codes = self.add(distinct)[codes] if len(codes) else codes.astype(np.int64)
        ids = gather(self.flat, self.begin, self.length, codes)
        past = np.concatenate([[0], np.cumsum(self.length[codes])])[starts]
        out, lengths = np.insert(ids, past[1:], np.uint32(end_id)) if len(past) > 1 else ids, np.diff(past) + 1
        if whole.null_count < len(whole):
            rows = np.split(out, np.cumsum(lengths)[:-1])
            for i, text in enumerate(whole.to_pylist()):
                if text is not None:
                    rows[i] = np.array([*self.whole.encode(text, add_special_tokens=False).ids, end_id], np.uint32)
            out, lengths = np.concatenate(rows), np.array(list(map(len, rows)), np.int64)
        return out, lengths


def added_tokens(tokenizer_path: str) -> list[str]:
    """The strings that the tokenizer takes as one token wherever they stand."""
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, level: int = 3) -> DataFrame:
    """Writes the files and returns their committed index."""
    spark = docs.sparkSession
    folder = work_path(spark, "ids")
    text = F.coalesce("text", F.lit(""))
    marked, whole = marked_words(F.col("text"))
    special = reduce(or_, (F.contains(F.col("text"), F.lit(t)) for t in added_tokens(tokenizer_path)), F.lit(False))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
               .repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
               .select("doc_id", F.when(~special, marked).alias("marked"), F.when(special, F.col("text")).otherwise(whole).alias("whole")))

    def run(batches):
        from pyarrow import fs

        encoder, store, path = WordIds(tokenizer_path), *fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bpt"
        out, at, kept, total, chunks, rows = None, len(MAGIC), np.zeros(0, np.uint32), 0, [], []

        def put(ids):
            nonlocal at
            planes = to_planes(ids, level)
            out.write(b"".join(planes))
            chunks.append({"begin": at, "n": len(ids), "planes": list(map(len, planes))})
            at += sum(map(len, planes))

        for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            if out is None:
                store.create_dir(path)
                out = store.open_output_stream(f"{path}/{name}")
                out.write(MAGIC)
            ids, lengths = encoder.encode(b.column(1), b.column(2), end_id)
            rows.append((b.column(0).to_pylist(), total + np.cumsum(lengths) - lengths, lengths))
            total += len(ids)
            kept = np.concatenate([kept, ids])
            full = len(kept) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                put(kept[i : i + BLOCK])
            kept = kept[full:]
        if out is None:
            return
        if len(kept):
            put(kept)
        out.close()
        listed = [{"doc_id": d, "begin": int(x), "n": int(n)} for ids, begin, lengths in rows for d, x, n in zip(ids, begin, lengths)]
        schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_ids", pa.int64()),
                            ("chunks", pa.list_(pa.struct([("begin", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.int32()))]))),
                            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("begin", pa.int64()), ("n", pa.int32())])))])
        yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": part, "n_ids": total, "chunks": chunks, "docs": listed}], schema)

    return settle(in_arrow(ordered, run, INDEX), "index")


def read_ids(uri: str, chunks: list[dict], docs: list[dict]):
    """The ids of each document of one file, in order; one block and one document are held at a time."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    held, at = np.zeros(0, "<u4"), 0  # ids from place at on
    with store.open_input_file(path) as f:
        blocks = iter(chunks)
        for d in docs:
            begin, end = d["begin"], d["begin"] + d["n"]
            parts = [held[begin - at :]] if len(held) else []
            have = at + len(held)
            at = begin
            while have < end:
                c = next(blocks)
                f.seek(c["begin"])
                parts.append(from_planes([f.read(n) for n in c["planes"]], c["n"]))
                have += c["n"]
            held = np.concatenate(parts) if len(parts) != 1 else parts[0]
            yield held[: d["n"]]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    spark = index.sparkSession
    total, bases = 0, []
    for part, n in index.select("part", "n_ids").orderBy("part").collect():  # a row per file
        bases.append((part, total))
        total += n
    based = index.join(spark.createDataFrame(bases, "part long, base long"), "part")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = [(d["doc_id"], r["base"] + d["begin"], d["n"], zlib.crc32(ids.tobytes())) for d, ids in zip(r["docs"], read_ids(r["file"], r["chunks"], r["docs"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file, however few tasks the index itself would be read in
    return in_arrow(based.select("file", "chunks", "docs", "base").repartition(max(1, len(bases))), run, READ)


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    return read_back(write_ids(docs, tokenizer_path, end_id))
