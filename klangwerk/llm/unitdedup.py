"""Line or paragraph deduplication by digests (operator 5).

Every line, cut further at sentence ends (or every whole line, or every paragraph), is normalised - lower case, digits to
0, punctuation and white space runs to one space - and hashed to 128 bits.  Digests are grouped over the whole corpus;
the earliest occurrence by (doc_id, checksum, place) stays.  Single units are often common phrases, so only passages
count: runs of consecutive repeated units with ``min_words`` words or more.  In them all later occurrences are marked for
removal, with their offsets in the original text.

The texts are read once; digests, offsets and word counts go to a table in the shared folder and only these are shuffled.
The earliest occurrence is a minimum with map-side combining, so a line that stands in a third of all documents costs
one row per task; digests found once end there.  The join back is a plain equi-join that adaptive execution can split.

Defined cases: a null or empty text has no units and loses nothing; units without a letter or digit are passed over, they
neither end a run nor count; rows that repeat both doc_id and text are one document and each gets its result; a null
doc_id ranks first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, settle, unused
from .wordcodes import slices

#: Words of a passage.  A copied passage of 50 words keeps that many in whole sentences wherever it begins and ends.
MIN_WORDS = 30
#: Where units end, the separator included.
CUTS = {"sentence": r"\n|[.!?…] ", "line": r"\n", "paragraph": r"\n\n"}
SLICE_DOCS, SLICE_BYTES = 1000, 4_000_000
_NOISE = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d")

UNITS = "doc_id long, text_hash long, units array<struct<begin:int,end:int,n_words:int,digest:binary>>"


def normalise(unit: str) -> str:
    return _NOISE.sub(" ", _DIGITS.sub("0", unit.lower())).strip()


def split_units(text: str, by: str = "sentence"):
    """(begin, end) of the units of a text, in characters; each holds the separator after it."""
    at = 0
    for m in re.finditer(CUTS[by], text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def units(docs: DataFrame, by: str = "sentence") -> DataFrame:
    """A row per document with its units that hold a letter or digit."""

    def run(batches):
        for part in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            begin, end, words, digests, sizes = [], [], [], [], []
            for text in part.column(1).to_pylist():
                before = len(begin)
                for i, j in split_units(text or "", by):
                    plain = normalise(text[i:j])
                    if plain:
                        begin.append(i)
                        end.append(j)
                        words.append(len(text[i:j].split()))
                        digests.append(hashlib.blake2b(plain.encode(), digest_size=16).digest())
                sizes.append(len(begin) - before)
            own = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.int32()), pa.array(digests, pa.binary())], ["begin", "end", "n_words", "digest"])
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(edges, own)], ["doc_id", "text_hash", "units"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, UNITS)


def repeated_units(docs: DataFrame, by: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: doc_id, text_hash, n_units; n_repeated (units in repeated passages, the first occurrence
    included), n_shared (those of them that stand in other documents too); n_removed, removed_words and removed
    (``begin:end`` of each unit that goes, in order)."""
    table = settle(units(docs, by), "units")
    document = ["doc_id", "text_hash"]
    each = table.select(*document, F.posexplode("units").alias("k", "u")).select(*document, "k", F.col("u.*"))
    place = F.struct("doc_id", "text_hash", "k")
    first = each.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    first = first.select("digest", "first", F.expr("struct(first.doc_id, first.text_hash) != struct(last.doc_id, last.text_hash)").alias("shared"))
    found = each.join(first, "digest").select(*document, "k", "begin", "end", "n_words", (place != F.col("first")).alias("later"), "shared")
    # runs of neighbours: repeated rows first become one
    found = found.repartition(*document).withColumn("copy", F.row_number().over(Window.partitionBy(*document, "k").orderBy("k"))).where("copy = 1")
    found = found.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*document).orderBy("k")))
    found = found.withColumn("run_words", F.sum("n_words").over(Window.partitionBy(*document, "run"))).where(F.col("run_words") >= min_words)
    span = F.when(F.col("later"), F.struct("begin", "end"))
    passages = found.groupBy(*document).agg(F.count("*").alias("n_repeated"), F.count_if("shared").alias("n_shared"), F.count_if("later").alias("n_removed"),
                                            F.sum(F.when(F.col("later"), F.col("n_words")).otherwise(0)).alias("removed_words"), F.array_sort(F.collect_list(span)).alias("spans"))
    d, p = table.select(*document, F.size("units").cast("long").alias("n_units")).alias("d"), passages.alias("p")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    joined = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")
    return joined.select("d.doc_id", "d.text_hash", "n_units", none("n_repeated"), none("n_shared"), none("n_removed"), none("removed_words"), F.coalesce(listed, F.lit("")).alias("removed"))


def remove_spans(text: str | None, removed: str) -> str | None:
    """A text without its removed units."""
    if not text or not removed:
        return text
    out, at = [], 0
    for begin, end in (map(int, x.split(":")) for x in removed.split(",")):
        out.append(text[at:begin])
        at = end
    return "".join(out) + text[at:]


def cleaned(docs: DataFrame, by: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, text without repeated units; original offsets stay in ``removed``, in place of a
    column of that name."""
    docs = docs.drop("removed")
    d, h = unused(docs, "_d", "_h")
    marked = repeated_units(docs, by, min_words).where("n_removed > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), "removed").distinct()
    cut = F.pandas_udf(lambda t, r: t.combine(r, lambda x, y: remove_spans(x, y or "")), "string")
    joined = docs.join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left").drop(d, h)
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut("text", "removed")))
