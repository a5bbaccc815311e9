"""Ranked lexical search over term-bucketed postings (operator 11).

The index is a table of postings, a row for each term and slice of documents with the occurrences in that slice, written in
buckets of the term's hash.  A very frequent term has many rows, dealt over several files of its bucket.  The terms of the
items are joined to it, every match gets its integer score, matches are summed by item and document, and ``row_number`` keeps
the best k of each item.

Frequent words match nearly all documents and decide nothing, so an item's lightest terms wait: a match of weight w scores
below w * 10^6, and if all waiting terms of an item together stay below the score that its k-th document reaches by the
other terms alone, then no document can enter the result by them; they are only looked up for the documents that can still
reach that score.  Items for which that does not hold are scored by all terms at once.  The result is that of the full sum.

Weights and scores follow the contract: w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 10 + ((90 * n * N) div L), a match scores
w * ((10^9 * tf) div (1000 * tf + 8 * m)), all in 64-bit integers but for the logarithm.

Defined cases: null and empty texts have no term, are not counted and never found; rows of one item_id (null too) are one
item; repeated document rows are documents of their own; equal scores go by doc_id, null first; very long texts are taken
whole; without documents or items the result is empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, in_arrow, release, settle, work_path
from .wordcodes import list_codes, slices, without_empty

#: What stands between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE_DOCS, SLICE_BYTES = 4000, 4_000_000
#: Buckets of the index, and parts over which the rows of one bucket are dealt.
BUCKETS, SPREAD = 16, 4
#: Terms and their bytes up to which a fixed set of items narrows the index that is built for it; item terms and documents
#: up to which they are broadcast.
MAX_TERMS, MAX_TERM_BYTES, MAX_BROADCAST_ROWS = 200_000, 8_000_000, 500_000
#: Part of an item's weight that waits.
WAITING = 0.25
CEILING = 1_000_000
POSTINGS = "term string, docs array<struct<row:long,doc_id:long,tf:long,n:long>>, n_docs long, n_terms long"


@dataclass
class Index:
    """postings: bucket, term, docs; n_docs and n_terms of the documents that have a term."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def _plain_bytes() -> np.ndarray:
    """Every byte as itself, A-Z lower-cased, ASCII that is neither letter nor digit as a space."""
    return np.array([b if b > 127 or chr(b).isalnum() else 32 for b in (x + 32 if 65 <= x <= 90 else x for x in range(256))], np.uint8)


def term_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms, the code of every term in order, and where each text's begin."""
    texts = pc.fill_null(texts, "")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_plain_bytes()[data[ends[0] : ends[-1]]]))
    return without_empty(*list_codes(pc.ascii_split_whitespace(plain)))


def _segments(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """A row per term and slice of documents; one without a term counts the slice's documents and terms."""
    chosen = None if wanted is None else pa.array(wanted, pa.string())

    def run(batches):
        for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            distinct, codes, starts = term_codes(b.column(1))
            n, row = np.diff(starts), np.repeat(np.arange(b.num_rows), np.diff(starts))
            names = pa.array(distinct, pa.string())
            if chosen is not None:
                place = pc.fill_null(pc.index_in(names, value_set=chosen), -1).to_numpy()
                names, codes = chosen, place[codes] if len(codes) else codes
                row, codes = row[codes >= 0], codes[codes >= 0]
            keys, tf = np.unique(codes.astype(np.int64) * b.num_rows + row, return_counts=True)
            term, row = np.divmod(keys, b.num_rows)
            begin = np.flatnonzero(np.diff(term, prepend=-1))
            columns = [pc.take(b.column(2), pa.array(row)), pc.take(b.column(0), pa.array(row)), pa.array(tf, pa.int64()), pa.array(n[row], pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)), pa.int32()), pa.StructArray.from_arrays(columns, ["row", "doc_id", "tf", "n"]))
            zero = pa.array(np.zeros(len(begin), np.int64))
            yield pa.RecordBatch.from_arrays([pc.take(names, pa.array(term[begin])), lists, zero, zero], ["term", "docs", "n_docs", "n_terms"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([[]], lists.type), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["term", "docs", "n_docs", "n_terms"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), run, POSTINGS)


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.hash(term), F.lit(BUCKETS)))


def build_index(docs: DataFrame, items: DataFrame | None = None) -> Index:
    """The index of all documents; of all terms, or only those of the given item terms if these are few enough to be sent."""
    spark, wanted = docs.sparkSession, None
    if items is not None:
        terms = items.select("term").distinct()
        n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        if n <= MAX_TERMS and size <= MAX_TERM_BYTES:
            wanted = [r[0] for r in terms.collect()]
    path = work_path(spark, "postings")
    segments = _segments(docs, wanted).withColumn("bucket", _bucket(F.col("term")))
    # rows of a bucket go to SPREAD tasks, so that no term's postings meet in one
    dealt = segments.repartition("bucket", F.pmod(F.hash(F.get("docs", F.lit(0))["row"], F.col("n_terms")), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    release(spark)
    written = spark.read.schema(POSTINGS + ", bucket int").parquet(path)
    n_docs, n_terms = written.where("bucket = -1").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Index(written.where("bucket >= 0").select("bucket", "term", "docs"), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once."""
    terms = F.array_distinct(F.filter(F.split(ascii_lower(F.col("text")), BETWEEN), lambda t: t != ""))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct()


def _small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A settled table, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def _score(index: Index) -> Column:
    """What a posting gives for a weight of 1."""
    n, total = index.n_docs, max(index.n_terms, 1)
    return F.expr(f"(1000000000L * p.tf) div (1000 * p.tf + 8 * (10 + (90 * p.n * {n}L) div {total}L))")


def weigh(index: Index, items: DataFrame) -> DataFrame:
    """item_id, term, w of the terms that weigh anything, whether they wait, and waiting: what an item's waiting terms give together at most."""
    df = index.postings.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = items.join(df, "term").withColumn("w", w).where("w > 0")
    own = Window.partitionBy("item_id")
    waits = F.sum("w").over(own.orderBy("w", "term")) <= WAITING * F.sum("w").over(own)
    return weighed.withColumn("waits", waits).withColumn("waiting", F.coalesce(F.sum(F.when(F.col("waits"), F.col("w"))).over(own), F.lit(0)) * CEILING).select("item_id", "term", "w", "waits", "waiting")


def _matched(index: Index, terms: DataFrame) -> DataFrame:
    """item_id, row, doc_id and score: the matches of the given item terms, summed."""
    each = index.postings.join(terms, "term").select("item_id", "w", F.explode("docs").alias("p"))
    return each.groupBy("item_id", F.col("p.row").alias("row")).agg(F.sum(F.col("w") * _score(index)).alias("score"), F.max("p.doc_id").alias("doc_id"))


def _top(scores: DataFrame, k: int, keep=("item_id", "row", "doc_id", "score")) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keep, "rank")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (of item_terms) with a score above 0."""
    weighed = settle(weigh(index, items), "weighed")
    at_once = settle(_matched(index, _small(weighed.where(~F.col("waits")).select("item_id", "term", "w"))), "scores")
    waiting = weighed.groupBy("item_id").agg(F.first("waiting").alias("waiting"))
    reached = _top(at_once, k).where(F.col("rank") == k).select("item_id", F.col("score").alias("reached"))
    limits = settle(waiting.join(reached, waiting["item_id"].eqNullSafe(reached["item_id"]), "left").select(waiting["item_id"].alias("item"), "waiting", "reached", (F.coalesce(F.col("reached"), F.lit(0)) > F.col("waiting")).alias("closed")), "limits")
    can = F.col("score") + F.col("waiting") >= F.col("reached")
    candidates = settle(at_once.join(_small(limits.where("closed")), F.col("item_id").eqNullSafe(F.col("item"))).where(can).select("item_id", "row", "doc_id", "score"), "candidates")
    later = weighed.where("waits").select(F.col("item_id").alias("item"), F.col("term").alias("t"), "w")
    postings = index.postings.join(_small(later.select(F.col("t").alias("term")).distinct()), "term", "left_semi").select("term", F.explode("docs").alias("p"))
    met = postings.join(_small(candidates.select("item_id", "row")), F.col("p.row") == F.col("row"))
    more = met.join(_small(later), F.col("item_id").eqNullSafe(F.col("item")) & (F.col("term") == F.col("t"))).select("item_id", "row", F.lit(None).cast("long").alias("doc_id"), (F.col("w") * _score(index)).alias("score"))
    closed = candidates.unionByName(more).groupBy("item_id", "row").agg(F.sum("score").alias("score"), F.max("doc_id").alias("doc_id"))
    open_terms = weighed.join(F.broadcast(limits.where(~F.col("closed")).select("item")), F.col("item_id").eqNullSafe(F.col("item"))).select("item_id", "term", "w")
    every = closed.unionByName(_matched(index, _small(settle(open_terms, "open"))))
    return _top(every.where("score > 0"), k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    terms = settle(item_terms(items), "items")
    return search(build_index(docs, terms), terms, k)
