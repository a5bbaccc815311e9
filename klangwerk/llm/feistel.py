"""Sharding by a Feistel permutation over global row numbers (operator 6; DataFrame functions only).

Rows get numbers 0..N-1, the numbers are permuted by a keyed Feistel network with cycle walking, and the permuted number
gives shard (number mod shards) and slot (number div shards).  Anyone who knows N, the key and a row's number can compute
its place, and shard sizes differ by one row at most (law ``rows``).

Row numbers need no global sort: rows are hashed to buckets, numbered within each bucket by (doc_id, checksum, size), and
shifted by the rows of the buckets before.  The bucket uses the id and the text's checksum together, so repeated ids
spread out; exact repeats are counted before any shuffle and numbered as a run, so they cannot crowd one task.

Defined cases: a null text has size 1 and checksum 0; a null doc_id is a value like any other, before all others;
repeated rows each get their own slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Modulus and keys of the round function; products stay below 2**63.
PRIME = 2147483647
ROUND_KEYS = (1103515245, 1664525, 69069, 1566083941, 742938285, 950706376)
#: A walk from a valid number passes each invalid one at most once; past 64 steps the query fails, it never misplaces.
MAX_WALK = 64
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 65536
#: Repeated rows that are told apart at once.
RUN_STEP = 65536


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of a near-square grid with a * b >= n and fewer than a numbers to spare."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def bucket_count(n: int) -> int:
    return min(MAX_BUCKETS, max(16, 1 << (max(1, n) // ROWS_PER_BUCKET).bit_length()))


def _mix(x: Column, key: Column, seed: int) -> Column:
    t = (x * key + (key + seed * 7919) % PRIME) % PRIME
    return (t * t + key % 65521) % PRIME


def _pass(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over 0..a*b-1: the two coordinates take turns, each shifted by a hash of the other."""
    rounds = F.array(*(F.struct(F.lit(key).cast("long").alias("key"), F.lit(i % 2 == 1).alias("odd")) for i, key in enumerate(ROUND_KEYS)))
    start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))

    def turn(p: Column, k: Column) -> Column:
        return F.when(k["odd"], F.struct(p["l"].alias("l"), ((p["r"] + _mix(p["l"], k["key"], seed)) % b).alias("r"))).otherwise(
            F.struct(((p["l"] + _mix(p["r"], k["key"], seed)) % a).alias("l"), p["r"].alias("r")))

    return F.aggregate(rounds, start, turn, lambda p: p["l"] + p["r"] * a)


def permute(x: Column, n: int, seed: int) -> Column:
    """The permutation of 0..n-1: passes of the network until the number is below n."""
    a, b = domain(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), _pass(x, a, b, seed),
                       lambda at, _: F.when(at < n, at).otherwise(_pass(at, a, b, seed)),
                       lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def number_rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and row_no (0..N-1) of every row, and N."""
    n = docs.count()
    buckets = bucket_count(n)
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    runs = settle(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("run")), "runs")
    runs = runs.withColumn("bucket", F.pmod(F.coalesce(F.abs(F.col("doc_id") % PRIME), F.lit(0)) * 7919 + F.col("text_crc32"), F.lit(buckets)))
    totals = runs.groupBy("bucket").agg(F.sum("run").alias("in_bucket"))  # MAX_BUCKETS rows at most
    shifts = totals.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("shift"))
    within = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    placed = runs.withColumn("past", F.sum("run").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("run"))
    numbered = placed.join(F.broadcast(shifts), "bucket").select(
        "doc_id", "size", "text_crc32", "run", (F.col("shift") + F.col("past")).alias("first"))
    # two steps, so that no array holds a whole run
    whole = F.expr(f"sequence(0L, (run - 1) div {RUN_STEP})")
    part = numbered.select("doc_id", "size", "text_crc32", "run", "first", F.explode(whole).alias("step"))
    each = F.expr(f"sequence(step * {RUN_STEP}L, least(run, (step + 1) * {RUN_STEP}L) - 1)")
    return part.select("doc_id", "size", "text_crc32", "first", F.explode(each).alias("i")).select("doc_id", "size", "text_crc32", (F.col("first") + F.col("i")).alias("row_no")), n


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and row_no."""
    numbered, n = number_rows(docs)
    at = permute(F.col("row_no"), n, seed)
    return numbered.withColumn("at", at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % shards).cast("int").alias("shard"),
        ((F.col("at") - F.col("at") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")
