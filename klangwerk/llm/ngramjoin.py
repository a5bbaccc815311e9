"""N-gram Jaccard join by grouped prefixes (operator 4).

A document's set holds the 64-bit hashes of its distinct five-word shingles (A-Z lower-cased, words between ASCII white
space); two documents link when their Jaccard similarity is 0.75 or more.  The result is exact up to hash collisions:

1. Documents with equal sets collapse into one class (128-bit digest of the set).
2. Pruning.  If x has a partner, at least 3/4 of its shingles occur elsewhere, and at least ``l`` of the ``s/4 + l``
   smallest hashes do.  Half of each document's shingles (the smallest hashes) are counted over the corpus; documents with
   too few repeated ones have no partner and end here.  Each task counts its own documents first and sends a shingle once,
   however often it occurs there.
3. The survivors' shingles are counted exactly and ordered by (documents, hash); a document's prefix is its first
   ``s - ceil(3s/4) + 1`` shingles, and linked documents share a prefix shingle.  Shingles of frequent passages come last.
4. Classes with the same prefix and size form a group.  Group pairs that share a prefix shingle pass the size filter and
   the positional filter, are expanded to their members and verified on the whole sets.

Groups of near copies would make that quadratic, so links are first sought along stars: each member with its group's
first member, each group with the pivot that most of its prefix shingles name.  Components of these links are found by
label propagation with pointer jumping; after that only pairs across components are generated, so no link between
components is lost and pairs inside one need not be listed.

Nothing is collected to the driver; intermediate tables go to the shared folder, so lost executors repeat single tasks.

Defined cases: null or blank texts have no shingles and are their own components; texts under five words have one shingle;
rows that repeat a text or an id are rows of their own, equal texts with the same component; a null doc_id is never the smallest; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, remove, settle, small_side, unused
from .decontam import SHINGLE, shingle_hashes
from .wordcodes import hashed_words, slices

PERCENT = 75
BLOCK_DOCS, BLOCK_BYTES = 1500, 3_000_000
BUCKET_BYTES = 16_000_000  # of texts whose counted shingles make up a bucket, some 8 MB
REPEATED = 0xFFFF  # in place of a document's number: the shingle is in several documents of the block


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ascending within each; the text of each; and the size of each text's set."""
    h, starts = hashed_words(texts)
    count = np.diff(starts)
    shingles = np.maximum(count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), shingles)
    x = shingle_hashes(h) if len(h) >= SHINGLE else np.zeros(0, np.uint64)
    first = np.cumsum(shingles) - shingles
    at = starts[:-1][owner] + np.arange(len(owner)) - first[owner]
    values = x[np.minimum(at, max(0, len(x) - 1))] if len(x) else np.zeros(len(owner), np.uint64)
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        values[first[i]] = shingle_hashes(h[starts[i] : starts[i + 1]])[0]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, owner, np.bincount(owner, minlength=len(count))


def set_digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set: two sums of differently mixed hashes."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), 2), np.uint64)
    if len(values):
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(((0xBF58476D1CE4E5B9, 31), (0x94D049BB133111EB, 27))):
                m = (values ^ (values >> np.uint64(b))) * np.uint64(a)
                m ^= m >> np.uint64(33)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)])
                out[:, k] = total[starts + sizes] - total[starts]
    return [row.tobytes() for row in out]


def need(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of n: how many of the smallest hashes are counted, and how many of these must repeat if there is a partner."""
    part = -(-n // 2)
    return part, np.maximum(1, part - (n + (-PERCENT * n // 100)))


_BLOCKS = "block string, bucket int, hashes binary, owners binary, docs array<struct<doc_id:long,text_hash:long,n:int,digest:binary,repeats:int>>"


def _count_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per block with its documents, and one per block and bucket with its shingles."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()),
                        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("repeats", pa.int32())])))])

    def run(batches):
        for part in slices(batches, 1, BLOCK_DOCS, BLOCK_BYTES):
            values, owner, sizes = shingle_sets(part.column(1))
            counted, _ = need(sizes)
            own = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owner] < counted[owner]
            order = np.argsort(values[own], kind="stable")
            x, o = values[own][order], owner[own][order]
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            times = np.diff(np.append(np.flatnonzero(new), len(x)))
            repeated = np.repeat(times > 1, times)
            repeats = np.bincount(o[repeated], minlength=len(sizes))
            x, o = x[new], np.where(times > 1, REPEATED, o[new]).astype("<u2")
            block = uuid.uuid4().hex
            digests = set_digests(values, sizes)
            rows = [{"block": block, "bucket": -1, "docs": [{"doc_id": d, "text_hash": h, "n": int(n), "digest": g, "repeats": int(r)} for d, h, n, g, r in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sizes, digests, repeats)]}]
            where = (x % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            low = (x[order] >> np.uint64(24)).astype("<u4")
            for k in np.flatnonzero(np.diff(edges)):
                i, j = edges[k], edges[k + 1]
                rows.append({"block": block, "bucket": int(k), "hashes": low[i:j].tobytes(), "owners": o[order][i:j].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), run, _BLOCKS)


def _repeats_elsewhere(pdf):
    """For each block of a bucket, how many shingles of each document occur in other blocks too."""
    import pandas as pd

    hashes = [np.frombuffer(x, "<u4") for x in pdf["hashes"]]
    flat = np.concatenate(hashes)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    found, at, out = times[inverse] > 1, 0, []
    for block, own, x in zip(pdf["block"], pdf["owners"], hashes):
        o = np.frombuffer(own, "<u2")
        o = o[found[at : at + len(x)] & (o != REPEATED)]
        at += len(x)
        if len(o):
            out.append((block, np.bincount(o).astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["block", "counts"])


def _surviving(_, docs, counts):
    """Documents of a block, and whether they can have a partner."""
    import pandas as pd

    rows = list(docs["docs"].iloc[0]) if len(docs) else []
    total = np.zeros(len(rows), np.int64)
    for c in counts["counts"]:
        c = np.frombuffer(c, "<u4")
        total[: len(c)] += c
    n = np.array([r["n"] for r in rows], np.int64)
    total += np.array([r["repeats"] for r in rows], np.int64)
    alive = (n > 0) & (total >= need(n)[1])
    out = pd.DataFrame({"doc_id": pd.array([r["doc_id"] for r in rows], dtype="Int64"), "text_hash": np.array([r["text_hash"] for r in rows], np.int64), "n": n, "digest": [r["digest"] for r in rows], "alive": alive})
    return out


def _survivor_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks of the classes' sets, each class once: digests, sizes and shingles."""
    wanted = small_side(classes).select(F.col("rep").alias("_rep"), F.col("digest").alias("_digest"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("_digest", "text")

    def run(batches):
        for part in slices(batches, 1, BLOCK_DOCS, BLOCK_BYTES):
            values, owner, sizes = shingle_sets(part.column(1))
            same = np.array([a == w for a, w in zip(set_digests(values, sizes), part.column(0).to_pylist())], bool)
            digests = [d for d, ok in zip(part.column(0).to_pylist(), same) if ok]
            kept = values[same[owner]] if len(owner) else values
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes[same])]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes[same], pa.int32()), pa.ListArray.from_arrays(edges, pa.array(kept.view(np.int64)))], ["digest", "n", "shingles"])

    return in_arrow(joined, run, "digest binary, n int, shingles array<long>").dropDuplicates(["digest"])


def _set_blocks(sets: DataFrame) -> DataFrame:
    """Rows of sets gathered to blocks of one task each."""
    schema = "block string, digests array<binary>, sizes array<int>, shingles binary"

    def run(batches):
        rows, held = [], 0

        def block():
            return pa.RecordBatch.from_pylist([{"block": uuid.uuid4().hex, "digests": [r[0] for r in rows], "sizes": [r[1] for r in rows], "shingles": b"".join(r[2] for r in rows)}],
                                              pa.schema([("block", pa.string()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("shingles", pa.binary())]))

        for b in batches:
            lists = b.column(2)
            for digest, n, shingles in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (lists[i].values for i in range(len(lists)))):
                rows.append((digest, n, shingles.to_numpy().tobytes()))
                held += 8 * n
                if len(rows) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield block()
                    rows, held = [], 0
        if rows:
            yield block()

    return in_arrow(sets.select("digest", "n", "shingles"), run, schema)


def _by_bucket(values: np.ndarray, buckets: int):
    """Distinct values and their counts, arranged by bucket; edges of the buckets."""
    u, times = np.unique(values, return_counts=True)
    where = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return u[order], times[order], np.searchsorted(where[order], np.arange(buckets + 1))


def _frequencies(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket, in how many classes each of the block's shingles occurs."""

    def send(batches):
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, times, edges = _by_bucket(np.frombuffer(raw, "<u8"), buckets)
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(full), pa.string()), pa.array(full, pa.int32()),
                    pa.array([u[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([times[edges[k] : edges[k + 1]].astype("<u4").tobytes() for k in full], pa.binary())], ["block", "bucket", "hashes", "times"])

    def add(pdf):
        import pandas as pd

        hashes = [np.frombuffer(x, "<u8") for x in pdf["hashes"]]
        times = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["times"]])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, times).astype("<u4")[inverse]
        cut = np.cumsum([0, *map(len, hashes)])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "df": [total[i:j].tobytes() for i, j in zip(cut, cut[1:])]})

    sent = in_arrow(blocks.select("block", "shingles"), send, "block string, bucket int, hashes binary, times binary")
    return sent.groupBy("bucket").applyInPandas(add, "block string, bucket int, df binary")


def _prefixes(buckets: int):
    """A block's sets and the frequencies of its shingles to prefixes: shingles found in other classes, with positions."""

    def run(_, sets, freq):
        import pandas as pd

        out = []
        df_of = dict(zip(freq["bucket"], freq["df"]))
        for digests, sizes, raw in zip(sets["digests"], sets["sizes"], sets["shingles"]):
            values, sizes = np.frombuffer(raw, "<u8"), np.asarray(sizes, np.int64)
            u, _, edges = _by_bucket(values, buckets)
            df = np.concatenate([np.frombuffer(df_of[k], "<u4") for k in np.flatnonzero(np.diff(edges))]) if len(u) else np.zeros(0, "<u4")
            order = np.argsort(u)
            each = df[order][np.searchsorted(u[order], values)]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((values, each, owner))
            values, each, at = values[by], each[by], 0
            for digest, n in zip(digests, sizes.tolist()):
                length = n + (-PERCENT * n // 100) + 1
                own, often = values[at : at + length], each[at : at + length]
                at += n
                places = np.flatnonzero(often > 1)
                if len(places):
                    out.append((digest, n, hash_prefix(own), own[places].view(np.int64).tolist(), places.tolist()))
        return pd.DataFrame(out, columns=["digest", "n", "prefix", "tokens", "places"])

    return run


def hash_prefix(own: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("in_a"))
    right = sets.select(F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("in_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("in_a", "in_b")))
    return both.where(F.expr(f"100L * both >= {PERCENT}L * (n_a + n_b - both)")).select("a", "b")


def connected(links: DataFrame, name: str) -> DataFrame:
    """digest and label (smallest digest of its component) of everything linked: labels spread along links, then jump."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = settle(both.groupBy(F.col("a").alias("digest")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        known = small_side(labels)
        seen = both.join(known.select(F.col("digest").alias("b"), "label"), "b").select(F.col("a").alias("digest"), "label", F.lit(None).cast("binary").alias("old"))
        spread = labels.select("digest", "label", F.col("label").alias("old")).unionByName(seen).groupBy("digest").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        target = known.select(F.col("digest").alias("label"), F.col("label").alias("further"))
        moved = settle(spread.join(target, "label", "left").select("digest", "old", F.least("label", "further").alias("label")), f"{name}-labels")
        labels = moved.select("digest", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (digest, label) after new links: the graph of labels is far smaller than that of classes."""
    own = small_side(labels)
    at = lambda side: own.select(F.col("digest").alias(side), F.col("label").alias(f"label_{side}"))
    edges = links.join(at("a"), "a").join(at("b"), "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    moves = small_side(connected(edges, name)).select(F.col("digest").alias("label"), F.col("label").alias("new"))
    return settle(labels.join(moves, "label", "left").select("digest", F.coalesce("new", "label").alias("label")), f"{name}-merged")


def _fits(a: str, b: str):
    """Size filter of a pair."""
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def _reaches(a: str, b: str):
    """Positional filter of a shared shingle, exact for the first one that a pair shares: that one and all after it in the
    smaller rest must make up the overlap that the similarity asks for.  Later shared shingles may fail it without harm."""
    return F.expr(f"(1 + least(n_{a} - place_{a}, n_{b} - place_{b}) - 1) * {100 + PERCENT} >= (n_{a} + n_{b}) * {PERCENT}")


#: Of the k-th round of stars: pivots that a shingle names and pivots that a class is compared with.  More rounds never
#: change the result; they leave fewer pairs to list in the end.
STARS = ((1, 1), (8, 4), (64, 16))


def _parts(prefixes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (prefix, size) within one component, each named by one member (gid); and their shingles that still stand in
    several components: gid, n, label, token, place and the component that most groups of the shingle are in (major)."""
    placed = prefixes.join(small_side(labels), "digest")
    parts = settle(placed.groupBy("prefix", "n", "label").agg(F.min("digest").alias("gid"), F.min(F.struct("tokens", "places")).alias("t")).select("prefix", "n", "label", "gid", "t.*"), "parts")
    rows = parts.select("gid", "n", "label", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("gid", "n", "label", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    each = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
    split = each.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("token", "major")
    return parts, settle(rows.join(split, "token"), "open")


def _star_pairs(rows: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) to compare in round k: groups outside a shingle's major component with pivots in other components.

    A shingle names the same pivots to all its groups, the first by a hash that changes from round to round, some in its
    major component and some outside; a group is compared with those that most of its shingles name."""
    named, compared = STARS[k]
    minor = F.col("label") != F.col("major")
    order = Window.partitionBy("token", minor).orderBy("place", F.xxhash64("gid", F.lit(k)), "gid")
    pivots = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= named).select(
        "token", F.col("gid").alias("pivot"), F.col("n").alias("n_p"), F.col("place").alias("place_p"), F.col("label").alias("label_p"))
    x = rows.where(minor).select("token", "gid", F.col("n").alias("n_x"), F.col("place").alias("place_x"), "label")
    met = x.join(pivots, "token").where("label != label_p").where(_fits("n_x", "n_p")).where(_reaches("x", "p")).groupBy("gid", "pivot").agg(F.count("*").alias("times"))
    best = Window.partitionBy("gid").orderBy(F.desc("times"), "pivot")
    return met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= compared).select(F.col("gid").alias("a"), F.col("pivot").alias("b"))


def class_labels(prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """digest and component label of every class with a prefix.

    Stars first: whatever links they find join components, so that groups of near copies need not be compared pair by pair.
    Then all pairs of groups in different components that pass the filters are expanded to their members and verified."""
    labels = settle(prefixes.select("digest", F.col("digest").alias("label")), "labels")
    heads = prefixes.groupBy("prefix", "n").agg(F.min("digest").alias("b"))
    pairs = prefixes.join(heads, ["prefix", "n"]).where("digest != b").select(F.col("digest").alias("a"), "b")
    links = settle(verified(pairs, sets), "group-links")
    if not links.isEmpty():
        labels = merged(labels, links, "group")
    for k in range(len(STARS)):
        _, rows = _parts(prefixes, labels)
        if rows.isEmpty():
            return labels
        links = settle(verified(_star_pairs(rows, k), sets), "star-links")
        if not links.isEmpty():
            labels = merged(labels, links, "star")
    # what is left: pairs of classes in different components
    parts, rows = _parts(prefixes, labels)
    others = rows.where("label != major")
    a, b = (t.select(*(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "label", "place")), "token", F.col("major").alias(f"major_{s}")) for t, s in ((others, "a"), (rows, "b")))
    met = a.join(b, "token").where("label_a < label_b OR label_a > label_b AND label_b = major_b").where(_fits("n_a", "n_b")).where(_reaches("a", "b")).select("gid_a", "gid_b").distinct()
    member = prefixes.join(small_side(labels), "digest").join(parts.select("prefix", "n", "label", "gid"), ["prefix", "n", "label"]).select("gid", "digest")
    expanded = (met.join(member.select(F.col("gid").alias("gid_a"), F.col("digest").alias("a")), "gid_a")
                .join(member.select(F.col("gid").alias("gid_b"), F.col("digest").alias("b")), "gid_b").select("a", "b"))
    links = settle(verified(expanded, sets), "cross-links")
    return labels if links.isEmpty() else merged(labels, links, "cross")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), class_digest and text_hash of every row."""
    spark = docs.sparkSession
    buckets = max(64, (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    blocks = settle(_count_blocks(docs, buckets), "blocks")
    counts = blocks.where("bucket >= 0").select("bucket", "block", "hashes", "owners").groupBy("bucket").applyInPandas(_repeats_elsewhere, "block string, counts binary")
    every = settle(blocks.where("bucket < 0").select("block", "docs").groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_surviving, "doc_id long, text_hash long, n int, digest binary, alive boolean"), "docs")
    remove(spark, blocks)
    classes = settle(every.where("alive").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    sets = settle(_survivor_sets(docs, classes), "sets")
    set_blocks = settle(_set_blocks(sets), "set-blocks")
    prefixes = settle(set_blocks.groupBy("block").cogroup(_frequencies(set_blocks, buckets).groupBy("block"))
                      .applyInPandas(_prefixes(buckets), "digest binary, n int, prefix binary, tokens array<long>, places array<int>"), "prefixes")
    labels = class_labels(prefixes, sets)
    placed = classes.select("digest", "rep").join(small_side(labels), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    smallest = placed.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = settle(placed.join(smallest, "label").select("digest", "component"), "components")
    return every.join(of_class, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.hex("digest").alias("class_digest"), "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose component has a smaller doc_id.

    Rows of one doc_id and text are one document; one without an id goes if its component has a document with one."""
    other, (gone_id, gone_hash) = ~F.col("doc_id").eqNullSafe(F.col("component_id")), unused(docs, "_gone", "_hash")
    gone = settle(components(docs).where(other).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(), "gone")
    return docs.join(small_side(gone), docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_hash)), "left_anti")
