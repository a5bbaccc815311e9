"""Document revisions and libraries (UI-01, UI-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a task hands on at once; more if a single document has more.
BATCH = 20_000


def common_bars(current: list, previous: list) -> list[tuple[int, int]]:
    """Places (current, previous) of a longest common subsequence of ids; of equally long ones that which passes over the
    current bar first.

    Ids are unique in a revision (of repeated ones the first is met with the first, and so on), so the subsequence is a longest
    run of increasing places: found in n log n steps and linear memory."""
    from bisect import bisect_left
    from collections import Counter

    def numbered(ids):
        seen = Counter()
        for x in ids:
            yield x, seen[x]
            seen[x] += 1

    was = {x: j for j, x in enumerate(numbered(previous))}
    places = [was.get(x) for x in numbered(current)]
    # how many bars a common run that begins with a bar can have: ends[n] is the greatest place where one of n + 1 begins, negated
    ends, length, after, latest = [], [0] * len(places), [None] * len(places), {}
    for i in range(len(places) - 1, -1, -1):
        if places[i] is not None:
            at = bisect_left(ends, -places[i])
            ends[at : at + 1] = [-places[i]]
            length[i] = at + 1
            after[i] = latest.get(at + 1)  # the next bar from which the run is as long; it was before this one
            latest[at + 1] = i
    out, need, least = [], len(ends), 0
    for i, j in enumerate(places):
        if j is None or j < least or length[i] != need:
            continue
        # passed over if a later bar begins as long a run, unless it stands at once in both
        if j == least or after[i] is None or places[after[i]] < least:
            out.append((i, j))
            need, least = need - 1, j + 1
    return out


def compare_revisions(current: DataFrame, previous: DataFrame, document: str, bar: str, place: str, text: str) -> DataFrame:
    """UI-01: what became of each bar by its stable id: document, bar, at, was_at, state and moved.

    Bars of the longest common subsequence are same, or changed where their text is another; others that stand in both
    revisions have moved (or changed, with moved set); the rest is added or removed.  A bar of the subsequence whose place
    has shifted counts as moved if its text is the same.  A document is compared in n log n steps of its bars."""
    kinds = dict(current.dtypes)
    side = lambda df, name: df.select(F.col(document).alias("document"), F.col(bar).alias("bar"), F.col(place).cast("long").alias("at"), F.col(text).alias("text"), F.lit(name).alias("now"))

    def compared(key, now, was, out):
        kept = {now[i][0] for i, _ in common_bars([b for b, _, _ in now], [b for b, _, _ in was])}
        before = {b: (p, t) for b, p, t in was}
        for b, p, t in now:
            if b not in before:
                out.append((key, b, p, None, "added", False))
                continue
            q, old = before.pop(b)
            moved = b not in kept or p != q
            out.append((key, b, p, q, "changed" if old != t else "moved" if moved else "same", moved))
        out += [(key, b, None, p, "removed", False) for b, (p, _) in before.items()]

    def run(batches):
        import pyarrow as pa

        names, kind = (document, bar, "at", "was_at", "state", "moved"), None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], names=names)

        key, now, was, out, begun = None, [], [], [], False
        for batch in batches:
            columns = [batch.column(x) for x in ("document", "bar")]
            kind = [*(c.type for c in columns), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            for d, b, p, t, new in zip(*(c.to_pylist() for c in columns), *(batch.column(x).to_pylist() for x in ("at", "text", "now"))):
                if not begun or d != key and (d == d or key == key):  # not a number is one document too
                    if begun:
                        compared(key, now, was, out)
                        if len(out) >= BATCH:
                            yield table(out)
                            out = []
                    key, now, was, begun = d, [], [], True
                (now if new else was).append((b, p, t))
        if begun:
            compared(key, now, was, out)
        if out:
            yield table(out)

    # the documents of a partition stand one after the other, so a pass over its rows serves them all
    both = side(current, True).unionByName(side(previous, False)).repartition("document").sortWithinPartitions("document", "now", F.asc_nulls_last("at"))
    return both.mapInArrow(run, f"`{document}` {kinds[document]}, `{bar}` {kinds[bar]}, at long, was_at long, state string, moved boolean")


def library(rows: DataFrame, folder: str, query: str = "", order: str = "title", descending: bool = False) -> DataFrame:
    """UI-02: rows of a folder and below whose title holds the query, sorted; the path's parts as an array."""
    own = rows.where((F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/"))
    found = own.where(F.lower("title").contains(query.lower())).withColumn("parts", F.filter(F.split("path", "/"), lambda p: p != ""))
    return found.orderBy(F.desc(order) if descending else F.asc(order), "title")


def shared_placements(cues: DataFrame, song: str, bar: str, place: str, step: str) -> DataFrame:
    """UI-03: per bar its steps, the bar before it that has any, and the steps that both have.  Steps of a bar are a bounded
    grid."""
    from pyspark.sql.window import Window

    bars = cues.groupBy(song, bar, place).agg(F.array_sort(F.collect_set(step)).alias("steps"))
    w = Window.partitionBy(song).orderBy(place)
    shared = F.coalesce(F.array_sort(F.array_intersect("steps", "_was")), F.array().cast(dict(bars.dtypes)["steps"]))
    return bars.withColumn("previous", F.lag(bar).over(w)).withColumn("_was", F.lag("steps").over(w)).withColumn("shared", shared).withColumn("shared_count", F.size("shared").cast("long")).drop("_was")
