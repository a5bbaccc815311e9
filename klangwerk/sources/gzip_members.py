"""Lines of gzip files by members, many tasks a file (SR-07).

A gzip file may be a row of members (as block-wise writers and concatenation make it).  Tasks look for members in ranges of
the compressed bytes and prove each by decompressing it to its checksum; what lies within another member is no member.  The
members are then read in parallel; lines that run over their edges are put together by place.  A file of one member is one
task, as gzip has no other way in.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangwerk.operators import ranges
from klangwerk.operators import workspace as W

#: Compressed bytes of a range, and read at once.
RANGE, READ = 64 << 20, 1 << 20
#: Fixed value: how a member begins: magic bytes, method, flags without the reserved ones.
HEAD = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.DOTALL)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _inflated(f, start: int):
    """Parts of a member's content; at last its end in the file.  Raises zlib.error if it is none."""
    f.seek(start)
    box, at = zlib.decompressobj(wbits=31), start
    while not box.eof:
        data = f.read(READ)
        if not data:
            raise zlib.error("the file ends within a member")
        at += len(data)
        yield box.decompress(data)
    yield at - len(box.unused_data)


def _member_end(f, start: int) -> int | None:
    end = None
    try:
        for end in _inflated(f, start):
            pass
    except zlib.error:
        return None
    return end


def _files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(conf)
        out.append((store.makeQualified(path).toString(), store.getFileStatus(path).getLen()))
    return out


def members(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """path, start and end of every member."""
    asked = [(p, at, min(n, at + size)) for p, n in _files(spark, paths) for at in range(0, n, size)]
    parts = spark.createDataFrame(asked, "path string, low long, high long").repartition(max(1, len(asked)))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                store, path = _store(r["path"])
                found, past = [], -1
                with store.open_input_file(path) as f:
                    f.seek(r["low"])
                    data = f.read(r["high"] - r["low"] + 3)  # a head may run over the edge
                    for m in HEAD.finditer(data):
                        start = r["low"] + m.start()
                        if start < r["high"] and start >= past:
                            end = _member_end(f, start)
                            if end is not None:
                                found.append((r["path"], start, end))
                                past = end
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))] if found else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64())], ["path", "start", "end"])

    held = ranges.running(parts.mapInArrow(run, "path string, start long, end long"), ["path"], [F.asc("start")], {"reach": (F.col("end"), "max")})
    return held.where("reach IS NULL OR reach <= start").drop("reach")


def read_lines(spark: SparkSession, paths: list[str], marks: tuple[str, ...] = (), size: int = RANGE) -> DataFrame:
    """path and value of every line; only of those that hold one of ``marks``, if any is given.  Lines come in any order."""
    own = W.settled(members(spark, paths, size), f"{W.shared_dir(spark)}/klangwerk-members-{uuid.uuid4().hex}")
    dealt = own.repartition(max(1, own.count()))
    wanted = [m.encode() for m in marks]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                store, path = _store(r["path"])
                kept, head, broken = b"", None, 0
                with store.open_input_file(path) as f:
                    for part in _inflated(f, r["start"]):
                        if isinstance(part, int):
                            break
                        *lines, kept = (kept + part).split(b"\n")
                        if lines and head is None:
                            head, lines, broken = lines[0], lines[1:], 1
                        lines = [x for x in lines if not wanted or any(m in x for m in wanted)]
                        if lines:
                            yield _rows(r, [("line", x, 0) for x in lines])
                # what runs on at either edge; "whole" if the member has no line end
                yield _rows(r, [("head", head, broken), ("tail", kept, broken)] if broken else [("whole", kept, 0)])

    def _rows(r, rows):
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array([r["start"]] * n), pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.int64())],
                                          ["path", "start", "kind", "value", "broken"])

    read = W.settled(dealt.mapInArrow(run, "path string, start long, kind string, value binary, broken long"), f"{W.shared_dir(spark)}/klangwerk-lines-{uuid.uuid4().hex}")
    text = lambda c: c.cast("string")
    inner = read.where("kind = 'line'").select("path", text(F.col("value")).alias("value"))
    edges = read.where("kind <> 'line'")
    # members that have a line end before a piece tell which line it belongs to
    breaks = edges.where("kind <> 'tail'").select("path", "start", "broken")
    before = ranges.running(breaks, ["path"], [F.asc("start")], {"n": (F.col("broken"), "sum")}, {"all": F.col("broken")}).select("path", "start", F.coalesce("n", F.lit(0)).alias("n"), "all")
    placed = edges.join(before, ["path", "start"]).select("path", "start", "value", "all", (F.col("n") + F.when(F.col("kind") == "tail", 1).otherwise(0)).alias("line"))
    joined = placed.groupBy("path", "line", "all").agg(F.array_sort(F.collect_list(F.struct("start", F.hex("value").alias("v")))).alias("parts"))
    whole = joined.select("path", text(F.unhex(F.array_join(F.transform("parts", lambda x: x["v"]), ""))).alias("value"), (F.col("line") == F.col("all")).alias("last"))
    crossing = whole.where("NOT last OR value <> ''").select("path", "value")
    if marks:
        crossing = crossing.where(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col("value"), m)))
    return inner.unionByName(crossing)
