"""SQLite files, resumable stages and revisions of long documents."""

import random
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from klangwerk.operators import revisions as V
from klangwerk.sources import sinks
from klangwerk.sources.sqlite import sqlite_table


def database(path, rows, extra=""):
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE word (id INTEGER PRIMARY KEY, form TEXT, score REAL, raw BLOB, n VARCHAR(9)) {extra}")
    db.executemany("INSERT INTO word VALUES (?, ?, ?, ?, ?)", rows)
    db.commit()
    db.close()
    return str(path)


ROWS = [(i * 3, f"w{i}" if i % 7 else None, i / 4, bytes([i % 256]), str(i)) for i in range(1000)]


def test_sqlite_files_are_read_in_parts(spark, tmp_path):
    paths = [database(tmp_path / "a b.db", ROWS), database(tmp_path / "c.db", ROWS[:10]), database(tmp_path / "empty.db", [])]
    df = sqlite_table(spark, paths, "word", 500)
    assert df.rdd.getNumPartitions() == 7 and [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "binary", "string", "int"]
    want = sorted([(*r, 0) for r in ROWS] + [(*r, 1) for r in ROWS[:10]], key=lambda r: (r[-1], r[0]))
    assert sorted(((r.id, r.form, r.score, bytes(r.raw), r.n, r._file) for r in df.collect()), key=lambda r: (r[-1], r[0])) == want
    found = df.where((F.col("id") > 30) & (F.col("score") <= 100.0) & F.col("form").isNotNull() & F.col("n").isin("20", "21", "22") & (F.col("_file") == 0))
    assert sorted(r.id for r in found.collect()) == [60, 66]
    assert df.groupBy("_file").count().count() == 2 and df.select("_file").count() == 1010
    assert sqlite_table(spark, paths[2:], "word").collect() == []
    with pytest.raises(Exception, match="no table"):
        sqlite_table(spark, paths[:1], "nothing").collect()


def test_sqlite_evaluates_a_condition(spark, tmp_path):
    path = database(tmp_path / "a.db", ROWS)
    asked = sqlite_table(spark, [path], "word", 400, where="id BETWEEN 30 AND 60 OR form = 'w3'")
    assert sorted(r.id for r in asked.collect()) == [9, *range(30, 61, 3)]


def test_sqlite_table_without_row_ids(spark, tmp_path):
    path = database(tmp_path / "w.db", ROWS[:50], "WITHOUT ROWID")
    assert sorted(r.id for r in sqlite_table(spark, [path], "word", 7).collect()) == [r[0] for r in ROWS[:50]]


def test_a_lost_stage_goes_on_where_it_stopped(spark, tmp_path):
    source = spark.range(1000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    calls, lost = [], [True]

    def build(df):
        calls.append(1)
        if lost[0] and len(calls) == 3:
            raise RuntimeError("lost")
        return df.groupBy("k").agg(F.sum("v").alias("v"))

    folder = f"file://{tmp_path}/stage"
    with pytest.raises(RuntimeError):
        sinks.resumable_stage(source, "k", folder, "first", build, 5)
    assert sinks.stage_manifest(spark, folder, "first") is None
    lost[0] = False
    done = sinks.resumable_stage(source, "k", folder, "first", build, 5)
    assert len(calls) == 3 + 3 and sorted(map(str, done.collect())) == sorted(map(str, source.groupBy("k").agg(F.sum("v").alias("v")).collect()))
    manifest = sinks.stage_manifest(spark, folder, "first").orderBy("shard").collect()
    assert len(manifest) == 5 and manifest[-1].last_key is None and sum(r["rows"] for r in manifest) == done.count()
    sinks.resumable_stage(source, "k", folder, "first", build, 5)
    assert len(calls) == 6
    sinks.resumable_stage(source, "k", folder, "second", build, 5)
    assert len(calls) == 11


def test_empty_stage(spark, tmp_path):
    empty = spark.range(0).select(F.col("id").alias("k"))
    assert sinks.resumable_stage(empty, "k", f"file://{tmp_path}/none", "f", lambda d: d, 4).collect() == []


def by_matrix(current, previous):
    n, m = len(current), len(previous)
    longest = np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            longest[i, j] = longest[i + 1, j + 1] + 1 if current[i] == previous[j] else max(longest[i + 1, j], longest[i, j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if current[i] == previous[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest[i + 1, j] >= longest[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_bars_are_those_of_the_matrix():
    rng = random.Random(5)
    for _ in range(600):
        ids = list(range(rng.randint(0, 12)))
        a, b = rng.sample(ids, rng.randint(0, len(ids))), rng.sample(ids, rng.randint(0, len(ids)))
        assert V.common_bars(a, b) == by_matrix(a, b)


def test_common_bars_of_a_long_document():
    rng = random.Random(6)
    a = list(range(100_000))
    b = rng.sample(a, 100_000)
    began = time.time()
    found = V.common_bars(a, b)
    assert time.time() - began < 5 and all(x < y and b[p] == x for (x, p), (y, _) in zip(found, found[1:])) and len(found) > 400
    assert len(V.common_bars(a, [*a[50_000:], *a[:50_000]])) == 50_000
