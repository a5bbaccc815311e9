"""Operator 10 on texts with very many matches, and with columns of any name."""

import time

from pyspark.sql import functions as F

from klangwerk.llm import pii

MAIL = "mail u%d@ex.org now "


def seconds(spark, n):
    one = spark.createDataFrame([(1, "".join(MAIL % i for i in range(n)))], "doc_id long, text string").cache()
    one.count()
    took = []
    for _ in range(2):
        began = time.time()
        assert one.select(F.size(pii.all_spans(F.col("text")))).first()[0] == n
        took.append(time.time() - began)
    return min(took)


def test_time_grows_in_proportion(spark):
    seconds(spark, 100)
    few, many = seconds(spark, 8000), seconds(spark, 32000)
    assert many <= max(5 * few, 4.0)


def test_running_values(spark):
    for n in (0, 1, 2, 3, 10, 17, 100):
        values = [(i * 37) % 11 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(pii._running(F.col("v"), F.lit(0), lambda a, b: a + b), pii._running(F.col("v"), F.lit(-1), lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(values[:i]) for i in range(n)] and most == [max([-1, *values[:i]]) for i in range(n)]


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, "write a.b@c.org", "x", 1, "r", "p"), (2, None, "y", 2, "r", "p"), (3, "z" * 9000 + " é😀 10.0.0.1 " + "z" * 9000 + " a@b.cd", "z", 3, "r", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, _h long, row string, places string").withColumns({"found": F.lit(1), "every": F.lit(2), "text_hash": F.lit(3), "a.b": F.lit(4)})
    clean = pii.sanitise(docs)
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and {r._found for r in got.values()} == {"x", "y", "z"} and got[1]["a.b"] == 4
    assert got[1].text == "write <EMAIL>" and got[2].text is None and got[3].text == "z" * 9000 + " é😀 <IP> " + "z" * 9000 + " <EMAIL>"
    assert pii.sanitise(docs.limit(0)).collect() == []
