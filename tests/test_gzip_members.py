"""Gzip files of many members against the plain reader."""

import gzip
import random
from collections import Counter

import pytest

from klangwerk.sources import gzip_members as G


def written(path, text, cuts, level=6):
    """The text in members that end at the cuts."""
    edges = [0, *cuts, len(text)]
    path.write_bytes(b"".join(gzip.compress(text[a:b], level) for a, b in zip(edges, edges[1:])))
    return f"file://{path}"


def lines(rng, n):
    return "\n".join("".join(rng.choices("abc déß漢 {}\"", k=rng.choice([0, 1, 30, 200]))) for _ in range(n)).encode()


@pytest.mark.parametrize("size", [200, 5000, 1 << 20])
def test_lines_are_those_of_the_plain_reader(spark, tmp_path, size):
    rng = random.Random(size)
    body = lines(rng, 300)
    false = gzip.compress(b"a file within a file\n" * 5)
    texts = {"many": body, "ended": body + b"\n", "blank": b"\n\n" + body + b"\n\n\n", "inner": body[:3000].decode(errors="ignore").encode() + b"\n" + false.hex().encode() + b"\n", "one": b"no line end", "none": b""}
    paths = [written(tmp_path / f"{k}.gz", t, sorted(rng.sample(range(1, len(t)), min(25, max(0, len(t) - 1)))) if len(t) > 1 else []) for k, t in texts.items()]
    got = Counter((r.path.rsplit("/", 1)[1], r.value) for r in G.read_lines(spark, paths, size=size).collect())
    want = Counter((p.rsplit("/", 1)[1], r.value) for p in paths for r in spark.read.option("lineSep", "\n").text(p).collect())
    assert got == want


def test_members_within_members_are_none(spark, tmp_path):
    inner = gzip.compress(b"inner\n" * 50)
    stored = gzip.compress(b"before\n" + inner + b"\nafter\n", 0)  # level 0 stores the inner file as it is
    path = tmp_path / "s.gz"
    path.write_bytes(gzip.compress(b"x\n") + stored + gzip.compress(b"y\n"))
    assert inner in path.read_bytes()
    for size in (30, 64 << 20):
        assert G.members(spark, [f"file://{path}"], size).count() == 3


def test_only_marked_lines(spark, tmp_path):
    text = b"".join(b'{"id": "Q%d", "claims": {"P%d": 1}}\n' % (i, i % 5) for i in range(400))
    path = written(tmp_path / "d.gz", text, list(range(700, len(text), 700)))
    got = sorted(r.value for r in G.read_lines(spark, [path], ('"P3"',), size=900).collect())
    assert got == sorted(x for x in text.decode().splitlines() if '"P3"' in x) and len(got) == 80
    assert G.members(spark, [path], 900).count() == len(range(700, len(text), 700)) + 1
