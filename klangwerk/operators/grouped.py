"""Python rules over groups whose rows are in order, in one pass over a task's rows (RK-07, PH-23, SC-03)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Rows of a batch that stand in Python at a time, and rows of one batch of results.
ROWS_IN, ROWS_OUT = 500, 2_000


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_IN):
            yield from zip(*(c.to_pylist() for c in b.slice(at, ROWS_IN).columns))


def _batches(out: Iterator[tuple], kinds):
    import pyarrow as pa

    while part := list(islice(out, ROWS_OUT)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part), kinds)], names=kinds.names)


def flat_rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``f`` makes of each row's columns; what a worker holds is bounded by a few rows, not by a batch's results."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from _batches((r for row in _rows(batches) for r in f(*row)), kinds)

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], f: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType, order: tuple[str | Column, ...] = ()) -> DataFrame:
    """``f`` gets the rows of one group as tuples, in ``order``, and gives rows of ``schema``.

    Groups of a task follow each other in one stream, so many small ones cost no more than their rows, and a rule that takes
    its rows one by one holds none of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = [df.columns.index(k) for k in keys]
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)

    def run(batches):
        yield from _batches((r for _, group in groupby(_rows(batches), key=lambda r: [r[i] for i in at]) for r in f(group)), kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
