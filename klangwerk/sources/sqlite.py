"""SQLite files as a source (SR-14): tables of one or several database files, read in parts by ranges of the row id.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").option("path", "/data/a.db,/data/b.db").option("table", "surface").option("rows", 500_000).load()

Files are opened read-only by the tasks, so they lie where all executors can open them.  Column types follow the declared
ones; a column ``_file`` tells the file's place in the list.  A condition given as ``where`` is evaluated by SQLite, whose
indexes can serve it.  (Spark's own handing down of filters to Python sources is not used: scans of one loaded table share
its state, so that one query's filters would hold for the next.)  Tables without row ids are one part a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

#: Declared types by what their names hold, in the order in which they are tried.
AFFINITY = (("INT", "bigint", "INTEGER"), ("CHAR", "string", "TEXT"), ("CLOB", "string", "TEXT"), ("TEXT", "string", "TEXT"), ("BLOB", "binary", "BLOB"), ("REAL", "double", "REAL"), ("FLOA", "double", "REAL"), ("DOUB", "double", "REAL"))
FILE = "_file"
#: Rows that go to Spark at once.
BATCH = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str):
    """A read-only connection."""
    import sqlite3
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def columns_of(path: str, table: str) -> list[tuple[str, str, str]]:
    """Name, Spark type and SQLite type of each column."""
    db = connect(path)
    try:
        rows = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    finally:
        db.close()
    if not rows:
        raise ValueError(f"{path} has no table {table}")
    kind = lambda declared: next((x[1:] for x in AFFINITY if x[0] in declared.upper()), ("double", "REAL") if declared else ("binary", "BLOB"))
    return [(r[1], *kind(r[2] or "")) for r in rows]


@dataclass
class Part(D.InputPartition):
    file: int
    low: int | None
    high: int | None


class SQLiteReader(D.DataSourceReader):
    def __init__(self, schema, paths: list[str], table: str, rows: int, where: str):
        self.names, self.paths, self.table, self.rows, self.where = schema.fieldNames(), paths, table, rows, where

    def partitions(self):
        out = []
        for i, path in enumerate(self.paths):
            db = connect(path)
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                if low is not None:
                    parts = -(-(high - low + 1) // self.rows)
                    out += [Part(i, low + k * self.rows, min(high, low + (k + 1) * self.rows - 1)) for k in range(parts)]
            except Exception as e:
                if "rowid" not in str(e):
                    raise
                out.append(Part(i, None, None))  # a table without row ids
            finally:
                db.close()
        return out or [Part(0, 0, -1)]

    def read(self, partition):
        import pyarrow as pa

        db = connect(self.paths[partition.file])
        try:
            types = {n: (kind, cast) for n, kind, cast in columns_of(self.paths[partition.file], self.table)}
            arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
            own = [n for n in self.names if n != FILE]
            shown = ", ".join(f"CAST({_quoted(n)} AS {types[n][1]})" for n in own) or "1"
            where, values = [f"({self.where})"] if self.where else [], []
            if partition.low is not None:
                where, values = [*where, "rowid BETWEEN ? AND ?"], [*values, partition.low, partition.high]
            found = db.execute(f"SELECT {shown} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := found.fetchmany(BATCH):
                held = dict(zip(own, zip(*rows)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows), pa.int32()) if n == FILE else pa.array(held[n], arrow[types[n][0]]) for n in self.names], self.names)
        finally:
            db.close()


class SQLiteSource(D.DataSource):
    @classmethod
    def name(cls):
        return "sqlite"

    def _paths(self) -> list[str]:
        return [p.strip() for p in self.options["path"].split(",") if p.strip()]

    def schema(self):
        return ", ".join(f"`{n}` {kind}" for n, kind, _ in columns_of(self._paths()[0], self.options["table"])) + f", {FILE} int"

    def reader(self, schema):
        return SQLiteReader(schema, self._paths(), self.options["table"], max(1, int(self.options.get("rows", 500_000))), self.options.get("where", ""))


def sqlite_table(spark: SparkSession, paths: list[str], table: str, rows: int = 500_000, where: str = "") -> DataFrame:
    """SR-14: a table of SQLite files, as parts of so many row ids each; only the rows that meet a condition in SQL, if given."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", ",".join(paths)).option("table", table).option("rows", rows).option("where", where).load()
