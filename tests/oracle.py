"""Compares a Spark result with DuckDB's on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    def simple(v):
        v = plain(v)
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(map(simple, r)) for r in df.itertuples(index=False, name=None)), key=repr)
