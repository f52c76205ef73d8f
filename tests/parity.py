"""Runs a query and its SQL twin and compares the rows."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(data: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted(map(str, ([plain(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False))))


def check(spark, con, query, sql, data: str = DATA):
    mine, theirs = query(spark, data).toPandas(), con.execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
