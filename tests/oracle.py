"""Compares a registered query with its SQL on the same Parquet tables, in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    """A value that compares alike whichever engine made it."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and not math.isinf(value):
        return None if math.isnan(value) else int(value) if value == int(value) else round(value, 6)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(map(plain, value))
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def rows_of(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def sql_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        return db.execute(sql).df()


def differences(found: DataFrame, sf_dir: str, sql: str, most: int = 5) -> list:
    """Rows that only one side has: (side, row), few of them. Spark's extra columns are left out."""
    want = sql_rows(sf_dir, sql)
    got = found.select(*want.columns).toPandas() if set(want.columns) <= set(found.columns) else found.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return [("columns", sorted(got.columns), sorted(want.columns))]
    a, b = rows_of(got), rows_of(want)
    return [("spark", r) for r in list((a - b).elements())[:most]] + [("sql", r) for r in list((b - a).elements())[:most]]
