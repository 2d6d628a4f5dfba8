"""All registered queries against their SQL on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sheaf.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        x = float(x)
        return None if x != x else int(x) if x.is_integer() else round(x, 6)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(x))
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())
