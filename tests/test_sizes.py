"""Queries against their SQL on made tables: long ones, and pages with marks that the smallest tables lack."""

import duckdb
import pandas as pd
import pytest
from test_queries import rows

from sheaf.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL over one made table."""

    def run(name: str, table: str, frame: pd.DataFrame):
        frame.to_parquet(tmp_path / f"{table}.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
            want = con.execute(ORACLE_SQL[name]).df()
        return rows(QUERIES[name](spark, str(tmp_path)).toPandas()), rows(want)

    return run


def test_styles_beyond_the_bytes_of_one_sheet(both):
    part = pd.DataFrame({"p_partkey": range(0, 144_000, 16), "p_name": "long & <wide> " * 70, "p_size": 7})
    got, want = both("office_styles", "part", part)
    assert len(got) == 9000 and got == want


def test_titles_with_other_entities(both):
    titles = ["a &amp; b", "token = &quot;0c", "cut &amp", "  \n ", "&lt;b&gt;  c\t\nd", None]
    pages = pd.DataFrame({"page_id": [1, 2, 3, 4, 5, 6], "html": [None if x is None else f"<html><title>{x}</title><p>x</p></html>" for x in titles]})
    got, want = both("open_pages", "pages", pages)
    assert len(got) == 6 and got == want


def test_column_names_beyond_three_letters(both):
    keys = [0, 701, 702, 18_277, 18_278, 43_289, 43_290, 129_817, 129_818, 163_733, 1_199_999, 1_340_905, 1_340_906, 44_000_000, 45_000_000]
    got, want = both("column_names", "part", pd.DataFrame({"p_partkey": keys}))
    assert len(got) == len(keys) and got == want
