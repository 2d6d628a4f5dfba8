import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.operators import pages as P


@pytest.mark.parametrize(
    ("selector", "pages"),
    [("all", [1, 2, 3, 4, 5]), ("even", [2, 4]), ("odd", [1, 3, 5]), ("3", [3]), ("2-4", [2, 3, 4]), ("4-2", [4, 3, 2]), ("4-", [4, 5]), ("-2", [1, 2]), ("last", [5]),
     ("last-1", [4]), ("2-last", [2, 3, 4, 5]), ("last-1-last", [4, 5]), ("1,1, 3", [1, 1, 3])],
)
def test_selectors(spark, selector, pages):
    assert P.expand(selector, 5) == pages
    assert spark.range(1).select(P.expand_column(selector, F.lit(5)).alias("p")).first().p == pages


@pytest.mark.parametrize("selector", ["", "x", "0", "1-0", "last-x", "1--2"])
def test_unreadable_selectors(selector):
    with pytest.raises(P.SelectorError):
        P.expand(selector, 5)


def test_errors_name_the_page_or_the_token():
    with pytest.raises(P.SelectorError, match="'abc'"):
        P.expand("1,abc", 5)
    with pytest.raises(P.SelectorError, match="page 7 of 5"):
        P.expand("7", 5)
    with pytest.raises(P.SelectorError, match="twice"):
        P.expand("1,1", 5, "reject")


@given(st.lists(st.floats(0.5, 9), min_size=1, max_size=30), st.floats(2, 20))
def test_greedy_parts_fit(sizes, most):
    part, used, parts = -1, None, []
    for s in sizes:
        if used is None or used + s > most:
            part, used = part + 1, 0.0
        used += s
        parts.append(part)
    for k in set(parts):
        members = [s for s, p in zip(sizes, parts, strict=True) if p == k]
        assert len(members) == 1 or sum(members) <= most + 1e-9


def test_delete_keeps_documents_that_would_be_empty(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "doc long, page int")
    assert sorted((r.doc, r.page) for r in P.delete(df, "1").collect()) == [(1, 1), (2, 2)]


def test_numerals(spark):
    row = spark.range(1).select(P.roman(F.lit(1994)).alias("r"), P.roman(F.lit(49)).alias("s"), P.alphabetic(F.lit(28)).alias("a")).first()
    assert (row.r, row.s, row.a) == ("mcmxciv", "xlix", "bb")


def test_bates_overflow_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "doc long, page int")
    with pytest.raises(Exception, match="more than 1 digits"):
        P.bates(df, "", 1, "", 9, "page").collect()
