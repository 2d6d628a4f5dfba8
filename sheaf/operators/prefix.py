"""Ranks and running values over a whole table without a single task for all rows.

The table is dealt into ranges of its order and written; each range is numbered on its own, and the ranges' totals, one row per
partition, give every range what stands before it. Ranks are the same as row_number over one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.scratch import written

_PART = "__part"


def _ranges(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return written(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")


def _before(totals: DataFrame, column: Column) -> DataFrame:
    """One row per range with the value of all ranges before it."""
    return totals.select(_PART, column.over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))


def ranked(df: DataFrame, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with each row's place in the order, from 1."""
    rows = _ranges(df, order, partitions)
    before = _before(rows.groupBy(_PART).agg(F.count("*").alias("n")), F.sum("n"))
    place = F.row_number().over(Window.partitionBy(_PART).orderBy(*order)) + F.coalesce("__before", F.lit(0))
    return rows.join(F.broadcast(before), _PART).withColumn(name, place.cast("long")).drop(_PART, "__before")


def running(df: DataFrame, order: list[str], value: str, how, name: str, partitions: int | None = None) -> DataFrame:
    """df with how(value), one of F.sum, F.max and F.min, over all rows before each row; null for the first."""
    rows = _ranges(df, order, partitions)
    before = _before(rows.groupBy(_PART).agg(how(value).alias("v")), how("v"))
    inside = how(value).over(Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}[how]
    return rows.join(F.broadcast(before), _PART).withColumn(name, both(inside, F.col("__before"))).drop(_PART, "__before")
