"""Grids and writers: tables to CSV with spans, text rendering of blocks, and the style cascade."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import escape_csv, guard_formula

MOST_CELL = 32_767


def placed(cells: Iterable[dict]) -> list[list[str]]:
    """A grid from cells (r, rowspan, colspan, text) in reading order; covered places stay blank."""
    grid: dict[tuple[int, int], str] = {}
    rows: dict[int, list[dict]] = {}
    for cell in cells:
        rows.setdefault(int(cell["r"]), []).append(cell)
    for r in sorted(rows):
        c = 0
        for cell in rows[r]:
            while (r, c) in grid:
                c += 1
            down, across = (max(1, min(1024, int(cell.get(k) or 1))) for k in ("rowspan", "colspan"))
            for i in range(down):
                for j in range(across):
                    grid[r + i, c + j] = (cell["text"] or "")[:MOST_CELL] if not i and not j else ""
            c += across
    height, width = (max((k[i] for k in grid), default=-1) + 1 for i in (0, 1))
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def grid_of(cells: pd.Series) -> pd.Series:
    """The grid of each array of cells (r, c, rowspan, colspan, text)."""
    return cells.map(lambda own: placed(sorted(own, key=lambda x: (x["r"], x["c"]))))


def grids(cells: DataFrame, *key: str) -> DataFrame:
    """(key, r, c, text) of every place of every table; a table's cells travel as one array."""
    whole = F.collect_list(F.struct("r", "c", "rowspan", "colspan", "text"))
    rows = cells.groupBy(*key).agg(whole.alias("cells")).select(*key, F.posexplode(grid_of("cells")).alias("r", "line"))
    return rows.select(*key, "r", F.posexplode("line").alias("c", "text"))


def csv_lines(grid: DataFrame, *key: str) -> DataFrame:
    """(key, csv): lines of a grid as CSV with guarded formulas."""
    field = escape_csv(guard_formula(F.col("text")))
    lines = grid.groupBy(*key, "r").agg(F.array_sort(F.collect_list(F.struct("c", field.alias("f")))).alias("fields"))
    lines = lines.withColumn("line", F.array_join(F.transform("fields", lambda x: x.f), ","))
    whole = F.array_sort(F.collect_list(F.struct("r", "line")))
    return lines.groupBy(*key).agg(F.array_join(F.transform(whole, lambda x: x.line), "\r\n").alias("csv"))


def text_of_blocks(blocks: Column) -> Column:
    """Plain text of an array of blocks: headings with signs, quotes and list items with marks."""

    def line(b: Column) -> Column:
        return (
            F.when(b.kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(b.level, F.lit(1))), F.lit(" "), b.text))
            .when(b.kind == "list_item", F.concat(F.lit("- "), b.text))
            .when(b.kind == "quote", F.concat(F.lit("> "), b.text))
            .otherwise(b.text)
        )

    return F.array_join(F.transform(blocks, line), "\n\n")


#: Ancestors that a style may have.
ANCESTORS = 16


def _climbed(styles: DataFrame, properties: list[str], steps: int) -> DataFrame:
    """Styles after `steps` joins with their ancestors; __next is the ancestor that would come next."""
    current = styles.select("style", F.col("based_on").alias("__next"), *properties)
    base = styles.select(F.col("style").alias("__at"), F.col("based_on").alias("__up"), *[F.col(p).alias(f"__{p}") for p in properties])
    for _ in range(steps):
        current = current.join(base, F.col("__next") == F.col("__at"), "left").select(
            "style", F.col("__up").alias("__next"), *[F.coalesce(p, f"__{p}").alias(p) for p in properties]
        )
    return current


def chain_faults(styles: DataFrame, steps: int = ANCESTORS) -> DataFrame:
    """Styles with more than `steps` ancestors, those in a circle among them."""
    return _climbed(styles, [], steps).filter("__next is not null").select("style")


def cascaded(styles: DataFrame, properties: list[str], steps: int = ANCESTORS) -> DataFrame:
    """(style, properties): each from the nearest of the style and its ancestors that sets it. A style that `chain_faults` names
    is an error."""
    deep = F.raise_error(F.concat(F.lit("style chain too deep: "), F.col("style").cast("string")))
    found = _climbed(styles, properties, steps)
    return found.filter(F.when(F.col("__next").isNull(), F.lit(True)).otherwise(deep.cast("boolean"))).drop("__next")
