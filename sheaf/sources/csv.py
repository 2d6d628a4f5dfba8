"""The CSV reader: one delimiter per file, the first row as head, jagged rows padded, all cells text."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import sniff_delimiter

MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
_ROWS = T.ArrayType(T.ArrayType(T.StringType()))


class CsvError(ValueError):
    pass


def parsed(text: str, delimiter: str) -> list[list[str]]:
    """All rows, padded to the widest."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=delimiter) if r]
    width = max(map(len, rows), default=0)
    if len(rows) > MOST_ROWS or width > MOST_COLUMNS:
        raise CsvError("too many rows or columns")
    return [r + [""] * (width - len(r)) for r in rows]


@F.pandas_udf(_ROWS)
def rows_of(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else parsed(t, d or ",") for t, d in zip(text, delimiter, strict=True)])


def read_csv(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, delimiter, columns, r, header, cells): one row per line of each file."""
    out = files.select(key, sniff_delimiter(F.col(text)).alias("delimiter"), F.col(text).alias("__text"))
    out = out.withColumn("rows", rows_of("__text", "delimiter"))
    out = out.select(key, "delimiter", F.coalesce(F.size(F.get("rows", 0)), F.lit(0)).alias("columns"), F.posexplode("rows").alias("r", "cells"))
    return out.withColumn("header", F.col("r") == 0)
