"""Matches of lists, styles and JSON trees that a single join cannot express."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_overlaps(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per doc: reference lists matched one to one with the list that holds most of their items, if it holds `least` of them.

    pairs: doc, a (arrays of items of the reference), b. References choose in order; a list is taken once.
    """

    def choose(refs: list[list[str]], got: list[list[str]]) -> list[tuple[int, int | None, float]]:
        free, out = set(range(len(got))), []
        for i, ref in enumerate(refs):
            wanted = set(ref)
            scored = [(len(wanted & set(got[j])) / len(wanted), -j) for j in free] if wanted else []
            share, place = max(scored, default=(0.0, 0))
            if share >= least and scored:
                free.discard(-place)
                out.append((i, -place, share))
            else:
                out.append((i, None, share))
        return out

    def run(frames):
        for frame in frames:
            rows = [(doc, i, j, round(share, 6)) for doc, a, b in zip(frame["doc"], frame["a"], frame["b"], strict=True) for i, j, share in choose([list(x) for x in a], [list(x) for x in b])]
            yield pd.DataFrame(rows, columns=["doc", "reference", "found", "share"]).astype({"found": "Int32"})

    return pairs.select("doc", "a", "b").mapInPandas(run, f"doc {dict(pairs.dtypes)['doc']}, reference int, found int, share double")


def same_style(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two runs look alike: half a point of size, two steps of a colour's components, else equal."""
    size = F.abs(a["size"] - b["size"]) <= 0.5
    shade = F.greatest(*[F.abs(a[c] - b[c]) for c in ("red", "green", "blue")]) <= 2
    return size & shade & a["font"].eqNullSafe(b["font"])


def rewritten(source: str, change) -> str:
    """JSON with `change` applied to the texts of text nodes and to nothing else."""

    def visit(node):
        if isinstance(node, dict):
            return {k: change(v) if k == "text" and isinstance(v, str) else visit(v) for k, v in node.items()}
        return [visit(x) for x in node] if isinstance(node, list) else node

    return json.dumps(visit(json.loads(source)), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def upper_texts(source: pd.Series) -> pd.Series:
    return source.map(lambda x: None if x is None else rewritten(x, str.upper))
