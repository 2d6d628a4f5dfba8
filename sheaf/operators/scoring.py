"""Fidelity scores: error rates, structure matches, table and tree similarity, and word differences.

Null means that a score is unavailable and never counts as zero. Tree and word alignments run in Arrow batches over pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters of a text, and cells of a comparison once equal begins and ends are gone, beyond which there is no error rate.
CHARACTERS, CELLS = 100_000, 4_000_000


def trimmed(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Lengths of the common begin, and of the common end behind it."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return start, end


def _places(a: Sequence) -> dict:
    """For each item the bits of its places."""
    out: dict = {}
    for i, x in enumerate(a):
        out.setdefault(x, []).append(i)
    return {x: sum(1 << i for i in at) for x, at in out.items()}


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time as bits of one number."""
    start, end = trimmed(a, b)
    a, b = sorted((a[start : len(a) - end], b[start : len(b) - end]), key=len)
    if not a:
        return len(b)
    places, full, top = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        equal = places.get(y, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += 1 if right & top else -1 if left & top else 0
        right, left, either = (right << 1 | 1) & full, left << 1 & full, equal | down
        up, down = left | (full & ~(either | right)), right & either
    return score


def character_rate(reference: str, got: str) -> float | None:
    """Distance over the reference's length, texts in NFC with white space collapsed; 0 or 1 for an empty reference; None beyond
    the limits."""
    a, b = (" ".join(unicodedata.normalize("NFC", x).split()) for x in (reference, got))
    if max(len(a), len(b)) > CHARACTERS:
        return None
    if not a:
        return float(bool(b))
    both = sum(trimmed(a, b))
    return None if (len(a) - both) * (len(b) - both) > CELLS else distance(a, b) / len(a)


@F.pandas_udf(T.DoubleType())
def character_error_rate(reference: pd.Series, got: pd.Series) -> pd.Series:
    return pd.Series([character_rate(x or "", y or "") for x, y in zip(reference, got, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, got: pd.Series) -> pd.Series:
    """Distance in words over the reference's number of words, texts in NFC."""

    def rate(x, y):
        a, b = (unicodedata.normalize("NFC", t or "").split() for t in (x, y))
        return float(bool(b)) if not a else distance(a, b) / len(a)

    return pd.Series([rate(x, y) for x, y in zip(reference, got, strict=True)], dtype=float)


def _common_lengths(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every begin of b."""
    places, full = _places(b), (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)] == 0)])


def common_places(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in space that grows with the lengths only: the middle of one sequence meets
    the other where both halves have most in common."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        start, end = trimmed(a[i:j], b[k:m])
        out += [(i + n, k + n) for n in range(start)] + [(j - n, m - n) for n in range(1, end + 1)]
        i, j, k, m = i + start, j - end, k + start, m - end
        if i == j or k == m:
            continue
        if j - i == 1:
            out += [(i, n) for n in range(k, m) if b[n] == a[i]][:1]
            continue
        half = (i + j) // 2
        first, second = _common_lengths(a[i:half], b[k:m]), _common_lengths(a[half:j][::-1], b[k:m][::-1])
        at = k + int((first + second[::-1]).argmax())
        todo += [(i, half, k, at), (half, j, at, m)]
    return sorted(out)


def shortest_edits(a: list, b: list) -> list[tuple[str, int, int]]:
    """A shortest edit script: (kind, place in a, place in b) of every deletion and insertion, in order."""
    out, x, y = [], 0, 0
    for i, j in [*common_places(a, b), (len(a), len(b))]:
        out += [("delete", n, y) for n in range(x, i)] + [("insert", i, n) for n in range(y, j)]
        x, y = i + 1, j + 1
    return out


def word_changes(a: str, b: str) -> list[dict]:
    """Insertions, deletions and replacements of words; neighbouring deletions and insertions are one replacement."""
    old, new = a.split(), b.split()
    out: list[dict] = []
    for kind, x, y in shortest_edits(old, new):
        last = out[-1] if out else None
        if last and last["x"] + len(last["old"]) == x and last["y"] + len(last["new"]) == y:
            last["old" if kind == "delete" else "new"].append(old[x] if kind == "delete" else new[y])
        else:
            out.append({"x": x, "y": y, "old": [old[x]] if kind == "delete" else [], "new": [new[y]] if kind == "insert" else []})
    for change in out:
        change["kind"] = "replace" if change["old"] and change["new"] else "delete" if change["old"] else "insert"
    return out


_CHANGE = T.StructType([T.StructField(n, T.IntegerType() if n == "at" else T.StringType()) for n in ("kind", "at", "old", "new")])


@F.pandas_udf(T.ArrayType(_CHANGE))
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    def rows(x, y):
        found = word_changes(x or "", y or "")
        return [{"kind": c["kind"], "at": c["x"], "old": " ".join(c["old"]), "new": " ".join(c["new"])} for c in found]

    return pd.Series([rows(x, y) for x, y in zip(a, b, strict=True)])


def fifo_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One-to-one matches by key: the k-th occurrence with the k-th."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return left.withColumn("__k", place).join(right.withColumn("__k", place).withColumnRenamed(order, f"{order}_right"), [*keys, "__k"]).drop("__k")


def multiset_overlap(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: sizes of two multisets and of their intersection, by grouped counts."""
    a = left.groupBy(group, item).agg(F.count("*").alias("a"))
    b = right.groupBy(group, item).agg(F.count("*").alias("b"))
    both = a.join(b, [group, item], "full_outer").fillna(0, ["a", "b"])
    return both.groupBy(group).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.least("a", "b")).alias("n_both"))


def f1(matched: Column, left: Column, right: Column) -> Column:
    """2 m / (l + r); null where both are empty."""
    return F.when(left + right > 0, 2 * matched / (left + right))


def mean_of(*scores: Column) -> Column:
    """The mean of the scores that are available."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x) / F.size(there))


def tree_distance(a: tuple, b: tuple, rename) -> float:
    """Zhang and Shasha's distance of ordered trees (label, [children])."""

    def flat(tree):
        labels, leftmost = [], []

        def visit(node):
            first = None
            for child in node[1]:
                at = visit(child)
                first = at if first is None else first
            labels.append(node[0])
            leftmost.append(len(labels) - 1 if first is None else first)
            return leftmost[-1]

        visit(tree)
        roots = sorted({left: i for i, left in enumerate(leftmost)}.values())
        return labels, leftmost, roots

    (la, fa, ra), (lb, fb, rb) = flat(a), flat(b)
    whole = [[0.0] * len(lb) for _ in la]
    for i in ra:
        for j in rb:
            rows, columns = i - fa[i] + 2, j - fb[j] + 2
            t = [[0.0] * columns for _ in range(rows)]
            for x in range(1, rows):
                t[x][0] = t[x - 1][0] + 1
            for y in range(1, columns):
                t[0][y] = t[0][y - 1] + 1
            for x in range(1, rows):
                for y in range(1, columns):
                    p, q = fa[i] + x - 1, fb[j] + y - 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        t[x][y] = min(t[x - 1][y] + 1, t[x][y - 1] + 1, t[x - 1][y - 1] + rename(la[p], lb[q]))
                        whole[p][q] = t[x][y]
                    else:
                        t[x][y] = min(t[x - 1][y] + 1, t[x][y - 1] + 1, t[fa[p] - fa[i]][fb[q] - fb[j]] + whole[p][q])
    return whole[-1][-1]


@lru_cache(maxsize=4096)
def _ratio(a: str, b: str) -> float:
    return distance(a, b) / max(len(a), len(b), 1)


def heading_tree(headings: list[tuple[int, str]]) -> tuple:
    """A tree of (level, text) under a root; a heading is below the last one with a smaller level."""
    root: tuple = ((0, ""), [])
    stack = [root]
    for level, text in headings:
        while stack[-1][0][0] >= level:
            stack.pop()
        node: tuple = ((level, text), [])
        stack[-1][1].append(node)
        stack.append(node)
    return root


def heading_distance(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> float:
    """Tree distance over the larger tree's nodes, roots not counted; 0 for two texts without headings."""
    if not a and not b:
        return 0.0
    cost = tree_distance(heading_tree(a), heading_tree(b), lambda x, y: _ratio(x[1], y[1]) if x[0] == y[0] else 1.0)
    return min(1.0, cost / max(len(a), len(b)))


def table_similarity(a: list[list[str]], b: list[list[str]], most_cells: int = 500) -> float | None:
    """Similarity of tables as trees of rows and cells; null for tables with more cells."""
    if max(sum(map(len, t)) for t in (a, b)) > most_cells:
        return None
    trees = [("table", [("row", [(f"cell:{c}", []) for c in row]) for row in t]) for t in (a, b)]
    sizes = [1 + len(t) + sum(map(len, t)) for t in (a, b)]
    both = ("cell:", "cell:")
    cost = tree_distance(*trees, lambda x, y: _ratio(x[5:], y[5:]) if (x[:5], y[:5]) == both else float(x != y))
    return 1 - cost / max(sizes)


@F.pandas_udf(T.DoubleType())
def table_similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarities of tables (arrays of rows); null where one is missing or too large."""

    def one(x, y):
        return None if x is None or y is None else table_similarity([list(r) for r in x], [list(r) for r in y])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def legacy_fidelity(cer: Column, heading_distance: Column, teds: Column) -> Column:
    """The mean of what is left of the text, the headings and, where there are tables, the tables."""

    def left(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x))

    return mean_of(left(cer), left(heading_distance), teds.cast("double"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes; 0 where one is degenerate."""
    width = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0.0))
    height = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))

    def area(x):
        return F.greatest(x["right"] - x["left"], F.lit(0.0)) * F.greatest(x["bottom"] - x["top"], F.lit(0.0))

    shared = width * height
    union = area(a) + area(b) - shared
    return F.when((area(a) > 0) & (area(b) > 0) & (union > 0), shared / union).otherwise(0.0)
