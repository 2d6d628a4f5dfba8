"""Recipes: steps that run one after the other, with predicates and error policies; and policies for addresses.

A predicate is text such as `page_count > 10` or `!needs_ocr`, compiled to a Column. A number that is unknown makes every comparison
false, inequality included.
"""

from __future__ import annotations

import hashlib
import json
import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
NUMBERS, FLAGS = ("page_count", "size_bytes"), ("needs_ocr", "is_encrypted", "has_signatures")


class RecipeError(ValueError):
    pass


def predicate(text: str) -> Column:
    plain = text.strip()
    if m := re.fullmatch(rf"({'|'.join(NUMBERS)})\s*(>=|<=|==|!=|>|<)\s*(\d+)", plain):
        return F.coalesce(_COMPARE[m[2]](F.col(m[1]), F.lit(int(m[3]))), F.lit(False))
    if m := re.fullmatch(rf"(!?)\s*({'|'.join(FLAGS)})", plain):
        flag = F.coalesce(F.col(m[2]), F.lit(False))
        return ~flag if m[1] else flag
    if m := re.fullmatch(r"format\s*(==|!=)\s*\"?([A-Za-z0-9]+)\"?", plain):
        return F.coalesce(_COMPARE[m[1]](F.lower("format"), F.lit(m[2].lower())), F.lit(False))
    raise RecipeError(f"recipe predicate: cannot read {text!r}")


POLICIES = ("stop", "skip", "continue")


def run(df: DataFrame, steps: list[dict], tools: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run steps {tool, if, on_error} over df; every row is an item with a recipe run of its own.

    A row whose predicate doesn't hold passes a step by. A tool marks a row that it can't work on in the column `error`; the step's
    on_error decides what becomes of the row: `stop` (the default) ends its run, so it keeps the mark and all later steps pass it
    by; `skip` drops it; `continue` hands it on as it was before the step. The latter notes the fault in `warnings`. A tool that
    raises fails for all rows at once: `stop` raises, the others treat every row of the step as marked.
    """

    def step(frame: DataFrame, numbered: tuple[int, dict]) -> DataFrame:
        number, spec = numbered
        policy = spec.get("on_error", "stop")
        if spec["tool"] not in tools:
            raise RecipeError(f"unknown tool {spec['tool']!r}")
        if policy not in POLICIES:
            raise RecipeError(f"unknown policy {policy!r}")
        fits = F.col("error").isNull()
        if spec.get("if"):
            fits = fits & predicate(spec["if"])
        mine, others = frame.filter(fits), frame.filter(~fits)
        try:
            done = tools[spec["tool"]](mine.withColumn("__before", F.struct(*[F.col(f"`{c}`") for c in frame.columns])))
        except Exception as fault:
            if policy == "stop":
                raise RecipeError(f"step {number}: {fault}") from fault
            done = mine.withColumn("__before", F.struct(*[F.col(f"`{c}`") for c in frame.columns])).withColumn("error", F.lit(str(fault)))
        failed = F.col("error").isNotNull()
        if policy == "skip":
            done = done.filter(~failed)
        elif policy == "continue":
            note = F.concat(F.col("warnings"), F.array(F.concat(F.lit(f"step {number}: "), "error")))
            old = {c: F.when(failed, F.col("__before")[c]).otherwise(F.col(f"`{c}`")).alias(c) for c in frame.columns if c not in ("error", "warnings")}
            new = [F.col(f"`{c}`") for c in done.columns if c not in (*frame.columns, "__before")]
            done = done.select(*old.values(), *new, F.lit(None).cast("string").alias("error"), F.when(failed, note).otherwise(F.col("warnings")).alias("warnings"))
        return done.drop("__before").unionByName(others, allowMissingColumns=True)

    start = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    start = start if "warnings" in start.columns else start.withColumn("warnings", F.array().cast("array<string>"))
    return reduce(step, enumerate(steps, 1), start)


def recipe_key(recipe: dict) -> str:
    """A key that doesn't depend on the order of a recipe's keys."""
    return hashlib.sha256(json.dumps(recipe, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# Address blocks that aren't public, as (first address, prefix length).
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def address_value(address: Column) -> Column:
    parts = F.split(address, r"\.")
    value = reduce(lambda acc, i: acc * 256 + F.get(parts, i).try_cast("long"), range(1, 4), F.get(parts, 0).try_cast("long"))
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$") & ~address.endswith("."), value)


def is_public(address: Column) -> Column:
    """Whether an IPv4 address is public; what isn't an address is not."""

    def outside(value: Column) -> Column:
        inside = F.lit(False)
        for first, bits in PRIVATE:
            low = reduce(lambda acc, p: acc * 256 + int(p), first.split("."), 0)
            inside = inside | value.between(low, low + (1 << (32 - bits)) - 1)
        return value.isNotNull() & ~inside

    # as an array's element the value is worked out once
    return F.coalesce(F.get(F.transform(F.array(address_value(address)), outside), 0), F.lit(False))


def tool_allowed(plan: Column, files: Column, total_bytes: Column) -> Column:
    """The free plan takes 25 files and 250 MB at once."""
    return F.when(plan == "free", (files <= 25) & (total_bytes <= 250 * 1_000_000)).otherwise(F.lit(True))
