"""What documents carry besides text, as tables: annotations, form fields, attachments, layers, preferences and active content."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest size that a compressed stream may have when unpacked.
MOST_BYTES = 64 << 20
READ_ONLY = 1
# Kinds of active content by category.
ACTIVE = {"script": ("javascript", "launch"), "link": ("uri", "goto_remote"), "media": ("rich_media", "sound", "movie"), "form": ("submit_form", "import_data")}


def edited(table: DataFrame, key: str, changes: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A table after edits: rows of `removed` go, columns of `changes` that are set replace, rows of `added` come."""
    columns = [c for c in changes.columns if c != key]
    out = table.join(removed.select(key), key, "left_anti")
    out = out.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    out = out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])
    return out.unionByName(added)


def dotted_names(fields: DataFrame, steps: int = 8) -> DataFrame:
    """(id, name): names of form fields from the root on, joined by dots; fields: id, parent, part. Fields below more
    than `steps` others are an error."""
    out = fields.select("id", F.col("parent").alias("at"), F.col("part").alias("name"))
    up = F.broadcast(fields.select(F.col("id").alias("at"), F.col("parent").alias("up"), F.col("part").alias("more")))
    for _ in range(steps):
        out = out.join(up, "at", "left").select("id", F.col("up").alias("at"), F.concat_ws(".", "more", "name").alias("name"))
    deep = F.raise_error(F.concat(F.lit("field nested too deep: "), F.col("id").cast("string")))
    return out.filter(F.when(F.col("at").isNull(), F.lit(True)).otherwise(deep.cast("boolean"))).select("id", "name")


def unlocked(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(~READ_ONLY))


def without_active(actions: Column, categories: list[str]) -> Column:
    """An array of actions (kind, ...) without those of the categories."""
    kinds = F.array(*[F.lit(k) for c in categories for k in ACTIVE[c]])
    return F.filter(actions, lambda a: ~F.array_contains(kinds, a.kind))


def category(kind: Column) -> Column:
    out = F.lit("other")
    for name, kinds in ACTIVE.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def toggled(layers: Column, names: list[str], visible: bool) -> Column:
    """An array of layers (name, visible) with the named ones switched."""
    return F.transform(layers, lambda x: x.withField("visible", F.when(x["name"].isin(*names), F.lit(visible)).otherwise(x["visible"])))


@F.pandas_udf(T.BinaryType())
def unpacked_stream(data: pd.Series) -> pd.Series:
    """Deflated bytes unpacked; null where they are damaged or larger than MOST_BYTES."""

    def unpack(x):
        if x is None:
            return None
        job = zlib.decompressobj()
        try:
            out = job.decompress(x, MOST_BYTES)
        except zlib.error:
            return None
        return None if job.unconsumed_tail else out

    return data.map(unpack)


def sealed(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"))


def opened(data: Column, key: Column) -> Column:
    """The content, or null under another key."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))
