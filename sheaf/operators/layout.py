"""From positioned lines to document structure: body size, headings, running heads, hyphens and list markers.

A line is a row (doc, page, ord, text, size, bold, top, height of the page). Everything is a grouped aggregate or a window by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.text import is_page_number, running_text

# Fixed values of the rules.
HEADING_RATIO, HEADING_LINES, HEADING_CHARS, DEEPEST = 1.15, 3, 200, 3
ZONE = 0.12


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc, body): the half-point size with most characters, the smaller one on a tie."""
    sizes = lines.groupBy("doc", (F.round(F.col("size") * 2) / 2).alias("half")).agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc").agg(F.max_by("half", F.struct("chars", -F.col("half"))).alias("body"))


def headings(lines: DataFrame) -> DataFrame:
    """Lines with `level`: larger than the body, short, not in lower case and not cut off; larger sizes are higher levels."""
    out = lines.join(body_sizes(lines), "doc")
    shaped = (F.length("text") <= HEADING_CHARS) & ~F.col("text").rlike(r"^\p{Ll}") & ~F.col("text").rlike(r"[-,]\s*$")
    out = out.withColumn("is_heading", shaped & (F.col("size") / F.col("body") >= HEADING_RATIO))
    place = F.dense_rank().over(Window.partitionBy("doc", "is_heading").orderBy(F.desc("size")))
    return out.withColumn("level", F.when(F.col("is_heading"), F.least(place, F.lit(DEEPEST)))).drop("is_heading", "body")


def furniture(lines: DataFrame) -> DataFrame:
    """(doc, ord, page) of page numbers and of texts that come back in the outer zones of at least a fifth of the pages."""
    zone = F.when(F.col("top") <= ZONE * F.col("height"), "head").when(F.col("top") >= (1 - ZONE) * F.col("height"), "foot")
    outer = lines.withColumn("zone", zone).filter(F.col("zone").isNotNull() & (F.length("text") <= HEADING_CHARS)).withColumn("form", running_text(F.col("text")))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    often = outer.groupBy("doc", "zone", "form").agg(F.count_distinct("page").alias("on")).join(pages, "doc")
    often = often.filter(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 5))).select("doc", "zone", "form", F.lit(True).alias("often"))
    out = outer.join(often, ["doc", "zone", "form"], "left")
    return out.filter(F.coalesce("often", F.lit(False)) | is_page_number(F.col("text"))).select("doc", "page", "ord")


def list_marker(text: Column) -> Column:
    """The marker at the begin of a line: a bullet, a dash, 1. a) or (iv)."""
    found = F.regexp_extract(text, r"^\s*([•◦▪‣*–-]|\(?(?:[0-9]{1,3}|[a-z]|[ivxl]{1,5})[.)])\s+\S", 1)
    return F.nullif(found, F.lit(""))


def joined_hyphens(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Lines that end in a hyphen with the next line's first word: merged if the vocabulary has the whole, else hyphenated.

    vocabulary: word. A line's last word part and the next line's first word are looked up together.
    """
    after = F.lead("text").over(Window.partitionBy("doc").orderBy("page", "ord"))
    cut = lines.withColumn("head", F.regexp_extract("text", r"(\p{L}+)-$", 1)).withColumn("tail", F.regexp_extract(after, r"^(\p{L}+)", 1))
    cut = cut.filter("head <> '' AND tail <> ''").withColumn("whole", F.lower(F.concat("head", "tail")))
    known = vocabulary.select(F.col("word").alias("whole"), F.lit(True).alias("known"))
    out = cut.join(known, "whole", "left")
    return out.select("doc", "page", "ord", F.when(F.col("known"), F.concat("head", "tail")).otherwise(F.concat_ws("-", "head", "tail")).alias("word"))


def outline(heads: DataFrame) -> DataFrame:
    """(doc, ord, level, parent): a heading's parent is the last one before it with a smaller level."""
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for level in range(2, 7):
        last = F.max(F.when(F.col("level") < level, F.col("ord"))).over(before)
        parent = F.when(F.col("level") == level, last).otherwise(parent)
    return heads.select("doc", "ord", "level", parent.alias("parent"))


def layout_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Boxes of two layouts (doc, text, page, id) matched one to one: first by text and page, the rest by text alone."""

    def numbered(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy("doc", *keys).orderBy("id")))

    a, b = numbered(left, "text", "page"), numbered(right, "text", "page").withColumnRenamed("id", "other")
    first = a.join(b, ["doc", "text", "page", "k"]).select("doc", "id", "other", F.lit(1).alias("step"))
    rest_a = numbered(left.join(first, ["doc", "id"], "left_anti"), "text")
    rest_b = numbered(right.join(first.select("doc", F.col("other").alias("id")), ["doc", "id"], "left_anti"), "text").withColumnRenamed("id", "other")
    second = rest_a.join(rest_b.drop("page"), ["doc", "text", "k"]).select("doc", "id", "other", F.lit(2).alias("step"))
    return first.unionByName(second)
