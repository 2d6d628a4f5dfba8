"""Page-sequence algebra over a plan table with one row per page: (doc, page, ...), pages numbered from 1.

All operators are joins, windows and expressions over that table; windows are partitioned by document, whose number of pages is
bounded. An output page has `doc`, `position` (from 1) and the columns of the page that it shows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheaf.operators.prefix import running



class SelectorError(ValueError):
    pass


def _bound(token: str) -> tuple[str, int]:
    """A page as ('at', n) or counted back from the last one as ('back', k)."""
    if token == "last":
        return "back", 0
    if token.startswith("last-"):
        return "back", int(token[5:])
    return "at", int(token)


def parse_selector(selector: str) -> list[tuple]:
    """('all' | 'even' | 'odd',), or ('range', first, last) with bounds as in _bound; errors name the token."""
    out: list[tuple] = []
    for token in selector.replace(" ", "").split(","):
        number = r"(?:\d+|last(?:-\d+)?)"
        if token in ("all", "even", "odd"):
            out.append((token,))
        elif m := re.fullmatch(number, token):
            out.append(("range", _bound(token), _bound(token)))
        elif m := re.fullmatch(rf"({number})-({number})", token):
            out.append(("range", _bound(m[1]), _bound(m[2])))
        elif m := re.fullmatch(r"(\d+)-", token):
            out.append(("range", _bound(m[1]), ("back", 0)))
        elif m := re.fullmatch(r"-(\d+)", token):
            out.append(("range", ("at", 1), _bound(m[1])))
        else:
            raise SelectorError(f"page selector: cannot read {token!r}")
    for kind, *bounds in out:
        if kind == "range" and ("at", 0) in bounds:
            raise SelectorError("page selector: pages are numbered from 1")
    return out


def expand(selector: str, n: int, duplicates: str = "keep") -> list[int]:
    """The pages that a selector names in a document of n pages, in order; a range whose start is larger runs down."""
    pages: list[int] = []
    for kind, *bounds in parse_selector(selector):
        if kind != "range":
            pages += [p for p in range(1, n + 1) if kind == "all" or p % 2 == (kind == "odd")]
            continue
        first, last = (v if how == "at" else n - v for how, v in bounds)
        for p in (first, last):
            if not 1 <= p <= n:
                raise SelectorError(f"page selector: page {p} of {n}")
        pages += range(first, last + 1) if first <= last else range(first, last - 1, -1)
    if duplicates == "reject" and len(set(pages)) < len(pages):
        raise SelectorError("page selector: a page is named twice")
    return pages


def expand_column(selector: str, n: Column) -> Column:
    """The same as an array column; pages that a document does not have are left out, so that one selector serves all documents."""
    parts = []
    whole = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    for kind, *bounds in parse_selector(selector):
        if kind == "all":
            parts.append(whole)
        elif kind in ("even", "odd"):
            odd = int(kind == "odd")
            parts.append(F.filter(whole, lambda p: p % 2 == odd))
        else:
            first, last = (F.lit(v) if how == "at" else n - v for how, v in bounds)
            inside = (first >= 1) & (last >= 1) & (first <= n) & (last <= n)
            parts.append(F.when(inside, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


def selector_error(selector: str, n: Column) -> Column:
    """Which token of a selector names a page that a document of n pages doesn't have; null where all are there."""
    found = []
    for token in selector.replace(" ", "").split(","):
        kind, *bounds = parse_selector(token)[0]
        if kind == "even":
            beyond = n < 2
        elif kind != "range":
            beyond = n < 1
        else:
            first, last = (F.lit(v) if how == "at" else n - v for how, v in bounds)
            beyond = (F.least(first, last) < 1) | (F.greatest(first, last) > n)
        found.append(F.when(beyond, F.lit(token)))
    return F.when(n < 1, F.lit(selector.replace(" ", "").split(",")[0])).otherwise(F.coalesce(*found))


def counted(pages: DataFrame) -> DataFrame:
    """One row per document with its number of pages, n."""
    return pages.groupBy("doc").agg(F.max("page").cast("int").alias("n"))


def selected(pages: DataFrame, selector: str) -> DataFrame:
    """(doc, page) of the pages that a selector names, each once."""
    return counted(pages).select("doc", F.explode(F.array_distinct(expand_column(selector, F.col("n")))).alias("page"))


def extract(pages: DataFrame, selector: str) -> DataFrame:
    """The named pages in the selector's order, duplicates included."""
    plan = counted(pages).select("doc", F.posexplode(expand_column(selector, F.col("n"))).alias("position", "page"))
    return plan.withColumn("position", F.col("position") + 1).join(pages, ["doc", "page"])


def delete(pages: DataFrame, selector: str) -> DataFrame:
    """The other pages, renumbered; a document that would lose all its pages keeps them."""
    out = pages.join(selected(pages, selector).withColumn("gone", F.lit(True)), ["doc", "page"], "left")
    own = Window.partitionBy("doc")
    out = out.withColumn("left", F.count_if(F.col("gone").isNull()).over(own)).filter(F.col("gone").isNull() | (F.col("left") == 0))
    return renumbered(out.drop("gone", "left"), "page")


def renumbered(pages: DataFrame, *order: str | Column) -> DataFrame:
    return pages.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def reorder(pages: DataFrame, preset: str) -> DataFrame:
    """reverse, duplex-interleave (1, n, 2, n - 1, ...) or odd-then-even."""
    n = F.max("page").over(Window.partitionBy("doc"))
    page = F.col("page")
    keys = {
        "reverse": -page,
        "duplex-interleave": F.when(page <= F.ceil(n / 2), 2 * (page - 1)).otherwise(2 * (n - page) + 1),
        "odd-then-even": F.struct(page % 2 == 0, page),
    }
    return renumbered(pages.withColumn("key", keys[preset]), "key").drop("key")


def split_every(pages: DataFrame, every: int) -> DataFrame:
    return pages.withColumn("part", F.floor((F.col("page") - 1) / every).cast("long"))


def split_at(pages: DataFrame, starts: Column) -> DataFrame:
    """A new part begins at every page for which `starts` holds; the first part begins at page 1 anyway."""
    begins = F.when(starts & (F.col("page") > 1), 1).otherwise(0)
    return pages.withColumn("part", F.sum(begins).over(Window.partitionBy("doc").orderBy("page")))


def greedy_parts(sizes: list[float], most: float) -> list[int]:
    """The part of each page: as many pages as fit; a page that alone reaches the limit is a part of its own."""
    part, used, out = -1, None, []
    for size in sizes:
        if used is None or used + size > most:
            part, used = part + 1, 0.0
        used += size
        out.append(part)
    return out


def split_by_size(pages: DataFrame, size: str, most: float) -> DataFrame:
    """Greedy parts of each document; its sizes travel as one array, so that a batch of documents is one call."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def parts(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: greedy_parts(list(x), most))

    ordered = F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), F.col(size).cast("double").alias("size"))))
    docs = pages.groupBy(F.col("doc").cast("long").alias("doc")).agg(ordered.alias("p"))
    both = F.arrays_zip(F.transform("p", lambda x: x["page"]).alias("page"), parts(F.transform("p", lambda x: x["size"])).alias("part"))
    return docs.select("doc", F.inline(both))


def merge(*frames: DataFrame) -> DataFrame:
    """All pages of the inputs, document by document, in the order of inputs; `source` tells from which."""
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("source", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return renumbered(out, "source", "page")


def alternate(first: DataFrame, second: DataFrame, reverse_second: bool = False) -> DataFrame:
    """The pages of two inputs in turn, the rest of the longer one at the end."""
    turn = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("page") if reverse_second else F.asc("page")))
    a = first.withColumn("source", F.lit(0)).withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("page")))
    b = second.withColumn("source", F.lit(1)).withColumn("turn", turn)
    return renumbered(a.unionByName(b), "turn", "source").drop("turn")


def insert_blank(pages: DataFrame, selector: str) -> DataFrame:
    """A blank page of the same size after every named page."""
    after = pages.join(selected(pages, selector), ["doc", "page"]).withColumn("blank", F.lit(True))
    out = pages.withColumn("blank", F.lit(False)).unionByName(after)
    return renumbered(out, "page", "blank")


def nup(pages: DataFrame, columns: int, rows: int) -> DataFrame:
    """Sheet, slot and the slot's row and column, all from 0."""
    k = F.col("page") - 1
    out = pages.withColumn("sheet", F.floor(k / (columns * rows)).cast("long")).withColumn("slot", (k % (columns * rows)).cast("long"))
    return out.withColumn("row", F.floor(F.col("slot") / columns).cast("long")).withColumn("column", F.col("slot") % columns)


def booklet(pages: DataFrame) -> DataFrame:
    """Saddle-stitch spreads: pages are padded to a multiple of four; page is null where a leaf is blank.

    Side s of spread k holds pages (total - k, k + 1) on even spreads and (k + 1, total - k) on odd ones.
    """
    total = (F.ceil(F.col("n") / 4) * 4).cast("int")
    spreads = counted(pages).select("doc", "n", total.alias("total"), F.explode(F.sequence(F.lit(0), (total / 2).cast("int") - 1)).alias("spread"))
    low, high = F.col("spread") + 1, F.col("total") - F.col("spread")
    even = F.col("spread") % 2 == 0
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.when(even, high).otherwise(low).alias("page")), F.struct(F.lit(1).alias("side"), F.when(even, low).otherwise(high).alias("page"))))
    out = spreads.select("doc", "n", "spread", sides.alias("s")).select("doc", "n", "spread", "s.side", "s.page")
    return out.withColumn("page", F.when(F.col("page") <= F.col("n"), F.col("page"))).drop("n")


def divide(pages: DataFrame, columns: int, rows: int, width: Column, height: Column) -> DataFrame:
    """Every page cut into a grid, cells in reading order, with their boxes from the top left corner."""
    cells = pages.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    w, h = width / columns, height / rows
    out = cells.withColumn("left", F.col("column") * w).withColumn("top", F.col("row") * h).withColumn("right", (F.col("column") + 1) * w).withColumn("bottom", (F.col("row") + 1) * h)
    return renumbered(out, "page", "row", "column")


def posterize(pages: DataFrame, columns: int, rows: int, overlap: float, width: Column, height: Column) -> DataFrame:
    """Tiles of an enlarged page that overlap inside the page."""
    out = divide(pages, columns, rows, width, height)
    return (
        out.withColumn("left", F.greatest(F.col("left") - overlap, F.lit(0.0)))
        .withColumn("top", F.greatest(F.col("top") - overlap, F.lit(0.0)))
        .withColumn("right", F.least(F.col("right") + overlap, width))
        .withColumn("bottom", F.least(F.col("bottom") + overlap, height))
    )


def overlay(base: DataFrame, over: DataFrame, selector: str, repeat: bool = True) -> DataFrame:
    """Pages of a second document on the named pages of the first, in turn; the last or the first again when they run out."""
    plan = base.join(selected(base, selector).withColumn("chosen", F.lit(True)), ["doc", "page"], "left")
    turn = F.row_number().over(Window.partitionBy("doc", "chosen").orderBy("page"))
    plan = plan.join(counted(over).withColumnRenamed("n", "over_n"), "doc", "left")
    pick = F.pmod(turn - 1, F.col("over_n")) + 1 if repeat else F.least(turn, F.col("over_n"))
    return plan.withColumn("over_page", F.when(F.col("chosen"), pick)).drop("chosen", "over_n")


def bates(pages: DataFrame, prefix: str, digits: int, suffix: str, start: int, *order: str) -> DataFrame:
    """Consecutive numbers over all pages in the given order; a number that has more digits is an error.

    Numbers run over documents, so counts per document are summed first and every document starts from its own offset.
    """
    sizes = running(counted(pages), ["doc"], "n", F.sum, "offset").fillna(0, ["offset"])
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*order)) + F.col("offset") + (start - 1)
    out = pages.join(sizes.select("doc", "offset"), "doc").withColumn("number", place)
    text = F.when(F.col("number") >= 10**digits, F.raise_error(F.lit(f"a number has more than {digits} digits")).cast("string")).otherwise(
        F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), digits, "0"), F.lit(suffix))
    )
    return out.withColumn("stamp", text).drop("number", "offset")


def roman(value: Column) -> Column:
    """Lower-case roman numerals of 1 to 3999 by digits."""
    # fixed values: the ten forms of each digit
    forms = [
        ["", "m", "mm", "mmm"],
        ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"],
        ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"],
        ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"],
    ]
    digits = (F.floor(value / 1000), F.floor(value / 100) % 10, F.floor(value / 10) % 10, value % 10)
    return F.concat(*[F.element_at(F.array(*map(F.lit, f)), (d + 1).cast("int")) for f, d in zip(forms, digits, strict=True)])


def alphabetic(value: Column) -> Column:
    """a to z, then aa, bb and so on."""
    letter = F.char((F.lit(97) + (value - 1) % 26).cast("int"))
    return F.repeat(letter, (F.floor((value - 1) / 26) + 1).cast("int"))


def labels(pages: DataFrame, ranges: list[tuple[int, str, str, int]]) -> DataFrame:
    """Labels by the last range (from page, style, prefix, start) that begins at or before a page; decimal numbers without one.
    The ranges serve all documents and are part of the plan, so nothing is joined."""
    names = ("from_page", "style", "prefix", "start")
    found = F.lit(None).cast("struct<from_page:int,style:string,prefix:string,start:int>")
    for values in sorted(ranges, key=lambda r: r[0]):
        found = F.when(F.col("page") >= values[0], F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])).otherwise(found)
    out = pages.select("doc", "page", found.alias("r")).select("doc", "page", "r.*")
    number = (F.coalesce("start", F.lit(1)) + F.col("page") - F.coalesce("from_page", F.lit(1))).cast("int")
    style = F.coalesce("style", F.lit("decimal"))
    text = F.when(style == "roman", roman(number)).when(style == "alpha", alphabetic(number)).when(style == "none", "").otherwise(number.cast("string"))
    return out.select("doc", "page", F.concat(F.coalesce("prefix", F.lit("")), text).alias("label"))


def stamped(template: str, page: Column, pages: Column, title: Column, date: str) -> Column:
    """Header or footer text with its tokens expanded."""
    out = F.lit(template)
    for token, value in (("{page}", page.cast("string")), ("{pages}", pages.cast("string")), ("{title}", title), ("{date}", F.lit(date))):
        out = F.replace(out, F.lit(token), value)
    return out


def rotate(pages: DataFrame, selector: str, angle: int) -> DataFrame:
    out = pages.join(selected(pages, selector).withColumn("chosen", F.lit(True)), ["doc", "page"], "left")
    return out.withColumn("rotation", F.when(F.col("chosen"), F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation"))).drop("chosen")


def cropped(box: dict[str, Column], limits: dict[str, Column]) -> dict[str, Column]:
    """A box inside the limits."""
    return {k: (F.greatest if k in ("left", "top") else F.least)(box[k], limits[k]) for k in ("left", "top", "right", "bottom")}


def scaled(width: Column, height: Column, to_width: float, to_height: float) -> tuple[Column, Column, Column]:
    """Scale and offsets that place a page in the middle of a paper."""
    scale = F.least(F.lit(to_width) / width, F.lit(to_height) / height)
    return scale, (F.lit(to_width) - width * scale) / 2, (F.lit(to_height) - height * scale) / 2


def stacked(pages: DataFrame, width: str, height: str) -> DataFrame:
    """One long page per document: every page's offset from the top, and the size of the whole."""
    own = Window.partitionBy("doc")
    top = F.coalesce(F.sum(height).over(own.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return pages.withColumn("top", top).withColumn("total_width", F.max(width).over(own)).withColumn("total_height", F.sum(height).over(own))


def turned(width: Column, height: Column, degrees: float) -> tuple[Column, Column]:
    """Width and height of the box around a page that is turned by any angle."""
    c, s = F.abs(F.cos(F.radians(F.lit(degrees)))), F.abs(F.sin(F.radians(F.lit(degrees))))
    return width * c + height * s, width * s + height * c


# Names and sizes of papers in points.
PAPERS = (("a5", 419.53, 595.28), ("a4", 595.28, 841.89), ("a3", 841.89, 1190.55), ("letter", 612.0, 792.0), ("legal", 612.0, 1008.0))


def paper(width: Column, height: Column, tolerance: float = 2.0) -> Column:
    """The paper of a page, either way up."""
    out = F.lit(None).cast("string")
    for name, w, h in reversed(PAPERS):
        small, large = F.least(width, height), F.greatest(width, height)
        out = F.when((F.abs(small - w) <= tolerance) & (F.abs(large - h) <= tolerance), name).otherwise(out)
    return out


def scan_verdict(chars: Column, coverage: Column) -> Column:
    """Of a page: scanned, mixed or digital, by its text and by how much of it images cover."""
    return (
        F.when((chars < 1) & (coverage > 0), "scanned").when((chars >= 1) & (coverage >= 0.25), "mixed").otherwise("digital")
    )


def repeated_marks(marks: DataFrame, pages: DataFrame, mark: str, least: float = 0.6) -> DataFrame:
    """Marks that stand on at least this share of a document's pages: candidates for watermarks."""
    out = marks.groupBy("doc", mark).agg(F.count_distinct("page").alias("pages")).join(counted(pages), "doc")
    return out.withColumn("ratio", F.round(F.col("pages") / F.col("n"), 6)).filter(F.col("ratio") >= least).drop("n")


def contents(headings: DataFrame, per_page: int) -> DataFrame:
    """Entries of a contents page with page numbers shifted by the pages that the contents take."""
    n = F.count("*").over(Window.partitionBy("doc"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    taken = F.ceil(n / per_page).cast("long")
    return headings.withColumn("entry", place).withColumn("toc_page", F.ceil(place / per_page).cast("long")).withColumn("shown_page", F.col("page") + taken)


