"""Rules over documents as tables: geometry and identifiers, references, assets, warnings, accessibility and integrity.

Every check is relational: anti-joins find what dangles, counts find what comes twice, arrays of conditions become issues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.markup import percent_decoded
from sheaf.sources.interchange import IDENTIFIER


def _ruled(name: str, rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("rule"), "n")


def violations(blocks: DataFrame, positions: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, rule, n) of documents that break a rule. blocks: key, id; positions: key, id, page_no, left, top, right, bottom;
    pages: key, page_no, width, height."""
    ids = blocks.select(key, "id").distinct()
    known = pages.select(key, "page_no").distinct()
    corners = [F.col(c) for c in ("left", "top", "right", "bottom")]
    infinite = reduce(lambda x, y: x | y, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in corners])
    size = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") < float("inf")) & (F.col("height") < float("inf")), F.lit(False))
    twice = blocks.groupBy(key, "id").agg(F.count("*").alias("c")).filter("c > 1")
    pages_twice = pages.groupBy(key, "page_no").agg(F.count("*").alias("c")).filter("c > 1")
    found = [
        _ruled("invalid_id", blocks.filter(~F.coalesce(F.col("id").rlike(f"^{IDENTIFIER}$"), F.lit(False))), key),
        _ruled("repeated_id", twice, key),
        _ruled("dangling_id", positions.join(ids, [key, "id"], "left_anti"), key),
        _ruled("missing_page", positions.join(known, [key, "page_no"], "left_anti"), key),
        _ruled("invalid_box", positions.filter(infinite | (F.col("right") < F.col("left")) | (F.col("bottom") < F.col("top"))), key),
        _ruled("invalid_page", pages.filter((F.col("page_no") < 1) | ~size), key),
        _ruled("repeated_page", pages_twice, key),
    ]
    return reduce(DataFrame.unionByName, found)


def resolved(refs: DataFrame, nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(references that claim a node, references to nothing). refs: key, ord, ref; nodes: key, ref and more. The first
    reference claims; later ones to the same node are left out."""
    order = Window.partitionBy(key, "ref").orderBy("ord")
    first = refs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return first.join(nodes, [key, "ref"]), refs.join(nodes.select(key, "ref"), [key, "ref"], "left_anti")


def footnote_faults(refs: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """(key, id, fault): references without a note, each once, and notes that nothing refers to."""
    missing = refs.select(key, "id").distinct().join(notes.select(key, "id"), [key, "id"], "left_anti")
    unused = notes.select(key, "id").distinct().join(refs.select(key, "id"), [key, "id"], "left_anti")
    return missing.withColumn("fault", F.lit("missing")).unionByName(unused.withColumn("fault", F.lit("unused")))


def asset_path(href: Column) -> Column:
    """The normalised path of a relative link inside its folder; null for links that have a scheme, are absolute, leave the
    folder, or hold backslashes, control characters, queries or broken escapes."""
    path = percent_decoded(href)
    plain = ~path.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|[\\\x00-\x1f\x7f?#]") & (path != "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at")),
        lambda acc, p: F.struct(
            (acc.ok & ((p != "..") | (F.size(acc["at"]) > 0))).alias("ok"),
            F.when((p == "..") & (F.size(acc["at"]) > 0), F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))))
            .when(p == "..", acc["at"]).otherwise(F.concat(acc["at"], F.array(p))).alias("at"),
        ),
    )
    return F.when(plain & walked.ok & (F.size(walked["at"]) > 0), F.array_join(walked["at"], "/"))


def with_assets(links: DataFrame, files: DataFrame, href: str) -> DataFrame:
    """Links with the digest of the file that they name, null where they stay links. files: path, digest."""
    out = links.withColumn("path", asset_path(F.col(href)))
    return out.join(files.select("path", "digest"), "path", "left")


def needs_ocr(pages: Column, text_pages: Column) -> Column:
    return text_pages < pages


#: A warning that says nothing about the tables.
STYLES_DROPPED = "styles_dropped"


def kept_warnings(warnings: Column) -> Column:
    return F.filter(warnings, lambda w: w != STYLES_DROPPED)


# Rules of the accessibility report, by the attribute that has to be there.
ACCESSIBILITY = (
    ("missing_marked_info", "marked"), ("missing_struct_tree_root", "structure"), ("missing_lang", "lang"),
    ("missing_display_doc_title", "title_shown"), ("missing_title", "title"),
)


def accessibility(docs: DataFrame, *key: str) -> DataFrame:
    """Per document: its issues in the order of the rules, their number, and whether it is tagged. Flags are booleans, lang and title texts."""
    there = {
        "marked": F.coalesce("marked", F.lit(False)), "structure": F.coalesce("structure", F.lit(False)), "title_shown": F.coalesce("title_shown", F.lit(False)),
        "lang": F.coalesce(F.trim("lang") != "", F.lit(False)), "title": F.coalesce(F.trim("title") != "", F.lit(False)),
    }
    issues = F.array_compact(F.array(*[F.when(~there[name], code) for code, name in ACCESSIBILITY]))
    return docs.select(*key, issues.alias("issues"), F.size(issues).alias("n_issues"), (there["marked"] & there["structure"]).alias("tagged"))


def numbered_lists(items: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Items with the list that they belong to: a number that doesn't follow the last one begins another list."""
    rows = Window.partitionBy(key).orderBy(order)
    starts = F.coalesce(F.lag(number).over(rows) + 1 != F.col(number), F.lit(True))
    return items.withColumn("list", F.sum(starts.cast("int")).over(rows)).withColumn("start", F.first(number).over(Window.partitionBy(key, "list").orderBy(order)))


def annotations_xfdf(annotations: DataFrame, key: str) -> DataFrame:
    """The annotations of a document (page, kind, contents) as one XFDF text, in the order of pages and of `id`."""
    def esc(x: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(raw), F.lit(entity))
        return x

    one = F.format_string('<%s page="%d" name="%s"><contents>%s</contents></%s>', "kind", "page", F.col("id").cast("string"), esc(F.col("contents")), "kind")
    rows = F.array_sort(F.collect_list(F.struct("page", "id", one.alias("xml"))))
    body = F.array_join(F.transform(rows, lambda r: r.xml), "")
    return annotations.groupBy(key).agg(F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'), body, F.lit("</annots></xfdf>")).alias("xfdf"))


def flattened(fields: DataFrame, pages: Column, names: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields that stay, texts that take the place of the others): fields on selected pages, or of the given names, become text."""
    chosen = pages if names is None else pages & names
    chosen = F.coalesce(chosen, F.lit(False))
    return fields.filter(~chosen), fields.filter(chosen & F.col("value").isNotNull()).select("doc", "page", F.col("value").alias("text"))


def manifest_faults(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(key, path, fault) of files that a manifest names: missing, of another size or digest, and files that it doesn't name."""
    both = manifest.alias("m").join(files.alias("f"), [key, "path"], "full_outer")
    fault = (
        F.when(F.col("f.digest").isNull(), "missing").when(F.col("m.digest").isNull(), "unlisted")
        .when(F.col("f.size") != F.col("m.size"), "size").when(F.col("f.digest") != F.col("m.digest"), "digest")
    )
    return both.select(key, "path", fault.alias("fault")).filter("fault is not null")


def table_pairs(left: DataFrame, right: DataFrame, key: str, place: str, table: str) -> DataFrame:
    """The i-th table with the i-th; a table without a partner has null on the other side."""
    a, b = left.select(key, place, F.col(table).alias("a")), right.select(key, place, F.col(table).alias("b"))
    return a.join(b, [key, place], "full_outer")
