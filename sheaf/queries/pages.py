"""Page queries: line items stand in for pages (document = order, page = place among its line items)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators import pages as P
from sheaf.queries.registry import query

SQL_PAGES = """
    pages AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS page,
                     l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag, l_partkey AS part_key FROM lineitem),
    sizes AS (SELECT doc, max(page) AS n FROM pages GROUP BY 1)"""


def plan(t, *more):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(own).alias("page"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part_key"), *more,
    )


@query(f"""
    WITH {SQL_PAGES}, sel AS (SELECT doc, unnest(list_concat([n], CASE WHEN n >= 2 THEN [2, 1] ELSE [] END, list_filter(range(1, n + 1), lambda p: p % 2 = 1))) AS page,
                              generate_subscripts(list_concat([n], CASE WHEN n >= 2 THEN [2, 1] ELSE [] END, list_filter(range(1, n + 1), lambda p: p % 2 = 1)), 1) AS position FROM sizes)
    SELECT s.doc, position::INT AS position, s.page::INT AS page, part_key FROM sel s JOIN pages p ON s.doc = p.doc AND s.page = p.page""")
def page_range_extract(t):
    return P.extract(plan(t), "last,2-1,odd").select("doc", "position", "page", "part_key")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, row_number() OVER (PARTITION BY doc ORDER BY page)::INT AS position FROM pages WHERE page % 2 = 1""")
def page_range_delete(t):
    return P.delete(plan(t), "even").select("doc", "page", "position")


@query(f"""WITH {SQL_PAGES} SELECT doc, page::INT AS page, (n + 1 - page)::INT AS position FROM pages JOIN sizes USING (doc)""")
def page_reverse(t):
    return P.reorder(plan(t), "reverse").select("doc", "page", "position")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN page <= ceil(n / 2) THEN 2 * (page - 1) ELSE 2 * (n - page) + 1 END)::INT AS position
    FROM pages JOIN sizes USING (doc)""")
def page_duplex(t):
    return P.reorder(plan(t), "duplex-interleave").select("doc", "page", "position")


@query(f"""WITH {SQL_PAGES} SELECT doc, page::INT AS page, row_number() OVER (PARTITION BY doc ORDER BY page % 2 = 0, page)::INT AS position FROM pages""")
def page_odd_even(t):
    return P.reorder(plan(t), "odd-then-even").select("doc", "page", "position")


@query(f"""WITH {SQL_PAGES} SELECT doc, page::INT AS page, (page - 1) // 3 AS part FROM pages""")
def split_every(t):
    return P.split_every(plan(t), 3).select("doc", "page", "part")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, sum(CASE WHEN flag = 'R' AND page > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page)::BIGINT AS part FROM pages""")
def split_flags(t):
    return P.split_at(plan(t), F.col("flag") == "R").select("doc", "page", "part")


@query(f"""
    WITH RECURSIVE {SQL_PAGES},
    r AS (SELECT doc, page, 0::BIGINT AS part, qty AS used FROM pages WHERE page = 1
          UNION ALL SELECT p.doc, p.page, CASE WHEN used + qty > 60 THEN part + 1 ELSE part END, CASE WHEN used + qty > 60 THEN qty ELSE used + qty END
          FROM r JOIN pages p ON p.doc = r.doc AND p.page = r.page + 1)
    SELECT doc, page::INT AS page, part FROM r""")
def split_size(t):
    return P.split_by_size(plan(t), "qty", 60.0)


@query(f"""
    WITH {SQL_PAGES}, b AS (SELECT doc, page, 0 AS source FROM pages UNION ALL SELECT doc, page, 1 FROM pages WHERE flag = 'A')
    SELECT doc, page::INT AS page, source, row_number() OVER (PARTITION BY doc ORDER BY source, page)::INT AS position FROM b""")
def merge_docs(t):
    pages = plan(t)
    return P.merge(pages, pages.filter("flag = 'A'")).select("doc", "page", "source", "position")


@query(f"""
    WITH {SQL_PAGES}, b AS (SELECT doc, page, 0 AS source, row_number() OVER (PARTITION BY doc ORDER BY page) AS turn FROM pages
                            UNION ALL SELECT doc, page, 1, row_number() OVER (PARTITION BY doc ORDER BY page DESC) FROM pages WHERE flag <> 'R')
    SELECT doc, page::INT AS page, source, row_number() OVER (PARTITION BY doc ORDER BY turn, source)::INT AS position FROM b""")
def alternate_mix(t):
    pages = plan(t)
    return P.alternate(pages, pages.filter("flag <> 'R'"), True).select("doc", "page", "source", "position")


@query(f"""
    WITH {SQL_PAGES}, b AS (SELECT doc, page, false AS blank FROM pages UNION ALL SELECT doc, page, true FROM pages WHERE page % 2 = 0)
    SELECT doc, page::INT AS page, blank, row_number() OVER (PARTITION BY doc ORDER BY page, blank)::INT AS position FROM b""")
def insert_blank(t):
    return P.insert_blank(plan(t), "even").select("doc", "page", "blank", "position")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, (page - 1) // 4 AS sheet, (page - 1) % 4 AS slot, ((page - 1) % 4) // 2 AS row, (page - 1) % 2 AS "column" FROM pages""")
def nup_slots(t):
    return P.nup(plan(t), 2, 2).select("doc", "page", "sheet", "slot", "row", "column")


@query(f"""
    WITH {SQL_PAGES}, s AS (SELECT doc, n, (ceil(n / 4) * 4)::INT AS total FROM sizes),
    k AS (SELECT doc, n, total, unnest(range(0, total // 2))::INT AS spread FROM s),
    q AS (SELECT doc, n, spread, 0 AS side, CASE WHEN spread % 2 = 0 THEN total - spread ELSE spread + 1 END AS page FROM k
          UNION ALL SELECT doc, n, spread, 1, CASE WHEN spread % 2 = 0 THEN spread + 1 ELSE total - spread END FROM k)
    SELECT doc, spread, side, CASE WHEN page <= n THEN page END AS page FROM q""")
def booklet(t):
    return P.booklet(plan(t))


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, row_number() OVER (PARTITION BY doc ORDER BY page, r, c)::INT AS position,
           round(c * price / 2, 4) AS "left", round(r * qty / 2, 4) AS top FROM pages, (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c)""")
def divide_pages(t):
    out = P.divide(plan(t), 2, 2, F.col("price"), F.col("qty"))
    return out.select("doc", "page", "position", F.round("left", 4).alias("left"), F.round("top", 4).alias("top"))


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, row_number() OVER (PARTITION BY doc ORDER BY page, c)::INT AS position,
           round(greatest(c * price / 2 - 10, 0), 4) AS "left", round(least((c + 1) * price / 2 + 10, price), 4) AS "right" FROM pages, (VALUES (0), (1)) b(c)""")
def posterize_tiles(t):
    out = P.posterize(plan(t), 2, 1, 10.0, F.col("price"), F.col("qty"))
    return out.select("doc", "page", "position", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


@query(f"""
    WITH {SQL_PAGES}, o AS (SELECT doc, max(page) AS m FROM pages WHERE flag <> 'R' GROUP BY 1),
    c AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS turn FROM pages WHERE page % 2 = 1)
    SELECT p.doc, p.page::INT AS page, CASE WHEN turn IS NOT NULL THEN (turn - 1) % m + 1 END::BIGINT AS over_page
    FROM pages p LEFT JOIN c ON p.doc = c.doc AND p.page = c.page LEFT JOIN o ON p.doc = o.doc""")
def overlay_pages(t):
    pages = plan(t)
    out = P.overlay(pages, pages.filter("flag <> 'R'"), "odd")
    return out.select("doc", "page", F.col("over_page").cast("long").alias("over_page"))


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, 'AB' || lpad((99 + row_number() OVER (ORDER BY doc, page))::VARCHAR, 8, '0') || '-X' AS stamp FROM pages""")
def bates_numbers(t):
    return P.bates(plan(t), "AB", 8, "-X", 100, "page").select("doc", "page", "stamp")


@query(f"""
    WITH {SQL_PAGES}, r(from_page, style, prefix, start) AS (VALUES (1, 'roman', '', 1), (3, 'decimal', 'P-', 1), (5, 'alpha', '', 26)),
    j AS (SELECT doc, page, style, prefix, start + page - from_page AS k FROM pages ASOF JOIN r ON page >= from_page)
    SELECT doc, page::INT AS page, prefix || CASE style WHEN 'roman' THEN ['i', 'ii', 'iii', 'iv'][k] WHEN 'alpha' THEN repeat(chr((97 + (k - 1) % 26)::INT), (k - 1) // 26 + 1)
           ELSE k::VARCHAR END AS label FROM j""")
def page_labels_asof(t):
    return P.labels(plan(t), [(1, "roman", "", 1), (3, "decimal", "P-", 1), (5, "alpha", "", 26)])


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, 'Page ' || page || ' of ' || n || ' - Order ' || doc || ' 2024-01-01' AS footer FROM pages JOIN sizes USING (doc)""")
def header_footer(t):
    n = F.max("page").over(Window.partitionBy("doc"))
    title = F.concat(F.lit("Order "), F.col("doc").cast("string"))
    text = P.stamped("Page {page} of {pages} - {title} {date}", F.col("page"), n, title, "2024-01-01")
    return plan(t).select("doc", "page", text.alias("footer"))


@query(f"""WITH {SQL_PAGES} SELECT doc, page::INT AS page, CASE WHEN page % 2 = 0 THEN ((page * 90) % 360 + 270) % 360 ELSE (page * 90) % 360 END::INT AS rotation FROM pages""")
def rotate_pages(t):
    pages = plan(t).withColumn("rotation", (F.col("page") * 90) % 360)
    return P.rotate(pages, "even", -90).select("doc", "page", "rotation")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, greatest(qty - 20, 0) AS "left", least(qty + 20, 60) AS "right" FROM pages""")
def crop_pages(t):
    box = {"left": F.col("qty") - 20, "top": F.lit(0.0), "right": F.col("qty") + 20, "bottom": F.lit(1.0)}
    limits = {"left": F.lit(0.0), "top": F.lit(0.0), "right": F.lit(60.0), "bottom": F.lit(1.0)}
    out = P.cropped(box, limits)
    return plan(t).select("doc", "page", out["left"].alias("left"), out["right"].alias("right"))


@query(f"""
    WITH {SQL_PAGES}, s AS (SELECT *, least(595.28 / price, 841.89 / (qty * 100)) AS k FROM pages)
    SELECT doc, page::INT AS page, round(k, 6) AS scale, round((595.28 - price * k) / 2, 4) AS dx, round((841.89 - qty * 100 * k) / 2, 4) AS dy FROM s""")
def scale_pages(t):
    k, dx, dy = P.scaled(F.col("price"), F.col("qty") * 100, 595.28, 841.89)
    return plan(t).select("doc", "page", F.round(k, 6).alias("scale"), F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"))


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, coalesce(sum(qty) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top,
           max(price) OVER (PARTITION BY doc) AS total_width, sum(qty) OVER (PARTITION BY doc) AS total_height FROM pages""")
def single_page(t):
    return P.stacked(plan(t), "price", "qty").select("doc", "page", "top", "total_width", "total_height")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, page::INT AS page, round(price * cos(radians(30)) + qty * sin(radians(30)), 4) AS width, round(price * sin(radians(30)) + qty * cos(radians(30)), 4) AS height FROM pages""")
def rotate_content(t):
    w, h = P.turned(F.col("price"), F.col("qty"), 30.0)
    return plan(t).select("doc", "page", F.round(w, 4).alias("width"), F.round(h, 4).alias("height"))


@query("""
    SELECT l_orderkey AS doc, CASE WHEN count(*) < 2 THEN 'even' WHEN count(*) < 4 THEN '2-4' WHEN count(*) < 5 THEN 'last-4' END AS error FROM lineitem GROUP BY 1""")
def page_range_errors(t):
    n = F.count("*").cast("int")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(n.alias("n")).select("doc", P.selector_error("even, 2-4,last-4, odd", F.col("n")).alias("error"))


@query("""
    SELECT p_partkey, CASE WHEN least(w, h) BETWEEN 593.28 AND 597.28 AND greatest(w, h) BETWEEN 839.89 AND 843.89 THEN 'a4'
                           WHEN least(w, h) BETWEEN 610 AND 614 AND greatest(w, h) BETWEEN 790 AND 794 THEN 'letter' END AS paper
    FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 595.0 WHEN 1 THEN 792.5 ELSE 100 END AS w, CASE p_size % 3 WHEN 0 THEN 841.0 WHEN 1 THEN 611.0 ELSE 100 END AS h FROM part)""")
def paper_lookup(t):
    k = F.col("p_size") % 3
    w = F.when(k == 0, 595.0).when(k == 1, 792.5).otherwise(100.0)
    h = F.when(k == 0, 841.0).when(k == 1, 611.0).otherwise(100.0)
    return t.part.select("p_partkey", P.paper(w, h).alias("paper"))


@query(f"""
    WITH {SQL_PAGES}, v AS (SELECT doc, page, CASE WHEN part_key % 3 < 1 AND qty / 50 > 0 THEN 'scanned' WHEN part_key % 3 >= 1 AND qty / 50 >= 0.25 THEN 'mixed' ELSE 'digital' END AS verdict FROM pages)
    SELECT doc, count(*) FILTER (verdict = 'scanned') AS scanned, count(*) FILTER (verdict = 'mixed') AS mixed, count(*) FILTER (verdict = 'digital') AS digital,
           count(*) FILTER (verdict <> 'scanned') < count(*) AS needs_ocr FROM v GROUP BY 1""")
def scan_verdict(t):
    verdict = P.scan_verdict(F.col("part_key") % 3, F.col("qty") / 50)
    out = plan(t).withColumn("verdict", verdict).groupBy("doc")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("scanned", "mixed", "digital")]
    return out.agg(*counts, (F.count_if(F.col("verdict") != "scanned") < F.count("*")).alias("needs_ocr"))


@query(f"""
    WITH {SQL_PAGES} SELECT m.doc, flag, count(DISTINCT page) AS pages, round(count(DISTINCT page) / max(n), 6) AS ratio FROM pages m JOIN sizes USING (doc)
    GROUP BY m.doc, flag HAVING round(count(DISTINCT page) / max(n), 6) >= 0.6""")
def watermark_detect(t):
    pages = plan(t)
    return P.repeated_marks(pages, pages, "flag")


@query(f"""
    WITH {SQL_PAGES}, w AS (SELECT m.doc, flag FROM pages m JOIN sizes USING (doc) GROUP BY m.doc, flag HAVING round(count(DISTINCT page) / max(n), 6) >= 0.6)
    SELECT doc, page::INT AS page, flag FROM pages p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc = p.doc AND w.flag = p.flag)""")
def watermark_remove(t):
    pages = plan(t)
    return pages.join(P.repeated_marks(pages, pages, "flag"), ["doc", "flag"], "left_anti").select("doc", "page", "flag")


@query(f"""
    WITH {SQL_PAGES}, h AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS entry, count(*) OVER (PARTITION BY doc) AS c FROM pages WHERE flag = 'R')
    SELECT doc, page::INT AS page, entry::INT AS entry, ceil(entry / 2)::BIGINT AS toc_page, page + ceil(c / 2)::BIGINT AS shown_page FROM h""")
def toc_pages(t):
    heads = plan(t).filter("flag = 'R'").withColumn("ord", F.lit(0))
    return P.contents(heads, 2).select("doc", "page", "entry", "toc_page", "shown_page")


@query(f"""WITH {SQL_PAGES} SELECT doc, page::INT AS page FROM pages WHERE qty / 50 < 0.9""")
def remove_blank(t):
    return plan(t).filter(F.col("qty") / 50 < 0.9).select("doc", "page")


@query(f"""
    WITH {SQL_PAGES} SELECT doc, min(qty) - 5 AS "left", max(qty) + 5 AS "right", min(price) - 5 AS top, max(price) + 5 AS bottom FROM pages GROUP BY 1""")
def crop_whitespace(t):
    pad = 5.0
    return plan(t).groupBy("doc").agg(
        (F.min("qty") - pad).alias("left"), (F.max("qty") + pad).alias("right"), (F.min("price") - pad).alias("top"), (F.max("price") + pad).alias("bottom")
    )


@query(f"""
    WITH {SQL_PAGES} SELECT doc, count(*) AS pages, max(price) AS widest, bool_or(flag = 'R') AS has_returns, count(DISTINCT flag) AS kinds FROM pages GROUP BY 1""")
def doc_info(t):
    return plan(t).groupBy("doc").agg(
        F.count("*").alias("pages"), F.max("price").alias("widest"), F.bool_or(F.col("flag") == "R").alias("has_returns"), F.count_distinct("flag").alias("kinds")
    )


@query(f"""
    WITH {SQL_PAGES}, a AS (SELECT doc, page, qty FROM pages WHERE flag <> 'R'), b AS (SELECT doc, page, qty + (part_key % 2) AS qty FROM pages WHERE flag <> 'A')
    SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page, b.page)::INT AS page,
           CASE WHEN a.doc IS NULL THEN 'added' WHEN b.doc IS NULL THEN 'removed' WHEN a.qty = b.qty THEN 'identical' ELSE 'changed' END AS status
    FROM a FULL OUTER JOIN b ON a.doc = b.doc AND a.page = b.page""")
def page_compare(t):
    pages = plan(t)
    a = pages.filter("flag <> 'R'").select("doc", "page", F.col("qty").alias("before"))
    b = pages.filter("flag <> 'A'").select("doc", "page", (F.col("qty") + F.col("part_key") % 2).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "identical").otherwise("changed")
    return a.join(b, ["doc", "page"], "full_outer").select("doc", "page", status.alias("status"))


@query("""
    SELECT o_orderkey AS doc, name, coalesce(CASE name WHEN 'priority' THEN o_orderpriority WHEN 'status' THEN nullif(o_orderstatus, 'P') END, '-') AS value
    FROM orders, (VALUES ('priority'), ('status'), ('note')) f(name)""")
def forms_fill(t):
    values = t.orders.select(
        F.col("o_orderkey").alias("doc"),
        F.map_from_arrays(F.array(F.lit("priority"), F.lit("status")), F.array("o_orderpriority", F.nullif("o_orderstatus", F.lit("P")))).alias("values"),
    )
    out = values.withColumn("name", F.explode(F.array(F.lit("priority"), F.lit("status"), F.lit("note"))))  # the template's fields
    return out.select("doc", "name", F.coalesce(F.try_element_at("values", F.col("name")), F.lit("-")).alias("value"))


@query("""
    SELECT o_custkey AS doc, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F", max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (o_orderstatus = 'P') AS "P"
    FROM orders GROUP BY 1""")
def forms_export(t):
    return t.orders.groupBy(F.col("o_custkey").alias("doc")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))


@query("""
    SELECT l_orderkey, l_linenumber, (l_partkey & ~1)::BIGINT AS unlocked, (l_partkey & 4) <> 0 AS may_print, (l_partkey | 16)::BIGINT AS granted FROM lineitem""")
def permission_bits(t):
    key = F.col("l_partkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", key.bitwiseAND(F.lit(-2)).alias("unlocked"), (key.bitwiseAND(F.lit(4)) != 0).alias("may_print"), key.bitwiseOR(F.lit(16)).alias("granted")
    )


@query("""
    WITH m AS (SELECT c_custkey, key, value FROM customer, (VALUES ('name'), ('segment'), ('producer')) k(key), LATERAL (SELECT CASE key WHEN 'name' THEN upper(c_name) WHEN 'segment' THEN c_mktsegment ELSE 'sheaf' END AS value) v)
    SELECT c_custkey, key, value FROM m WHERE key <> 'segment'""")
def metadata_edit(t):
    meta = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    edits = F.create_map(F.lit("name"), F.upper("c_name"), F.lit("producer"), F.lit("sheaf"))
    kept = F.map_filter(meta, lambda k, _: ~k.isin("name", "producer", "segment"))
    return t.customer.select("c_custkey", F.explode(F.map_concat(kept, edits)))
