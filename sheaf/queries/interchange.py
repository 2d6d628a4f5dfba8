"""Queries over document trees, references, checks and markup scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import markup as U
from sheaf.functions import text as X
from sheaf.operators import checks as K
from sheaf.operators import matching as M
from sheaf.operators import scoring as C
from sheaf.queries.registry import query
from sheaf.sources import formats, forms
from sheaf.sources import interchange as I
from sheaf.sources.mail import front_matter

#: Keys of one style sheet, a multiple of three: styles and their parents share a sheet, and sheets stay far below the reader's limit.
SHEET_STYLES = 3000


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r'(?s)^\{"c":(.*)\}$', 1)


_WORDS = "array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''), ' ')"


def _plain_words(text: str) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


# -- the document model's JSON -------------------------------------------------------------------------------------------


def _trees(t):
    """A conversation as a document: its first turn a heading, the assistant's turns quotes, the others paragraphs with a link
    and two images."""
    leaf = "struct<type:string,text:string>"
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("line_break").alias("type"), F.lit(None).cast("string").alias("text")))
    turn = F.col("turn").cast("string")
    inside = F.array(F.struct(F.lit("paragraph").alias("type"), F.concat(F.lit("p"), turn).alias("id"), text.alias("content")))
    more = F.array(
        F.struct(F.lit("image").alias("type"), F.lit("alt").alias("alt"), F.struct(F.lit("http://a/b.png").alias("url")).alias("target")),
        F.struct(F.lit("footnote_ref").alias("type"), F.lit(None).cast("string").alias("alt"), F.lit(None).cast("struct<url:string>").alias("target")),
    )
    quote, head = F.col("role") == "assistant", F.col("turn") == 0
    block = F.struct(
        F.when(head, "heading").when(quote, "quote").otherwise("paragraph").alias("type"), F.concat(F.lit("b"), turn).alias("id"),
        F.when(head, 1).alias("level"), F.when(~quote | head, text).cast(f"array<{leaf}>").alias("content"),
        F.when(~quote & ~head, more).alias("caption"), F.when(quote & ~head, inside).alias("blocks"),
    )
    return I.write_ir(t.conversations.withColumn("block", block), "conv_id", "turn", "block")


_TREE_ROWS = """r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    b AS (SELECT conv_id, 'body/' || i AS path, 'b' || turn AS id, CASE WHEN turn = 0 THEN 'heading' WHEN role = 'assistant' THEN 'quote' ELSE 'paragraph' END AS kind,
                 CASE WHEN turn = 0 THEN text || ' ' WHEN role = 'assistant' THEN '' ELSE text || ' alt' END AS text, (turn > 0 AND role <> 'assistant')::INT AS linked_images FROM r
          UNION ALL SELECT conv_id, 'body/' || i || '/blocks/0', 'p' || turn, 'paragraph', text || ' ', 0 FROM r WHERE role = 'assistant' AND turn > 0)"""


@query(f"WITH {_TREE_ROWS} SELECT conv_id, path, id, kind, sha256(text) AS digest, linked_images FROM b")
def ir_round_trip(t):
    found = _trees(t).select("conv_id", I.ir()(F.col("json")).alias("d")).select("conv_id", F.inline("d.blocks"))
    return found.select("conv_id", "path", "id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "linked_images")


@query(f"WITH {_TREE_ROWS} SELECT conv_id, count(*) AS blocks, sum(linked_images)::BIGINT AS linked_images, max(len(string_split(path, '/')))::INT AS depth FROM b GROUP BY 1")
def ir_counts(t):
    found = _trees(t).select("conv_id", I.ir()(F.col("json")).alias("d")).select("conv_id", F.inline("d.blocks"))
    return found.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.sum("linked_images").alias("linked_images"), F.max(F.size(F.split("path", "/"))).alias("depth"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unsupported version' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'block identifiers must be valid and unique' WHEN 3 THEN 'nesting too deep' END AS error FROM part""")
def ir_errors(t):
    k = F.col("p_partkey") % 5
    source = (
        F.when(k == 0, F.lit('{"version":"x-ir/9","body":[]}')).when(k == 1, F.lit('{"version":')).when(k == 2, F.lit('{"version":"x-ir/2","body":[{"type":"raw","id":"a"},{"type":"raw","id":"a"}]}'))
        .when(k == 3, F.concat(F.lit('{"version":"x-ir/2","body":'), F.repeat(F.lit("["), F.lit(600)), F.repeat(F.lit("]"), F.lit(600)), F.lit("}"))).otherwise(F.lit('{"version":"x-ir/1","body":[]}'))
    )
    return t.part.select("p_partkey", I.ir()(source).alias("d")).select("p_partkey", "d.error")


@query("""
    WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_suppkey AS s, l_discount AS x0, l_tax AS x1 FROM lineitem),
    b AS (SELECT doc, CASE WHEN s % 10 = 0 THEN '1b' ELSE 'b' END || n AS id FROM r), i AS (SELECT DISTINCT doc, id FROM b),
    o AS (SELECT doc, 'b' || (CASE WHEN s % 7 = 0 THEN n + 50 ELSE n END) AS id, n % 4 AS page, x0, x1 FROM r),
    p AS (SELECT o_orderkey AS doc, k AS page, CASE WHEN o_custkey % 9 = 0 THEN 0.0 ELSE 100.0 END AS w FROM orders, (VALUES (1), (2), (o_orderkey % 3)) AS v(k)),
    q AS (SELECT DISTINCT doc, page FROM p),
    f AS (SELECT doc, 'invalid_id' AS rule FROM b WHERE NOT regexp_full_match(id, '[A-Za-z][A-Za-z0-9_.-]{0,127}')
          UNION ALL SELECT doc, 'repeated_id' FROM b GROUP BY doc, id HAVING count(*) > 1
          UNION ALL SELECT doc, 'dangling_id' FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc = o.doc AND i.id = o.id)
          UNION ALL SELECT doc, 'missing_page' FROM o WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = o.doc AND q.page = o.page)
          UNION ALL SELECT doc, 'invalid_box' FROM o WHERE x1 < x0
          UNION ALL SELECT doc, 'invalid_page' FROM p WHERE page < 1 OR w <= 0
          UNION ALL SELECT doc, 'repeated_page' FROM p GROUP BY doc, page HAVING count(*) > 1)
    SELECT doc, rule, count(*) AS n FROM f GROUP BY 1, 2""")
def ir_violations(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), "l_discount", "l_tax")
    blocks = rows.select("doc", F.concat(F.when(F.col("s") % 10 == 0, "1b").otherwise("b"), F.col("n").cast("string")).alias("id"))
    place = F.when(F.col("s") % 7 == 0, F.col("n") + 50).otherwise(F.col("n"))
    box = [F.col("l_discount").alias("left"), F.lit(0.0).alias("top"), F.col("l_tax").alias("right"), F.lit(1.0).alias("bottom")]
    positions = rows.select("doc", F.concat(F.lit("b"), place.cast("string")).alias("id"), (F.col("n") % 4).alias("page_no"), *box)
    pages = t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), (F.col("o_orderkey") % 3).cast("long"))).alias("page_no"),
                            F.when(F.col("o_custkey") % 9 == 0, 0.0).otherwise(100.0).alias("width"), F.lit(50.0).alias("height"))
    return K.violations(blocks, positions, pages, "doc")


@query("""SELECT conv_id, turn, sha256(text || ' ' || text || 'alt') AS digest FROM conversations""")
def inline_texts(t):
    nodes = F.concat(
        F.lit('{"version":"x-ir/2","body":[{"type":"paragraph","id":"a","content":[{"type":"text","text":'), _json_text(F.col("text")),
        F.lit('},{"type":"soft_break"},{"type":"link","content":[{"type":"strong","content":[{"type":"text","text":'), _json_text(F.col("text")),
        F.lit('}]}]},{"type":"footnote_ref","id":"n"},{"type":"image","alt":"alt","target":{"asset":"x"}}]}]}'),
    )
    found = t.conversations.select("conv_id", "turn", I.ir()(nodes).alias("d"))
    return found.select("conv_id", "turn", F.sha2(F.get("d.blocks", 0)["text"].cast("binary"), 256).alias("digest"))


# -- layout JSON and converter trees -------------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    n AS (SELECT conv_id, count(*) AS c FROM r GROUP BY 1)
    SELECT r.conv_id, i::INT AS place, CASE WHEN turn % 5 = 4 THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN turn % 5 = 4 THEN 'page_header' WHEN turn = 0 THEN 'section_header' ELSE 'text' END AS label,
           (i % 3 + 1)::INT AS page, sha256(text) AS digest, 1 AS dangling FROM r JOIN n ON r.conv_id = n.conv_id""")
def layout_json(t):
    """Conversations as layout JSON with a repeated and a dangling reference."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    label = F.when(F.col("turn") % 5 == 4, "page_header").when(F.col("turn") == 0, "section_header").otherwise("text")
    rows = t.conversations.withColumn("i", place)
    node = F.struct("i", F.struct("text", label.alias("label"), F.array(F.struct((F.col("i") % 3 + 1).alias("page_no"))).alias("prov")).alias("node"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    refs = F.array_join(F.transform("nodes", lambda n: F.format_string('{"$ref":"#/texts/%d"}', n.i)), ",")
    source = F.concat(
        F.lit('{"schema_name":"DoclingDocument","version":"1.3.0","texts":'), F.to_json(F.transform("nodes", lambda n: n.node)),
        F.lit(',"body":{"children":['), refs, F.lit(',{"$ref":"#/texts/0"},{"$ref":"#/texts/100000"}]}}'),
    )
    found = docs.select("conv_id", I.layout()(source).alias("d")).select("conv_id", "d.dangling", F.posexplode("d.nodes").alias("place", "n"))
    return found.select("conv_id", "place", "n.layer", "n.label", "n.page", F.sha2(F.col("n.text").cast("binary"), 256).alias("digest"), "dangling")


@query("""
    WITH n AS (SELECT o_custkey AS doc, o_orderkey AS ref, o_totalprice FROM orders),
    r AS (SELECT o_custkey AS doc, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) WHEN 2 THEN o_orderkey + 1000000 ELSE o_orderkey END AS ref FROM orders),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, ref ORDER BY ord) AS k FROM r) WHERE k = 1),
    c AS (SELECT r.doc, count(*) AS claimed, sum(n.o_totalprice) AS total FROM f r JOIN n ON r.doc = n.doc AND r.ref = n.ref GROUP BY 1),
    d AS (SELECT r.doc, count(*) AS dangling FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = r.doc AND n.ref = r.ref) GROUP BY 1)
    SELECT coalesce(c.doc, d.doc) AS doc, coalesce(claimed, 0) AS claimed, coalesce(dangling, 0) AS dangling, round(coalesce(total, 0), 2) AS total FROM c FULL JOIN d ON c.doc = d.doc""")
def ref_resolution(t):
    key, mine = F.col("o_orderkey"), Window.partitionBy("o_custkey")
    nodes = t.orders.select(F.col("o_custkey").alias("doc"), key.alias("ref"), "o_totalprice")
    ref = F.when(key % 4 == 1, F.min("o_orderkey").over(mine)).when(key % 4 == 2, key + 1_000_000).otherwise(key)
    refs = t.orders.select(F.col("o_custkey").alias("doc"), key.alias("ord"), ref.alias("ref"))
    found, dangling = K.resolved(refs, nodes, "doc")
    found = found.groupBy("doc").agg(F.count("*").alias("claimed"), F.sum("o_totalprice").alias("total"))
    out = found.join(dangling.groupBy("doc").agg(F.count("*").alias("dangling")), "doc", "full_outer").fillna(0)
    return out.select("doc", "claimed", "dangling", F.round("total", 2).alias("total"))


@query(f"""
    WITH r AS (SELECT conv_id, turn, role, {_WORDS} AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    b AS (SELECT conv_id, i * 10 AS ord, CASE WHEN turn = 0 THEN 'heading' WHEN role = 'assistant' THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN turn = 0 THEN 2 END AS level,
                 CASE WHEN turn > 0 AND role = 'assistant' THEN '' ELSE words END AS text, 0 AS depth, NULL AS checked FROM r
          UNION ALL SELECT conv_id, i * 10 + 1, 'paragraph', NULL, words, 1, true FROM r WHERE turn > 0 AND role = 'assistant')
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY ord) - 1)::INT AS place, kind, level::INT AS level, sha256(text) AS digest, depth::INT AS depth, checked::BOOLEAN AS checked FROM b""")
def converter_tree(t):
    """Conversations as a converter's tree: headings, paragraphs of words, and lists with checked tasks."""
    words = F.transform(_plain_words("text"), lambda w: F.concat(F.lit('{"t":"Str","c":'), _json_text(w), F.lit("}")))
    line = F.array_join(words, ',{"t":"Space"},')
    block = (
        F.when(F.col("turn") == 0, F.concat(F.lit('{"t":"Header","c":[2,["",[],[]],['), line, F.lit("]]}")))
        .when(F.col("role") == "assistant", F.concat(F.lit('{"t":"BulletList","c":[[{"t":"Plain","c":[{"t":"Str","c":"☒"},{"t":"Space"},'), line, F.lit("]}]]}")))
        .otherwise(F.concat(F.lit('{"t":"Para","c":['), line, F.lit("]}")))
    )
    blocks = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    source = F.concat(F.lit('{"pandoc-api-version":[1,23],"meta":{},"blocks":['), F.array_join(F.transform(blocks, lambda x: x.b), ","), F.lit("]}"))
    found = t.conversations.groupBy("conv_id").agg(source.alias("json")).select("conv_id", I.ast()(F.col("json")).alias("d"))
    found = found.select("conv_id", F.posexplode("d.blocks").alias("place", "b"))
    return found.select("conv_id", "place", "b.kind", "b.level", F.sha2(F.col("b.text").cast("binary"), 256).alias("digest"), "b.depth", "b.checked")


@query("""
    SELECT p_partkey, 'S' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN 'S' || (p_partkey - p_partkey % 3) END AS based_on,
           CASE WHEN p_partkey % 2 = 0 THEN p_size / 2.0 END AS size_pt, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS bold FROM part""")
def office_styles(t):
    k = F.col("p_partkey")
    style = F.concat(
        F.format_string('<w:style w:type="paragraph" w:styleId="S%d"><w:name w:val="%s"/>', k, X.escape_html(F.col("p_name"))),
        F.when(k % 3 > 0, F.format_string('<w:basedOn w:val="S%d"/>', k - k % 3)).otherwise(""), F.lit("<w:rPr>"),
        F.when(k % 5 == 0, "<w:b/>").when(k % 5 == 1, '<w:b w:val="0"/>').otherwise(""),
        F.when(k % 2 == 0, F.format_string('<w:sz w:val="%d"/>', F.col("p_size"))).otherwise(""), F.lit("</w:rPr></w:style>"),
    )
    sheets = t.part.groupBy(F.floor(k / SHEET_STYLES).alias("doc")).agg(F.array_join(F.collect_list(style), "").alias("body"))
    source = F.concat(F.lit('<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'), "body", F.lit("</w:styles>"))
    found = sheets.select(I.styles()(source).alias("d")).select(F.inline("d.styles"))
    return found.select(F.substr("id", F.lit(2)).cast("long").alias("p_partkey"), "id", "name", "based_on", "size_pt", "bold")


# -- references, assets, warnings and reports ----------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS id FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 9 AS id FROM lineitem)
    SELECT doc, id, 'missing' AS fault FROM (SELECT * FROM r EXCEPT SELECT * FROM n) UNION ALL SELECT doc, id, 'unused' FROM (SELECT * FROM n EXCEPT SELECT * FROM r)""")
def footnote_faults(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("id"))
    notes = t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 9).cast("long").alias("id"))
    return K.footnote_faults(refs, notes, "doc")


@query("""
    WITH l AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'img/' || c_nationkey || '.png' WHEN 1 THEN './img//x/../' || c_nationkey || '.png' WHEN 2 THEN 'im%67/' || c_nationkey || '%2Epng' WHEN 3 THEN '../img/1.png'
                      WHEN 4 THEN 'http://a/1.png' WHEN 5 THEN '/img/1.png' WHEN 6 THEN 'img/%zz.png' ELSE 'img\\1.png' END AS href, c_nationkey FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 8 < 3 THEN 'img/' || c_nationkey || '.png' END AS path, CASE WHEN c_custkey % 8 < 3 AND c_nationkey < 20 THEN sha256('NATION_' || c_nationkey) END AS digest FROM l""")
def local_assets(t):
    k, nation = F.col("c_custkey") % 8, F.col("c_nationkey").cast("string")
    forms_ = [
        F.concat(F.lit("img/"), nation, F.lit(".png")), F.concat(F.lit("./img//x/../"), nation, F.lit(".png")), F.concat(F.lit("im%67/"), nation, F.lit("%2Epng")),
        F.lit("../img/1.png"), F.lit("http://a/1.png"), F.lit("/img/1.png"), F.lit("img/%zz.png"), F.lit("img\\1.png"),
    ]
    href = F.lit(None).cast("string")
    for i, form in enumerate(forms_):
        href = F.when(k == i, form).otherwise(href)
    files = t.nation.filter("n_nationkey < 20").select(F.concat(F.lit("img/"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("path"), F.sha2(F.col("n_name").cast("binary"), 256).alias("digest"))
    return K.with_assets(t.customer.select("c_custkey", href.alias("href")), files, "href").select("c_custkey", "path", "digest")


@query("""SELECT l_orderkey AS doc, count(*) AS pages, count(*) FILTER (l_tax > 0.02) AS text_pages, count(*) FILTER (l_tax > 0.02) < count(*) AS needs_ocr FROM lineitem GROUP BY 1""")
def needs_ocr(t):
    out = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("pages"), F.count_if(F.col("l_tax") > 0.02).alias("text_pages"))
    return out.withColumn("needs_ocr", K.needs_ocr(F.col("pages"), F.col("text_pages")))


@query("""
    SELECT l_orderkey AS doc, array_to_string(list_sort(list(code) FILTER (code <> 'styles_dropped')), ',') AS codes, count(*) FILTER (code = 'styles_dropped') AS dropped
    FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'styles_dropped' WHEN 'R' THEN 'unsupported_node' ELSE 'footnote_missing' END AS code FROM lineitem) GROUP BY 1""")
def kept_warnings(t):
    code = F.when(F.col("l_returnflag") == "N", "styles_dropped").when(F.col("l_returnflag") == "R", "unsupported_node").otherwise("footnote_missing")
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(code).alias("w"))
    kept = K.kept_warnings(F.col("w"))
    return docs.select("doc", F.nullif(F.array_join(F.array_sort(kept), ","), F.lit("")).alias("codes"), (F.size("w") - F.size(kept)).cast("long").alias("dropped"))


@query("""
    WITH d AS (SELECT c_custkey, c_custkey % 2 = 0 AS marked, c_custkey % 3 = 0 AS structure, CASE WHEN c_custkey % 5 > 0 THEN 'en' ELSE ' ' END AS lang, CASE WHEN c_custkey % 7 > 0 THEN true END AS title_shown, CASE WHEN c_custkey % 11 > 0 THEN c_name END AS title FROM customer)
    SELECT c_custkey, concat_ws(',', CASE WHEN NOT marked THEN 'missing_marked_info' END, CASE WHEN NOT structure THEN 'missing_struct_tree_root' END, CASE WHEN trim(lang) = '' THEN 'missing_lang' END,
           CASE WHEN title_shown IS NULL THEN 'missing_display_doc_title' END, CASE WHEN title IS NULL THEN 'missing_title' END) AS issues, marked AND structure AS tagged FROM d""")
def accessibility_report(t):
    k = F.col("c_custkey")
    docs = t.customer.select(
        "c_custkey", (k % 2 == 0).alias("marked"), (k % 3 == 0).alias("structure"), F.when(k % 5 > 0, "en").otherwise(" ").alias("lang"),
        F.when(k % 7 > 0, F.lit(True)).alias("title_shown"), F.when(k % 11 > 0, F.col("c_name")).alias("title"),
    )
    return K.accessibility(docs, "c_custkey").select("c_custkey", F.array_join("issues", ",").alias("issues"), "tagged")


@query("""
    WITH i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_linenumber AS number, l_extendedprice FROM lineitem),
    s AS (SELECT *, CASE WHEN lag(number) OVER (PARTITION BY doc ORDER BY ord) + 1 = number THEN 0 ELSE 1 END AS starts FROM i),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY ord) AS list FROM s)
    SELECT doc, list::BIGINT AS list, min_by(number, ord) AS start, count(*) AS items FROM g GROUP BY 1, 2""")
def numbered_lists(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("ord"), F.col("l_linenumber").alias("number"))
    return K.numbered_lists(items, "doc", "ord", "number").groupBy("doc", "list").agg(F.first("start").alias("start"), F.count("*").alias("items"))


@query("""
    SELECT o_custkey AS doc, sha256('<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>' || string_agg('<text page="' || o_orderkey % 5 || '" name="' || o_orderkey || '"><contents>&lt;' || o_orderpriority || '&gt; &amp; more</contents></text>', '' ORDER BY o_orderkey % 5, o_orderkey) || '</annots></xfdf>') AS digest
    FROM orders GROUP BY 1""")
def annotations_export(t):
    notes = t.orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 5).alias("page"), F.col("o_orderkey").alias("id"), F.lit("text").alias("kind"), F.concat(F.lit("<"), "o_orderpriority", F.lit("> & more")).alias("contents"))
    return K.annotations_xfdf(notes, "doc").select("doc", F.sha2(F.col("xfdf").cast("binary"), 256).alias("digest"))


@query("""
    WITH f AS (SELECT o_custkey AS doc, o_orderkey % 4 AS page, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value FROM orders)
    SELECT doc, count(*) FILTER (page = 1) AS fields, string_agg(value, ',' ORDER BY page, value) FILTER (page <> 1) AS texts FROM f GROUP BY 1""")
def forms_flatten(t):
    fields = t.orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 4).alias("page"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"))
    stay, texts = K.flattened(fields, F.col("page") != 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r.text), ",")
    a = stay.groupBy("doc").agg(F.count("*").alias("fields"))
    return fields.select("doc").distinct().join(a, "doc", "left").join(texts.groupBy("doc").agg(text.alias("texts")), "doc", "left").fillna(0, ["fields"])


@query("""
    WITH m AS (SELECT o_custkey AS pack, o_orderkey AS path, round(o_totalprice)::BIGINT AS size, sha256(o_orderpriority) AS digest FROM orders WHERE o_orderkey % 11 > 0),
    f AS (SELECT o_custkey AS pack, o_orderkey AS path, round(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS size, sha256(CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE o_orderpriority END) AS digest FROM orders WHERE o_orderkey % 19 > 0)
    SELECT * FROM (SELECT coalesce(m.pack, f.pack) AS pack, coalesce(m.path, f.path) AS path, CASE WHEN f.pack IS NULL THEN 'missing' WHEN m.pack IS NULL THEN 'unlisted' WHEN f.size <> m.size THEN 'size' WHEN f.digest <> m.digest THEN 'digest' END AS fault
    FROM m FULL JOIN f ON m.pack = f.pack AND m.path = f.path) WHERE fault IS NOT NULL""")
def manifest_faults(t):
    k = F.col("o_orderkey")
    digest, size = F.sha2(F.col("o_orderpriority").cast("binary"), 256), F.round("o_totalprice").cast("long")
    base = [F.col("o_custkey").alias("pack"), k.alias("path")]
    manifest = t.orders.filter(k % 11 > 0).select(*base, size.alias("size"), digest.alias("digest"))
    files = t.orders.filter(k % 19 > 0).select(*base, (size + F.when(k % 13 == 0, 1).otherwise(0)).alias("size"), F.when(k % 17 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(digest).alias("digest"))
    return K.manifest_faults(files, manifest, "pack")


# -- fidelity -----------------------------------------------------------------------------------------------------------


@query("""
    WITH l AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 3 > 0),
    r AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 3 < 2)
    SELECT coalesce(l.doc, r.doc) AS doc, round(avg(CASE WHEN l.doc IS NULL OR r.doc IS NULL THEN 0 WHEN l.s = r.s THEN 1 ELSE 0.8 END), 6) AS teds, count(*) AS pairs FROM l FULL JOIN r ON l.doc = r.doc AND l.i = r.i GROUP BY 1""")
def table_pairs(t):
    """Tables of two rows, of which one cell differs or none: trees of five nodes."""
    place = Window.partitionBy("doc").orderBy("k")
    table = F.array(F.array(F.lit("head")), F.array(F.col("o_orderstatus")))
    rows = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), table.alias("t"))
    left, right = (rows.filter(c).withColumn("i", F.row_number().over(place)) for c in ("k % 3 > 0", "k % 3 < 2"))
    pairs = K.table_pairs(left, right, "doc", "i", "t")
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(C.table_similarities(F.col("a"), F.col("b")))
    return pairs.withColumn("s", score).groupBy("doc").agg(F.round(F.avg("s"), 6).alias("teds"), F.count("*").alias("pairs"))


@query("""
    WITH s AS (SELECT doc_id, n_chars % 150 / 100.0 AS cer, n_chars % 7 / 10.0 AS ted, CASE WHEN doc_id % 3 = 0 THEN n_chars % 11 / 11.0 END AS teds FROM documents)
    SELECT doc_id, round(list_avg(list_filter([greatest(0, 1 - cer), greatest(0, 1 - ted), teds], lambda x: x IS NOT NULL)), 6) AS fidelity FROM s""")
def legacy_fidelity(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.round(C.legacy_fidelity(n % 150 / 100, n % 7 / 10, F.when(F.col("doc_id") % 3 == 0, n % 11 / 11)), 6).alias("fidelity"))


@query("""SELECT c_custkey, round(levenshtein(c_name, replace(c_mktsegment, 'B', '')) / greatest(length(c_name), length(replace(c_mktsegment, 'B', ''))), 6)::DOUBLE AS ratio FROM customer""")
def text_ratios(t):
    other = F.replace("c_mktsegment", F.lit("B"), F.lit(""))
    return t.customer.select("c_custkey", F.round(X.levenshtein_ratio(F.col("c_name"), other), 6).alias("ratio"))


# -- scalars ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT c_custkey, '"' || replace(c_name, '#', '\23 ') || '\3b  url\28 x\29 -é"' AS css, CASE WHEN c_custkey % 3 = 0 THEN c_name || '+ é' WHEN c_custkey % 3 = 1 THEN 'a b' END AS path FROM customer""")
def css_and_links(t):
    k = F.col("c_custkey") % 3
    href = F.when(k == 0, F.concat(F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit("+%20%C3%A9"))).when(k == 1, "a%20b").otherwise("a%2")
    return t.customer.select("c_custkey", U.css_string(F.concat("c_name", F.lit("; url(x)-é"))).alias("css"), U.percent_decoded(href).alias("path"))


@query("""
    WITH n AS (SELECT c_nationkey AS book, c_custkey, left(trim(replace(c_mktsegment, 'B', 'b') || ':' || repeat('x', (c_custkey % 2 * 20)::INT)), 31) AS name FROM customer),
    b AS (SELECT *, replace(name, ':', '_') AS base, row_number() OVER (PARTITION BY book, lower(replace(name, ':', '_')) ORDER BY c_custkey) AS k FROM n)
    SELECT book, c_custkey, CASE WHEN k = 1 THEN base ELSE left(base, 31 - length('_' || k)) || '_' || k END AS name FROM b""")
def sheet_names(t):
    raw = F.concat(F.replace("c_mktsegment", F.lit("B"), F.lit("b")), F.lit(":"), F.repeat(F.lit("x"), (F.col("c_custkey") % 2 * 20).cast("int")))
    books = t.customer.groupBy(F.col("c_nationkey").alias("book")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", raw.alias("raw")))).alias("s"))
    named = books.select("book", F.arrays_zip(F.col("s.c_custkey").alias("c_custkey"), U.sheet_names_of(F.col("s.raw")).alias("name")).alias("z"))
    return named.select("book", F.inline("z"))


@query("""SELECT c_custkey, '<p title="t">' || c_name || ' <a href="http://a/b" rel="noopener noreferrer">x &lt; y</a><img alt="i"></p><ul><li>' || c_mktsegment || '</li></ul>' AS html FROM customer""")
def sanitized_html(t):
    raw = F.concat(
        F.lit('<p onclick="go()" title="t"><script>alert("x")</script>'), "c_name", F.lit(' <a href="http://a/b" target="_blank">x &lt; y</a><img src="javascript:go()" alt="i"></p><!-- c --><style>p{}</style><form><ul><li>'),
        "c_mktsegment", F.lit("</li></ul></form>"),
    )
    return t.customer.select("c_custkey", U.sanitized(raw).alias("html"))


@query("""SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' AS date FROM orders""")
def pdf_dates(t):
    return t.orders.select("o_orderkey", U.pdf_date(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("date"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey % 9 AS form, l_partkey % 9 < 6 AS number FROM lineitem""")
def number_cells(t):
    n, k = F.col("l_partkey").cast("string"), F.col("l_partkey") % 9
    forms_ = [
        F.concat(F.lit("$"), n, F.lit(".50")), F.concat(F.lit("("), n, F.lit(",000)")), F.concat(n, F.lit(" KG")), F.concat(F.lit("usd "), n), F.lit("12 Sept 2024"), F.lit("509k"),
        F.concat(n, F.lit(" apples")), F.lit("no digit"), F.lit("32 May 2024"),
    ]
    forms_[4] = F.lit("12 Sep. 2024")
    cell = F.lit("")
    for i, form in enumerate(forms_):
        cell = F.when(k == i, form).otherwise(cell)
    return t.lineitem.select("l_orderkey", "l_linenumber", k.alias("form"), U.is_number_cell(cell).alias("number"))


@query("""
    SELECT o_custkey AS doc, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN count(*) < 3 THEN 'words' ELSE 'labels' END WHEN 2 THEN 'words' ELSE CASE WHEN count(*) < 3 THEN 'words' ELSE 'prose' END END AS layout
    FROM orders GROUP BY 1 HAVING count(*) >= 3 OR o_custkey % 4 > 0""")
def aligned_layouts(t):
    k = F.col("o_custkey") % 4
    second = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, F.concat("o_orderstatus", F.lit(":"))).when(k == 2, F.lit("Yes")).otherwise(F.lit("a phrase with words"))
    docs = t.orders.groupBy(F.col("o_custkey").alias("doc")).agg(F.array(F.collect_list("o_orderstatus"), F.collect_list(second)).alias("c"))
    return docs.filter((F.size(F.get("c", 0)) >= 3) | (F.col("doc") % 4 > 0)).select("doc", U.aligned_layout(F.col("c")).alias("layout"))


@query("""
    SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS clean, trim(text) = '' AS blank, sha256(strip_accents(replace(lower(text), 'đ', 'd'))) AS folded,
           sha256(regexp_replace(text, '\\r\\n|[\\r\\n]', ' ', 'g')) AS line FROM documents""")
def text_forms(t):
    text = F.col("text")
    digest = {"clean": X.clean(text), "folded": X.fold(text), "line": X.single_line(text)}
    columns = [F.sha2(x.cast("binary"), 256).alias(name) for name, x in digest.items()]
    return t.documents.select("doc_id", X.nonempty(text).isNull().alias("blank"), *columns)


_HIDDEN = "0912​345​678 or ０９１２３４５６７８"


@query("""SELECT c_custkey, length(c_name) + 1 AS start, length(c_name) + 1 + length('0912-345-6789') AS "end", 2 AS places FROM customer""")
def search_offsets(t):
    """A number that invisible characters split, told in the text's own offsets, and one in full-width digits."""
    text = F.concat("c_name", F.lit(" " + _HIDDEN.replace("678", "6789", 1)))
    found = t.customer.select("c_custkey", M.matches(text, "phone").alias("m"))
    return found.select("c_custkey", F.get("m", 0)["start"].cast("long").alias("start"), F.get("m", 0)["end"].cast("long").alias("end"), F.size("m").alias("places"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_linenumber, 1)::INT AS depth FROM lineitem""")
def json_depths(t):
    n = F.col("l_linenumber").cast("int")
    source = F.concat(F.lit("["), F.repeat(F.lit('{"a[{":['), F.floor((n - 1) / 2).cast("int")), F.when(n % 2 == 0, "[").otherwise(""), F.lit('"]}"'))
    depth = F.pandas_udf(lambda s: s.map(forms.json_depth), "int")
    return t.lineitem.select("l_orderkey", "l_linenumber", depth(source).alias("depth"))


@query("""SELECT c_custkey, c_name AS title, 'en' AS lang, 1 AS warnings, 'Body of ' || c_name AS rest FROM customer""")
def front_matters(t):
    read = F.pandas_udf(lambda s: s.map(front_matter).map(lambda r: {"title": r[0].get("title"), "lang": r[0].get("lang"), "warnings": len(r[1]), "rest": r[2]}).apply(__import__("pandas").Series), "title string, lang string, warnings int, rest string")
    source = F.concat(F.lit("---\ntitle: \""), "c_name", F.lit("\"\nlang: en\nlayout: wide\n---\nBody of "), "c_name")
    return t.customer.select("c_custkey", read(source).alias("r")).select("c_custkey", "r.*")


@query("""SELECT c_custkey, c_name AS title, 3 AS elements, (c_custkey % 2)::INT AS active FROM customer""")
def svg_titles(t):
    read = F.pandas_udf(lambda s: __import__("pandas").DataFrame(s.map(forms.read_svg).tolist()), "title string, elements int, active int")
    more = F.when(F.col("c_custkey") % 2 == 1, '<script>x</script>').otherwise("<g/>")
    source = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><title>'), "c_name", F.lit("</title>"), more, F.lit("</svg>"))
    return t.customer.select("c_custkey", read(source).alias("r")).select("c_custkey", "r.*")


@query("""SELECT l_orderkey, l_linenumber, 'w' || l_partkey AS text, l_linenumber::INT AS x0, (l_linenumber + 10)::INT AS x1, (l_suppkey % 100)::DOUBLE AS confidence FROM lineitem""")
def hocr_words(t):
    kind = "array<struct<text:string,x0:int,y0:int,x1:int,y1:int,confidence:double,line:int,paragraph:int>>"
    read = F.pandas_udf(lambda s: s.map(forms.read_hocr), kind)
    n = F.col("l_linenumber")
    source = F.format_string("<p class='ocr_par' title='bbox 0 0 9 9'><span class='ocr_line' title='bbox 0 0 9 9'><span class='ocrx_word' title='bbox %d 2 %d 12; x_wconf %d'>w%d</span></span></p>", n, n + 10, F.col("l_suppkey") % 100, F.col("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.inline(read(source))).select("l_orderkey", "l_linenumber", "text", "x0", "x1", "confidence")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'color=red;line-height=2' ELSE 'font-size=' || c_nationkey || 'pt' END AS css FROM customer""")
def inline_css(t):
    read = F.pandas_udf(lambda s: s.map(lambda x: ";".join(f"{k}={v}" for k, v in forms.read_css(x).items())), "string")
    style = F.when(F.col("c_custkey") % 2 == 0, "line-height:2;color:red;background:url(x);color:expr{}").otherwise(F.concat(F.lit("Font-Size:"), F.col("c_nationkey").cast("string"), F.lit("pt;color:inherit;float:left")))
    return t.customer.select("c_custkey", read(style).alias("css"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS kind, 'image-' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.webp' ELSE '.bin' END AS name FROM part""")
def extracted_images(t):
    """Embedded images out of a map of assets, with the kind that their bytes say."""
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, "89504E470D0A1A0A00").when(k == 1, "FFD8FFE000104A46").when(k == 2, "52494646000000005745425056503820").otherwise("00010203")
    assets = F.create_map(F.concat(F.lit("image-"), F.col("p_partkey").cast("string")), F.base64(F.unhex(content)))
    found = t.part.select("p_partkey", F.explode(assets).alias("id", "data")).withColumn("kind", formats.sniff(F.unbase64("data")))
    return found.select("p_partkey", "kind", F.concat("id", F.lit("."), F.coalesce("kind", F.lit("bin"))).alias("name"))


@query(r"""SELECT doc_id, sha256(text) AS digest FROM documents""")
def chunked_digests(t):
    from sheaf.streaming.queue import chunked_digest

    return t.documents.select("doc_id", chunked_digest(1000)(F.col("text")).alias("digest"))
