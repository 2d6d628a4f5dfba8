"""Layout, record, colour and recipe queries over tables that stand in for lines, fields and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheaf.operators import colors as K
from sheaf.operators import layout as L
from sheaf.operators import records as D
from sheaf.plans import recipes as R
from sheaf.queries.registry import query
from sheaf.sources.forms import records
from sheaf.sources.markdown import markdown, read_markdown, write_html, write_markdown

SQL_LINES = """
    lines AS (SELECT p_partkey // 40 AS doc, (p_partkey % 40) // 8 + 1 AS page, p_partkey % 40 AS ord, CASE WHEN p_partkey % 8 = 0 THEN 'Report ' || (p_partkey % 40) // 8 ELSE p_name END AS text,
                     9 + p_size % 4 AS size, (p_partkey % 8) * 100.0 + 10 AS top, 800.0 AS height FROM part)"""


def lines(t):
    k = F.col("p_partkey")
    page = F.floor(k % 40 / 8) + 1
    text = F.when(k % 8 == 0, F.concat(F.lit("Report "), (page - 1).cast("string"))).otherwise(F.col("p_name"))
    return t.part.select(
        F.floor(k / 40).alias("doc"), page.alias("page"), (k % 40).alias("ord"), text.alias("text"), (9 + F.col("p_size") % 4).alias("size"), (k % 8 * 100.0 + 10).alias("top"), F.lit(800.0).alias("height")
    )


@query(f"""
    WITH {SQL_LINES}, s AS (SELECT doc, size::DOUBLE AS half, sum(length(text)) AS chars FROM lines GROUP BY ALL)
    SELECT doc, first(half ORDER BY chars DESC, half) AS body FROM s GROUP BY 1""")
def body_size(t):
    return L.body_sizes(lines(t))


@query(f"""
    WITH {SQL_LINES}, s AS (SELECT doc, size::DOUBLE AS half, sum(length(text)) AS chars FROM lines GROUP BY ALL), b AS (SELECT doc, first(half ORDER BY chars DESC, half) AS body FROM s GROUP BY 1),
    h AS (SELECT lines.*, size / body >= 1.15 AND NOT regexp_matches(text, '^\\p{{Ll}}') AND NOT regexp_matches(text, '[-,]\\s*$') AS head FROM lines JOIN b USING (doc))
    SELECT doc, ord, CASE WHEN head THEN least(dense_rank() OVER (PARTITION BY doc, head ORDER BY size DESC), 3) END::INT AS level FROM h""")
def heading_levels(t):
    return L.headings(lines(t)).select("doc", "ord", "level")


@query(f"""
    WITH {SQL_LINES}, o AS (SELECT *, CASE WHEN top <= 96 THEN 'head' WHEN top >= 704 THEN 'foot' END AS zone, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS form FROM lines),
    n AS (SELECT doc, count(DISTINCT page) AS n FROM lines GROUP BY 1), f AS (SELECT doc, zone, form, count(DISTINCT page) AS c FROM o WHERE zone IS NOT NULL GROUP BY ALL)
    SELECT o.doc, o.page, ord FROM o JOIN f ON o.doc = f.doc AND o.zone = f.zone AND o.form = f.form JOIN n ON o.doc = n.doc WHERE c >= greatest(2, ceil(n / 5))""")
def running_heads(t):
    return L.furniture(lines(t))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '•' WHEN 1 THEN '1.' WHEN 2 THEN 'a)' WHEN 3 THEN '(iv)' END AS marker FROM lineitem""")
def list_markers(t):
    k = F.col("l_linenumber") % 5
    text = F.when(k == 0, "• item").when(k == 1, "1. item").when(k == 2, " a) item").when(k == 3, "(iv) item").otherwise("item 1.")
    return t.lineitem.select("l_orderkey", "l_linenumber", L.list_marker(text).alias("marker"))


@query("""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
    c AS (SELECT item_id, string_split(text, ' ') AS parts FROM benchmark),
    h AS (SELECT item_id, regexp_extract(parts[1], '^[A-Za-z]+') AS head, regexp_extract(parts[2], '^[A-Za-z]+') AS tail FROM c WHERE parts[1] NOT LIKE '%-' AND regexp_matches(parts[1], '^[A-Za-z]+$') AND regexp_matches(parts[2], '^[A-Za-z]'))
    SELECT item_id AS doc, 1 AS page, 0 AS ord, CASE WHEN EXISTS (SELECT 1 FROM w WHERE word = lower(head || tail)) THEN head || tail ELSE head || '-' || tail END AS word FROM h""")
def hyphen_join(t):
    parts = F.split("text", " ")
    vocabulary = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    shaped = t.benchmark.filter(F.get(parts, 0).rlike("^[A-Za-z]+$") & F.get(parts, 1).rlike("^[A-Za-z]"))
    cut = F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.concat(F.get(parts, 0), F.lit("-")).alias("text")), F.struct(F.lit(1).alias("ord"), F.regexp_extract(F.get(parts, 1), "^[A-Za-z]+", 0).alias("text"))))
    both = shaped.select(F.col("item_id").alias("doc"), F.lit(1).alias("page"), cut.alias("l")).select("doc", "page", "l.*")
    return L.joined_hyphens(both, vocabulary)


@query("""
    WITH h AS (SELECT p_partkey // 30 AS doc, p_partkey AS ord, (p_size % 4 + 1)::INT AS level FROM part)
    SELECT doc, ord, level, (SELECT max(x.ord) FROM h x WHERE x.doc = h.doc AND x.ord < h.ord AND x.level < h.level) AS parent FROM h""")
def outline_from_headings(t):
    heads = t.part.select(F.floor(F.col("p_partkey") / 30).alias("doc"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 4 + 1).cast("int").alias("level"))
    return L.outline(heads)


@query("""
    WITH v AS (SELECT l_orderkey AS doc, l_returnflag AS text, l_linenumber AS page, l_partkey AS id FROM lineitem WHERE l_linestatus = 'O'),
    w AS (SELECT l_orderkey AS doc, l_returnflag AS text, l_linenumber AS page, l_suppkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linestatus = 'F')
    SELECT count(*) AS left_rows, (SELECT count(*) FROM w) AS right_rows FROM v""")
def layout_inputs(t):
    left, right = _layouts(t)
    rows = left.select(F.lit(True).alias("is_left")).unionByName(right.select(F.lit(False).alias("is_left")))
    return rows.agg(F.count_if("is_left").alias("left_rows"), F.count_if(~F.col("is_left")).alias("right_rows"))


def _layouts(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("text"), F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey", "l_linestatus")
    left = rows.filter("l_linestatus = 'O'").select("doc", "text", "page", F.col("l_partkey").alias("id"))
    return left, rows.filter("l_linestatus = 'F'").select("doc", "text", "page", (F.col("l_suppkey") * 10 + F.col("page")).alias("id"))


@query()
def layout_pairs(t):
    return L.layout_pairs(*_layouts(t))


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 10 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS gray, round(1 - r, 6) AS inverted,
           CASE WHEN greatest(abs(r - 0.5), abs(g - 0.5), abs(b - 0.5)) <= 0.2 THEN 0.9 ELSE r END AS replaced FROM c""")
def color_maps(t):
    rgb = (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(K.grayscale(rgb)[0], 6).alias("gray"), F.round(K.inverted(rgb)[0], 6).alias("inverted"), K.replaced(rgb, (0.5, 0.5, 0.5), (0.9, 0.1, 0.1), 0.2)[0].alias("replaced")
    )


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, greatest(0, least(1, (l_quantity / 50 + 0.1 - 0.5) * 1.2 + 0.5)) AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(pow(r, 1 / 2.2), 6) AS value FROM c""")
def color_adjust(t):
    x = F.col("l_quantity") / 50
    out = K.adjusted((x, x, x), brightness=0.1, contrast=1.2, saturation=0.5, gamma=2.2)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(out[0], 6).alias("value"))


@query("""
    WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS note, o_orderstatus AS state FROM orders)
    SELECT id, CASE WHEN id % 3 = 1 THEN upper(note) ELSE note END AS note, state FROM a WHERE id % 5 <> 0
    UNION ALL SELECT -s_suppkey - 1, s_name, 'N' FROM supplier""")
def annotations_edit(t):
    table = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("state"))
    changes = table.filter("id % 3 = 1").select("id", F.upper("note").alias("note"))
    added = t.supplier.select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("note"), F.lit("N").alias("state"))
    return D.edited(table, "id", changes, table.filter("id % 5 = 0"), added)


@query("""
    WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, 'f' || p_partkey % 10 AS part FROM part),
    r AS (SELECT id, parent AS up, part AS name FROM f UNION ALL SELECT r.id, f.parent, f.part || '.' || name FROM r JOIN f ON r.up = f.id)
    SELECT id, name FROM r WHERE up IS NULL""")
def form_names(t):
    k = F.col("p_partkey")
    fields = t.part.select(k.alias("id"), F.when(k >= 10, F.floor(k / 10)).alias("parent"), F.concat(F.lit("f"), (k % 10).cast("string")).alias("part"))
    return D.dotted_names(fields)


@query("""
    SELECT c_custkey AS id, key, value FROM customer, LATERAL (SELECT unnest(['name', 'seg']) AS key, unnest([c_name, c_mktsegment]) AS value) x""")
def forms_import(t):
    source = F.concat(F.lit("name,seg\n"), "c_name", F.lit(","), "c_mktsegment")
    return t.customer.select(F.col("c_custkey").alias("id"), F.explode(records(source, F.lit("csv"))).alias("r")).select("id", F.explode("r"))


@query("""
    SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 1 AS kept_script, CASE l_linenumber % 3 WHEN 0 THEN 'script' WHEN 1 THEN 'link' ELSE 'other' END AS category FROM lineitem""")
def sanitize_actions(t):
    k = F.col("l_linenumber")
    kind = F.when(k % 3 == 0, "javascript").when(k % 3 == 1, "uri").otherwise("named")
    actions = F.array(F.struct(F.when(k % 2 == 0, "launch").otherwise("named").alias("kind")))
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.size(D.without_active(actions, ["script"])) > 0).alias("kept_script"), D.category(kind).alias("category"))


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AS base_visible, false AS notes_visible FROM supplier""")
def toggle_layers(t):
    layers = F.array(F.struct(F.lit("base").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("visible")), F.struct(F.lit("notes").alias("name"), F.lit(True).alias("visible")))
    out = D.toggled(layers, ["notes"], False)
    return t.supplier.select("s_suppkey", F.get(out, 0)["visible"].alias("base_visible"), F.get(out, 1)["visible"].alias("notes_visible"))


@query("SELECT doc_id, sha256(text) AS digest, true AS refused FROM documents")
def seal_and_open(t):
    key, wrong = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    sealed = t.documents.select("doc_id", D.sealed(F.col("text").cast("binary"), key).alias("s"))
    return sealed.select("doc_id", F.sha2(D.opened(F.col("s"), key), 256).alias("digest"), D.opened(F.col("s"), wrong).isNull().alias("refused"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def decompress_streams(t):
    import zlib

    @F.pandas_udf(T.BinaryType())
    def pack(text: pd.Series) -> pd.Series:
        return text.map(lambda x: zlib.compress(x.encode()))

    return t.documents.select("doc_id", F.sha2(D.unpacked_stream(pack("text")), 256).alias("digest"))


@query("""
    SELECT doc_id, n_chars > 1000 AND doc_id % 2 = 0 AS long_even, n_chars <> 500 AS not_500, NOT (lang = 'de') AS no_ocr FROM documents""")
def recipe_predicates(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("page_count"), F.col("n_chars").alias("size_bytes"), (F.col("lang") == "de").alias("needs_ocr"))
    return rows.select("doc_id", R.predicate("page_count > 1000").alias("long_even"), R.predicate("size_bytes != 500").alias("not_500"), R.predicate("!needs_ocr").alias("no_ocr"))


@query("""
    SELECT doc_id, CASE WHEN n_chars > 2000 AND n_chars % 13 > 0 THEN lang || '!' ELSE lang END AS lang, CASE WHEN n_chars >= 300 AND n_chars % 13 = 0 THEN 'stopped' END AS error,
           CASE WHEN n_chars < 300 THEN 'step 1: too short' END AS warning
    FROM documents WHERE n_chars <= 20000 OR n_chars % 13 = 0""")
def recipe_run(t):
    """Short texts go on with a warning, every thirteenth of the others stops, long ones are skipped, and the rest is marked."""
    size = F.col("size_bytes")
    tools = {
        "check": lambda df: df.withColumn("error", F.when(size < 300, "too short")).withColumn("lang", F.when(size < 300, "lost").otherwise(F.col("lang"))),
        "stop": lambda df: df.withColumn("error", F.when((size % 13 == 0) & (size >= 300), "stopped")),
        "long": lambda df: df.withColumn("error", F.when(size > 20_000, "too long")),
        "mark": lambda df: df.withColumn("lang", F.concat("lang", F.lit("!"))),
    }
    steps = [{"tool": "check", "on_error": "continue"}, {"tool": "stop"}, {"tool": "long", "on_error": "skip"}, {"tool": "mark", "if": "size_bytes > 2000"}]
    out = R.run(t.documents.select("doc_id", "lang", F.col("n_chars").alias("size_bytes")), steps, tools)
    return out.select("doc_id", "lang", "error", F.get("warnings", 0).alias("warning"))


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS a, l_suppkey % 256 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
           OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19)) OR a >= 224) AS public FROM a""")
def public_addresses(t):
    address = F.concat_ws(".", (F.col("l_partkey") % 256).cast("string"), (F.col("l_suppkey") % 256).cast("string"), F.lit("0"), F.lit("9"))
    return t.lineitem.select("l_orderkey", "l_linenumber", R.is_public(address).alias("public"))


@query("""SELECT o_custkey, max(o_orderpriority) AS plan_name, CASE WHEN o_custkey % 2 = 0 THEN count(*) <= 25 AND sum(o_totalprice) * 1000 <= 250000000 ELSE true END AS allowed FROM orders GROUP BY o_custkey""")
def tool_access(t):
    used = t.orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("plan_name"), F.count("*").alias("files"), (F.sum("o_totalprice") * 1000).alias("size"))
    plan = F.when(F.col("o_custkey") % 2 == 0, "free").otherwise("paid")
    return used.select("o_custkey", "plan_name", R.tool_allowed(plan, F.col("files"), F.col("size")).alias("allowed"))


@query()
def markdown_blocks(t):
    return t.documents.select("doc_id", markdown("text").alias("m")).select("doc_id", F.inline("m.blocks"))


@query("SELECT doc_id, true AS same FROM documents")
def markdown_round_trip(t):
    @F.pandas_udf(T.BooleanType())
    def same(text: pd.Series) -> pd.Series:
        def check(x: str) -> bool:
            first = read_markdown(x)["blocks"]
            return read_markdown(write_markdown(first))["blocks"] == first and write_html(first).startswith("<!doctype html>")

        return text.map(check)

    return t.documents.select("doc_id", same("text").alias("same"))


@query("""
    WITH b AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), c AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT c.event_type, round(c.m - b.m, 6) AS change, c.n AS samples, c.n < 2 AS too_few FROM c LEFT JOIN b ON c.event_type = b.event_type""")
def baseline_report(t):
    cut = F.expr("TIMESTAMP '2024-01-15 00:00:00'")
    before = t.events.filter(F.col("ts") < cut).groupBy("event_type").agg(F.avg("value").alias("b"))
    now = t.events.filter(F.col("ts") >= cut).groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("samples"))
    out = now.join(before, "event_type", "left")
    return out.select("event_type", F.round(F.col("m") - F.col("b"), 6).alias("change"), "samples", (F.col("samples") < 2).alias("too_few"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS n FROM lineitem),
    g AS (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY n) = l_returnflag THEN 0 ELSE 1 END AS cut FROM s),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM g)
    SELECT l_orderkey, run::BIGINT AS run, any_value(l_returnflag) AS style, count(*) AS length FROM r GROUP BY l_orderkey, run""")
def style_runs(t):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    cut = F.when(F.lag("l_returnflag").over(own) == F.col("l_returnflag"), 0).otherwise(1)
    rows = t.lineitem.withColumn("cut", cut).withColumn("run", F.sum("cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("l_orderkey", "run").agg(F.first("l_returnflag").alias("style"), F.count("*").alias("length"))
