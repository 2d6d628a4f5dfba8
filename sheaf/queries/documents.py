"""Queries over read documents: pages as HTML, routes between formats, grids and styles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import text as X
from sheaf.operators import editing as D
from sheaf.operators import scoring as C
from sheaf.operators import tables as G
from sheaf.plans import routes as R
from sheaf.queries.registry import query
from sheaf.sources import formats
from sheaf.sources.csv import read_csv
from sheaf.sources.html import read_html
from sheaf.sources.mail import mail


@query("""
    SELECT page_id, len(regexp_extract_all(html, '<h1>'))::INT AS headings, len(regexp_extract_all(html, '<li>'))::INT AS items, len(regexp_extract_all(html, '<a '))::INT AS links,
           regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def inspect_pages(t):
    def count(kind: str):
        return F.size(F.filter("blocks", lambda b: b.kind == kind))

    return read_html(t.pages).select("page_id", count("heading").alias("headings"), count("list_item").alias("items"), F.size("links").alias("links"), "lang")


@query()
def html_blocks(t):
    return read_html(t.pages).select("page_id", F.inline("blocks"))


@query()
def html_counts(t):
    words = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(F.filter(F.split(b.text, r"\s+"), lambda w: w != "")))
    paragraphs = F.size(F.filter("blocks", lambda b: b.kind == "paragraph"))
    return read_html(t.pages).select("page_id", "title", paragraphs.alias("paragraphs"), words.alias("words"), "images", F.size("warnings").alias("warnings"))


@query("""SELECT page_id, count(*) AS links, count(*) FILTER (regexp_matches(href, '(?i)^(#|(https?|mailto):)')) AS allowed
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def links_allowed(t):
    hrefs = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(X.link_allowed(F.col("href"))).alias("allowed"))


@query("""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1""")
def link_domains(t):
    return t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages"))


@query("""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:script\\b.*?</script|style\\b.*?</style)\\s*>', '', 'gsi'), '<[/!a-zA-Z](?:"[^"]*"|''[^'']*''|[^''">])*>', '', 'gs')) AS digest FROM pages""")
def strip_tags(t):
    return t.pages.select("page_id", F.sha2(X.strip_tags(F.col("html")).cast("binary"), 256).alias("digest"))


@query()
def page_text(t):
    return read_html(t.pages).select("page_id", F.sha2(G.text_of_blocks(F.col("blocks")).cast("binary"), 256).alias("digest"))


@query("""
    WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS item FROM pages),
    n AS (SELECT host, count(DISTINCT page_id) AS of_host FROM l GROUP BY 1)
    SELECT l.host, trim(regexp_replace(regexp_replace(lower(item), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS form, count(DISTINCT page_id) AS pages FROM l JOIN n ON l.host = n.host
    GROUP BY l.host, form, of_host HAVING count(DISTINCT page_id) >= greatest(2, ceil(of_host / 5))""")
def repeated_furniture(t):
    items = t.pages.select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("item")
    )
    hosts = items.groupBy("host").agg(F.count_distinct("page_id").alias("of_host"))
    found = items.groupBy("host", X.running_text(F.col("item")).alias("form")).agg(F.count_distinct("page_id").alias("pages"))
    return found.join(hosts, "host").filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("of_host") / 5))).drop("of_host")


# A graph over the nations: two edges lead out of each, with measures made of its key; some are not measured.
_GRAPH = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, s FROM nation, (VALUES (1), (2)) AS v(s)),
    e AS (SELECT 'f' || k AS from_id, 'f' || (k * s + 3 * s + 1) % 25 AS to_id, 'engine' || (r + s) % 4 AS engine,
                 CASE WHEN k % 5 = 0 THEN ['cloud'] WHEN k % 5 = 1 THEN ['local'] ELSE ['local', 'cloud'] END AS runtime, CASE WHEN (k + s) % 9 > 0 THEN (50 + (k * 7 + s * 13) % 50) / 100.0::DOUBLE END AS fidelity,
                 CASE WHEN (k + s) % 9 > 0 THEN ((k * 11 + s * 3) % 100) / 100.0::DOUBLE END AS editability, CASE WHEN (k + s) % 9 > 0 THEN ((k * 370 + s * 1010) % 6000)::DOUBLE END AS p50_ms
          FROM n WHERE k <> (k * s + 3 * s + 1) % 25),
    c AS (SELECT *, CASE WHEN fidelity IS NULL THEN 1.55 ELSE 0.30 * (1 - fidelity) + 0.60 * (1 - editability) + 0.10 * CASE WHEN p50_ms <= 0 THEN 0 ELSE least(p50_ms / 5000.0, 1.0) END + 0.05 END AS cost FROM e)"""
_ROUTES = _GRAPH + """,
    r AS (SELECT from_id, to_id, [from_id, to_id] AS path, [engine] AS engines, cost::DOUBLE AS cost FROM c
          UNION ALL SELECT r.from_id, c.to_id, list_append(path, c.to_id), list_append(engines, c.engine), r.cost + c.cost FROM r JOIN c ON r.to_id = c.from_id WHERE NOT list_contains(path, c.to_id) AND len(engines) < 4),
    k AS (SELECT *, round(cost, 9) AS price, row_number() OVER (PARTITION BY from_id, to_id ORDER BY round(cost, 9), len(engines), array_to_string(engines, '>'), array_to_string(path, '>')) AS rank FROM r)"""


def _edges(t):
    k, s = F.col("n_nationkey").cast("long"), F.col("s")
    goal = (k * s + 3 * s + 1) % 25
    measured = (k + s) % 9 > 0
    local, cloud = F.lit("local"), F.lit("cloud")
    rows = t.nation.withColumn("s", F.explode(F.array(F.lit(1), F.lit(2)))).filter(k != goal)
    return rows.select(
        F.concat(F.lit("f"), k.cast("string")).alias("from_id"), F.concat(F.lit("f"), goal.cast("string")).alias("to_id"),
        F.concat(F.lit("engine"), ((F.col("n_regionkey") + s) % 4).cast("string")).alias("engine"),
        F.when(k % 5 == 0, F.array(cloud)).when(k % 5 == 1, F.array(local)).otherwise(F.array(local, cloud)).alias("runtime"),
        F.when(measured, (50 + (k * 7 + s * 13) % 50) / 100.0).alias("fidelity"), F.when(measured, (k * 11 + s * 3) % 100 / 100.0).alias("editability"),
        F.when(measured, ((k * 370 + s * 1010) % 6000).cast("double")).alias("p50_ms"),
    )


@query(f"WITH {_GRAPH} SELECT from_id, to_id, engine, round(cost, 6)::DOUBLE AS cost FROM c")
def route_costs(t):
    return _edges(t).select("from_id", "to_id", "engine", F.round(R.edge_cost("editable"), 6).alias("cost"))


@query(f"WITH RECURSIVE {_ROUTES} SELECT from_id, to_id, array_to_string(path, '>') AS path, round(price, 6) AS cost, len(engines)::INT AS steps FROM k WHERE rank = 1")
def best_route(t):
    best = R.ranked(R.routes(_edges(t), "editable"), 1)
    return best.select("from_id", "to_id", F.array_join("path", ">").alias("path"), F.round("cost", 6).alias("cost"), "steps")


@query(f"WITH RECURSIVE {_ROUTES} SELECT from_id, to_id, array_to_string(engines, '>') AS engines, rank::INT AS rank, round(price, 6) AS cost FROM k WHERE rank <= 3")
def route_alternatives(t):
    best = R.ranked(R.routes(_edges(t), "editable"), 3)
    return best.select("from_id", "to_id", F.array_join("engines", ">").alias("engines"), "rank", F.round("cost", 6).alias("cost"))


@query(f"WITH RECURSIVE {_ROUTES} SELECT DISTINCT from_id, to_id FROM r WHERE from_id <> to_id")
def reachable_targets(t):
    return R.reachable(_edges(t))


@query(f"""
    WITH RECURSIVE {_ROUTES}, local AS (SELECT from_id, to_id, engine FROM c WHERE list_contains(runtime, 'local') AND runtime <> ['cloud']) SELECT * FROM local""")
def runtime_edges(t):
    return R.runnable(_edges(t), "local", "private").select("from_id", "to_id", "engine")


@query(f"""
    WITH RECURSIVE {_ROUTES}, b AS (SELECT path, engines, unnest(range(1, len(engines) + 1)) AS i FROM k WHERE rank = 1),
    l AS (SELECT b.path, b.engines, c.fidelity, c.editability, c.p50_ms FROM b JOIN c ON c.from_id = path[i] AND c.to_id = path[i + 1] AND c.engine = engines[i])
    SELECT array_to_string(path, '>') AS path, CASE WHEN bool_and(fidelity IS NOT NULL) THEN round(product(fidelity), 6) END AS fidelity, CASE WHEN bool_and(fidelity IS NOT NULL) THEN sum(p50_ms)::DOUBLE END AS p50_ms FROM l GROUP BY path, engines""")
def plan_scores(t):
    best = R.ranked(R.routes(_edges(t), "editable"), 1)
    return R.path_scores(best, _edges(t)).select(F.array_join("path", ">").alias("path"), "fidelity", "p50_ms")


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'html' WHEN 3 THEN 'markdown' ELSE NULL END AS format FROM part""")
def classify_formats(t):
    k = F.col("p_partkey") % 5
    body = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.lit("  <!DOCTYPE html><p>").cast("binary")).otherwise(F.lit("text").cast("binary"))
    name = F.when(k == 3, "a.MD").otherwise("a.bin")
    return t.part.select("p_partkey", formats.classify(body, name).alias("format"))


@query("""
    WITH f AS (SELECT n_regionkey, string_agg(n_nationkey || ';' || n_name, e'\\n' ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)
    SELECT n_regionkey, ';' AS delimiter, 2::INT AS columns, (ord - 1)::INT AS r, line FROM (SELECT n_regionkey, 'key;name' || e'\\n' || body AS body FROM f), unnest(string_split(body, e'\\n')) WITH ORDINALITY AS u(line, ord)""")
def csv_reader(t):
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x.line), "\n")
    files = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("key;name\n"), body).alias("body"))
    out = read_csv(files, "n_regionkey", "body")
    return out.select("n_regionkey", "delimiter", "columns", "r", F.array_join("cells", ";").alias("line"))


@query("""SELECT conv_id, turn, role || '@example.com' AS sender, 'Turn ' || turn AS subject, length(trim(text, e' \\n\\r\\t'))::INT AS size FROM conversations""")
def mail_reader(t):
    rows = t.conversations
    source = F.concat(F.lit("From: "), "role", F.lit("@example.com\nTo: x@example.com\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n"))
    out = rows.select("conv_id", "turn", mail(source).alias("m"))
    return out.select("conv_id", "turn", F.col("m.from").alias("sender"), "m.subject", F.length("m.body").alias("size"))


@query("""
    SELECT o_custkey AS tab, ((rn - 1) // 3)::INT AS r, ((rn - 1) % 3)::INT AS c, o_orderpriority AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
    UNION ALL SELECT o_custkey, ((n) // 3)::INT, k::INT, '' FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), unnest(range(0, 3)) AS u(k) WHERE n % 3 <> 0 AND k >= n % 3 AND n > 3
    UNION ALL SELECT NULL, NULL, NULL, NULL WHERE false""")
def table_grid(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = t.orders.select(
        F.col("o_custkey").alias("tab"), F.floor(k / 3).cast("int").alias("r"), (k % 3).alias("c"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.col("o_orderpriority").alias("text")
    )
    return G.grids(cells, "tab")


@query("""
    SELECT c_custkey, sha256('# ' || c_name || e'\n\n' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CASE WHEN c_custkey % 3 = 1 THEN 'New text' ELSE c_mktsegment END || e'\n\n' END || e'- one\n\n- two\n') AS digest,
           CASE c_custkey % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' END AS change, 1.0::DOUBLE AS fidelity FROM customer""")
def edit_and_export(t):
    """Small Markdown files, of which the second block is changed, removed or left."""
    k = F.col("c_custkey")
    files = t.customer.select("c_custkey", F.concat(F.lit("# "), "c_name", F.lit("\n\n"), "c_mktsegment", F.lit("\n\n- one\n- two\n")).alias("text"))
    edits = t.customer.filter(k % 3 < 2).select("c_custkey", F.lit("b1").alias("id"), F.when(k % 3 == 1, "New text").alias("text"))
    out = D.exported(D.opened(files, "c_custkey", "text", "markdown"), edits, "c_custkey", "markdown")
    return out.select("c_custkey", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.get("changes", 0)["kind"].alias("change"), F.round("fidelity", 6).alias("fidelity"))


@query("SELECT page_id, true AS whole, title FROM (SELECT page_id, nullif(trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '[ \\t\\n]+', ' ', 'g')), '') AS title FROM pages)")
def open_pages(t):
    """Pages opened for editing: writing their blocks and reading them again keeps the text. The title is as the source has it,
    where only &amp; stands for another sign."""
    title = F.replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    title = F.nullif(F.trim(F.regexp_replace(title, "[ \\t\\n]+", " ")), F.lit(""))
    found = D.opened(t.pages.select(F.struct("page_id", title.alias("title")).alias("page"), "html"), "page", "html", "html")
    return found.select("page.page_id", (F.col("preview") > 0.999).alias("whole"), "page.title")


@query(f"""
    WITH {_GRAPH} SELECT engine, count(*) AS edges, count(fidelity) AS measured, count(*) FILTER (list_contains(runtime, 'local')) AS local, count(DISTINCT from_id) AS inputs, count(DISTINCT to_id) AS outputs FROM e GROUP BY 1""")
def engine_specs(t):
    """The table of engines: what each converts, and how much of that is measured and runs here."""
    return R.engines(_edges(t))


@query(f"""
    WITH RECURSIVE {_ROUTES}, f AS (SELECT DISTINCT from_id AS format FROM e UNION SELECT to_id FROM e), m AS (SELECT from_id, count(*) AS targets, max(len(engines)) AS steps FROM k WHERE rank = 1 AND from_id <> to_id GROUP BY 1)
    SELECT format, coalesce(targets, 0) AS targets, steps::INT AS steps FROM f LEFT JOIN m ON f.format = m.from_id""")
def doctor_report(t):
    """For each format, how many others it reaches and the longest of the best routes there."""
    return R.coverage(_edges(t), R.ranked(R.routes(_edges(t), "editable"), 1))


def _package(key: int) -> bytes:
    """A small container whose kind depends on a number."""
    import io
    import zipfile

    kind = key % 6
    if kind >= 4:  # a compound file of a header, one table and one directory sector
        entry = ("WordDocument" if kind == 4 else "__properties_version1.0").encode("utf-16-le")
        head = formats.OLE + bytes(22) + (9).to_bytes(2, "little") + bytes(16) + (1).to_bytes(4, "little") + bytes(24) + bytes(4) + b"\xff" * (4 * 108)
        table = b"\xfd\xff\xff\xff\xfe\xff\xff\xff" + b"\xff" * 504
        return head + table + (entry.ljust(64, b"\0") + (len(entry) + 2).to_bytes(2, "little")).ljust(512, b"\0")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == 0:
            z.writestr("mimetype", "application/epub+zip")
        elif kind < 3:
            z.writestr("[Content_Types].xml", "<x/>")
            z.writestr("word/document.xml" if kind == 1 else "xl/workbook.xml", "<x/>")
        else:
            z.writestr("a.txt", "x")
    return out.getvalue()


@query("""SELECT p_partkey, ['epub', 'docx', 'xlsx', 'zip', 'doc', 'msg'][p_partkey % 6 + 1] AS format FROM part""")
def classify_containers(t):
    made = F.pandas_udf(lambda keys: keys.map(_package), "binary")
    return t.part.select("p_partkey", formats.classify(made("p_partkey"), F.lit("a.bin")).alias("format"))


@query("""
    WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS based_on, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 5 = 0 THEN p_size > 20 END AS bold FROM part),
    r AS (SELECT style, style AS at, 0 AS depth FROM s UNION ALL SELECT r.style, s.based_on, depth + 1 FROM r JOIN s ON r.at = s.style WHERE s.based_on IS NOT NULL)
    SELECT r.style, arg_min(s.size, depth) FILTER (s.size IS NOT NULL) AS size, arg_min(s.bold, depth) FILTER (s.bold IS NOT NULL) AS bold FROM r JOIN s ON r.at = s.style GROUP BY 1""")
def style_cascade(t):
    key = F.col("p_partkey")
    styles = t.part.select(
        key.alias("style"), F.when(key > 0, F.floor(key / 3)).alias("based_on"), F.when(key % 4 == 0, F.col("p_size")).alias("size"),
        F.when(key % 5 == 0, F.col("p_size") > 20).alias("bold"),
    )
    return G.cascaded(styles, ["size", "bold"])


@query("""
    WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey % 50 = 49 THEN p_partkey WHEN p_partkey % 50 > 0 THEN p_partkey - 1 END AS based_on FROM part),
    r AS (SELECT style, based_on AS at, 0 AS depth FROM s UNION ALL SELECT r.style, s.based_on, depth + 1 FROM r JOIN s ON r.at = s.style WHERE depth < 16)
    SELECT style FROM r WHERE depth = 16 AND r.at IS NOT NULL""")
def style_faults(t):
    key = F.col("p_partkey")
    parent = F.when(key % 50 == 49, key).when(key % 50 > 0, key - 1)
    return G.chain_faults(t.part.select(key.alias("style"), parent.alias("based_on")))


_RICH = [
    '<p>Sum <math><semantics><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation></semantics></math> of ', None, '<a role="doc-noteref" href="#n1">1</a></p>',
    '<ul><li><input type="checkbox" checked> done</li><li><input type="checkbox"> open</li></ul><img src="data:image/png;base64,', "b64", '" alt="dot"><img src="http://a/b.png">',
    '<section role="doc-endnotes"><ol><li id="n1">Note on ', None, ' <a role="doc-backlink" href="#r">back</a></li></ol></section><p>End</p>',
]


@query("""
    SELECT c_custkey AS page_id, 'Sum x^2 of ' || c_name AS first, 'Note on ' || c_name AS note, 'n1' AS ref, true AS done, false AS open, length(c_name)::INT AS bytes, sha256(c_name) AS digest, 1 AS linked, 5 AS blocks
    FROM customer""")
def html_features(t):
    """Formulas, footnotes, tasks and embedded images."""
    parts = [F.col("c_name") if x is None else F.base64(F.col("c_name").cast("binary")) if x == "b64" else F.lit(x) for x in _RICH]
    found = read_html(t.customer.select("c_custkey", F.concat(*parts).alias("html")), "c_custkey")

    def text(i: int):
        return F.get("blocks", i)["text"]

    data = F.filter("assets", lambda a: a.digest.isNotNull())
    return found.select(
        "page_id", text(0).alias("first"), F.get(F.filter("blocks", lambda b: b.note == "n1"), 0)["text"].alias("note"), F.get("note_refs", 0).alias("ref"), F.get("blocks", 1)["checked"].alias("done"),
        F.get("blocks", 2)["checked"].alias("open"), F.get(data, 0)["bytes"].alias("bytes"), F.get(data, 0)["digest"].alias("digest"), (F.size("assets") - F.size(data)).alias("linked"), F.size("blocks").alias("blocks"),
    )


@query("""
    SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'elements are nested too deeply' END AS error, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS blocks FROM part""")
def html_limits(t):
    deep = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit("<div>"), F.lit(1100))).otherwise("<p>")
    parts = t.part.select("p_partkey").repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey")  # few bytes, but long pages
    found = read_html(parts.select("p_partkey", F.concat(deep, F.lit("x")).alias("html")), "p_partkey")
    return found.select("page_id", "error", F.size("blocks").alias("blocks"))


@query()
def heading_distances(t):
    import pandas as pd

    def score(frames):
        for frame in frames:
            values = [C.heading_distance([(h["level"], h["text"]) for h in a], [(h["level"], h["text"]) for h in b]) for a, b in zip(frame["a"], frame["b"], strict=True)]
            yield pd.DataFrame({"doc": frame["doc"], "distance": values})

    heads = t.part.select(F.floor(F.col("p_partkey") / 8).alias("doc"), F.struct(F.col("p_partkey").alias("ord"), (F.col("p_size") % 3 + 1).cast("int").alias("level"), F.col("p_name").alias("text")).alias("h"))
    lists = heads.groupBy("doc").agg(F.array_sort(F.collect_list("h")).alias("a"))
    pairs = lists.join(lists.select((F.col("doc") - 1).alias("doc"), F.col("a").alias("b")), "doc")
    return pairs.mapInPandas(score, "doc long, distance double")
