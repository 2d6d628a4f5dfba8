"""Queries for the remaining tools and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators import matches as M
from sheaf.queries.pages import plan
from sheaf.queries.registry import query


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') + 1 AS files, string_agg(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey || '.txt' END, ',' ORDER BY o_orderkey) AS names
    FROM orders GROUP BY 1""")
def attachments_edit(t):
    files = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("name"))))
    out = t.orders.groupBy("o_custkey").agg(F.filter(files, lambda x: x.state != "P").alias("kept"))
    added = F.concat(F.transform("kept", lambda x: x["name"]), F.array(F.lit("cover.txt")))
    names = F.array_join(F.transform("kept", lambda x: x["name"]), ",")
    return out.select("o_custkey", F.size(added).cast("long").alias("files"), F.nullif(names, F.lit("")).alias("names"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def portfolio_round_trip(t):
    packed = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("files"))
    return packed.select("o_custkey", F.inline("files"))


@query("""SELECT c_custkey, 'two-column' AS page_layout, c_custkey % 2 = 0 AS hide_toolbar, true AS fit_window FROM customer""")
def viewer_prefs(t):
    prefs = F.struct(F.lit("single").alias("page_layout"), (F.col("c_custkey") % 2 == 0).alias("hide_toolbar"))
    out = prefs.withField("page_layout", F.lit("two-column")).withField("fit_window", F.lit(True))
    return t.customer.select("c_custkey", out.alias("p")).select("c_custkey", "p.*")


@query("""
    WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN l_linenumber + 10 ELSE 0 END AS code FROM lineitem)
    SELECT batch, coalesce(min(code) FILTER (code > 0), 0)::INT AS exit_code, count(*) FILTER (code > 0) AS failed FROM r GROUP BY 1""")
def batch_exit_code(t):
    code = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") + 10)
    rows = t.lineitem.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("ord"), code.alias("code"))
    first = F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord")))
    return rows.groupBy("batch").agg(F.coalesce(first, F.lit(0)).alias("exit_code"), F.count("code").alias("failed"))


@query("""SELECT o_orderkey, greatest(30, ceil(o_totalprice * 1000 / 262144))::BIGINT AS seconds FROM orders""")
def transfer_allowance(t):
    return t.orders.select("o_orderkey", F.greatest(F.lit(30), F.ceil(F.col("o_totalprice") * 1000 / 262_144)).cast("long").alias("seconds"))


@query("""
    WITH p AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS page, count(*) OVER (PARTITION BY l_orderkey) AS n, 1 - l_discount AS s FROM lineitem)
    SELECT doc, round(min(s), 6) AS floor, min(s) >= 0.98 AS accepted FROM p WHERE page IN (1, (n + 1) // 2, n) GROUP BY 1""")
def similarity_floor(t):
    rows = plan(t, (1 - F.col("l_discount")).alias("s")).withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    seen = rows.filter((F.col("page") == 1) | (F.col("page") == F.floor((F.col("n") + 1) / 2)) | (F.col("page") == F.col("n")))
    return seen.groupBy("doc").agg(F.round(F.min("s"), 6).alias("floor"), (F.min("s") >= 0.98).alias("accepted"))


@query("""
    WITH f AS (SELECT event_type, user_id, median(value) AS wall, max(value) AS peak FROM events GROUP BY ALL)
    SELECT event_type, round(avg(wall), 4) AS mean_wall, max(peak) AS peak, count(*) AS fixtures, count(*) FILTER (wall > 100) AS slow FROM f GROUP BY 1""")
def sample_recorder(t):
    each = t.events.groupBy("event_type", "user_id").agg(F.median("value").alias("wall"), F.max("value").alias("peak"))
    return each.groupBy("event_type").agg(F.round(F.avg("wall"), 4).alias("mean_wall"), F.max("peak").alias("peak"), F.count("*").alias("fixtures"), F.count_if(F.col("wall") > 100).alias("slow"))


@query("""
    WITH n AS (SELECT user_id, event_type, count(*) AS samples, min(value) AS least FROM events GROUP BY ALL)
    SELECT user_id, event_type, CASE WHEN samples < 12 THEN 'too few samples' ELSE 'no measure' END AS violation FROM n WHERE samples < 12 OR least <= 0""")
def capability_violations(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("samples"), F.min("value").alias("least"))
    violation = F.when(F.col("samples") < 12, "too few samples").when(F.col("least") <= 0, "no measure")
    return n.withColumn("violation", violation).filter("violation IS NOT NULL").select("user_id", "event_type", "violation")


@query("""
    SELECT x.vec_id AS a, abs(x.embedding[1] - y.embedding[1])::DOUBLE * 10 <= 0.5 AND greatest(abs(x.vec_id % 7 - y.vec_id % 7), abs(x.vec_id % 5 - y.vec_id % 5), 0) <= 2 AND x.label = y.label AS same
    FROM embeddings x JOIN embeddings y ON x.vec_id + 1 = y.vec_id""")
def style_matches(t):
    def run(prefix):
        key = F.col(f"{prefix}.vec_id")
        return {"size": F.get(f"{prefix}.embedding", 0).cast("double") * 10, "red": key % 7, "green": key % 5, "blue": F.lit(0), "font": F.col(f"{prefix}.label")}

    x, y = t.embeddings.alias("x"), t.embeddings.alias("y")
    return x.join(y, F.col("x.vec_id") + 1 == F.col("y.vec_id")).select(F.col("x.vec_id").alias("a"), M.same_style(run("x"), run("y")).alias("same"))


@query("""SELECT event_id, '{"text":"' || upper(event_type) || '","id":"' || event_type || '"}' AS json FROM events""")
def rewrite_json_texts(t):
    source = F.to_json(F.struct(F.col("event_type").alias("text"), F.col("event_type").alias("id")))
    return t.events.select("event_id", M.upper_texts(source).alias("json"))


@query()
def list_overlaps(t):
    lists = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))).alias("items"))
    docs = lists.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "items"))).alias("s"))
    docs = docs.select(F.col("l_orderkey").alias("doc"), F.transform("s", lambda x: x["items"]).alias("a"))
    other = F.lag("a").over(Window.partitionBy(F.floor(F.col("doc") / 64)).orderBy("doc"))
    return M.list_overlaps(docs.withColumn("b", F.coalesce(other, F.array(F.array(F.lit("1"), F.lit("2"))))))
