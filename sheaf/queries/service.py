"""Service queries: events stand in for the usage ledger, orders for jobs, customers for workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators import service as S
from sheaf.operators.prefix import running
from sheaf.queries.registry import query

AS_OF = "2024-01-20 00:00:00"
SQL_AS_OF = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(f"""
    WITH u AS (SELECT user_id, count(*) AS uses, sum(value) AS amount FROM events
               WHERE ts > {SQL_AS_OF} - INTERVAL 1 DAY AND ts <= {SQL_AS_OF} GROUP BY 1)
    SELECT s.user_id, coalesce(uses, 0) AS uses, round(coalesce(amount, 0), 4) AS amount,
           coalesce(uses, 0) < 5 AND coalesce(amount, 0) < 200 AS allowed
    FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN u ON s.user_id = u.user_id""")
def quota_usage(t):
    used = S.usage(t.events, "user_id", "value", "ts", as_of())
    out = S.with_quota(t.events.select("user_id").distinct(), used, "user_id", 5, 200.0)
    return out.withColumn("amount", F.round("amount", 4))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS sum_click,
           count(*) FILTER (event_type = 'view') AS n_view, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS sum_view
    FROM events GROUP BY user_id""")
def quota_filter_agg(t):
    return S.filtered_counts(t.events, "user_id", "event_type", ["click", "view"], "value")


@query("""
    SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, greatest(count(*) - 1, 0) AS denied
    FROM events GROUP BY ALL""")
def rate_limit_windows(t):
    return S.rate_windows(t.events, "user_id", "ts", "1 hour", 1)


@query("""
    WITH n AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events)
    SELECT event_id, user_id, admitted,
           CASE WHEN NOT admitted THEN greatest(ceil(3600 - (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000000), 1)::BIGINT END AS retry_after
    FROM n""")
def rate_limit_admission(t):
    out = S.admissions(t.events, "event_type", "ts", "event_id", "hour", 3600, 2)
    return out.select("event_id", "user_id", "admitted", "retry_after")


@query("""
    SELECT event_id, count(*) OVER w AS uses, round(sum(value) OVER w, 6) AS amount FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def trailing_day_usage(t):
    return S.trailing_usage(t.events, "user_id", "ts", "value").select("event_id", "uses", "amount")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS renewals FROM s GROUP BY user_id, n""")
def lease_sessions(t):
    return S.sessions(t.events, "user_id", "ts", "12 hours")


@query(f"""
    SELECT count(*) FILTER (user_id = 7) AS of_subject, count(*) FILTER (event_type = 'click') AS of_job
    FROM events WHERE ts > {SQL_AS_OF} - INTERVAL 90 HOUR AND ts <= {SQL_AS_OF}""")
def lease_counts(t):
    live = S.trailing(t.events, "ts", as_of(), "90 HOUR")
    return live.agg(F.count_if(F.col("user_id") == 7).alias("of_subject"), F.count_if(F.col("event_type") == "click").alias("of_job"))


@query("""
    SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01 00:00:00', 500)
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(t):
    cursor = [F.lit("1996-01-01 00:00:00").cast("timestamp"), F.lit(500).cast("long")]
    rows = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select("o_orderkey", "o_orderdate")
    return S.keyset_page(rows, ["o_orderdate", "o_orderkey"], cursor, 50)


@query("""SELECT event_id, base64(encode('{"event_id":' || event_id || ',"user_id":' || user_id || '}')) AS cursor FROM events""")
def cursor_codec(t):
    return t.events.select("event_id", S.cursor_text("event_id", "user_id").alias("cursor"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 500")
def event_cursor_scan(t):
    return t.events.filter("event_id > 500").orderBy("event_id").limit(500).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def oldest_first_batch(t):
    return t.orders.filter("o_orderstatus <> 'O'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("""
    SELECT c_custkey, checked_at FROM (SELECT c_custkey, max(o_orderdate) AS checked_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    ORDER BY checked_at ASC NULLS FIRST, c_custkey LIMIT 200""")
def nulls_first_rotation(t):
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("checked_at"))
    out = t.customer.select("c_custkey").join(seen, "c_custkey", "left")
    return out.orderBy(F.asc_nulls_first("checked_at"), "c_custkey").limit(200)


_FAIR = """
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS round, first_value(o_orderdate) OVER w AS first_at, first_value(o_orderkey) OVER w AS first_id
               FROM orders WHERE o_orderstatus = 'O' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(_FAIR + " SELECT o_orderkey, o_custkey, round, first_at, first_id FROM r")
def fair_queue(t):
    backlog = t.orders.filter("o_orderstatus = 'O'")
    return S.fair_order(backlog, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "round", "first_at", "first_id")


@query(_FAIR + " SELECT o_orderkey, o_custkey FROM r ORDER BY round, first_at, first_id LIMIT 50")
def fair_claim(t):
    backlog = t.orders.filter("o_orderstatus = 'O'")
    return S.claim(backlog, "o_custkey", "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_custkey")


@query("""
    SELECT o_orderkey, coalesce(max(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                max(o_orderkey % 97) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
    FROM orders""")
def turn_inheritance(t):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 97).alias("mark"))
    own = F.max("mark").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    out = running(rows, ["o_orderkey"], "mark", F.max, "overall")
    return out.select("o_orderkey", F.coalesce(own, "overall", F.lit(0)).alias("turn"))


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
          AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def retention_anti(t):
    jobs = t.orders.filter("o_orderstatus = 'P'")
    return S.orphans(t.customer.select("c_custkey"), "c_custkey", (jobs, "o_custkey"), (t.events, "user_id"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_refs(t):
    return S.referenced(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_orderstatus = 'F'"), "o_custkey")


@query("""
    SELECT c_custkey, event_id, event_type FROM customer, LATERAL (SELECT event_id, event_type FROM events WHERE user_id = c_custkey ORDER BY ts, event_id LIMIT 1) e""")
def lateral_first_event(t):
    first = S.first_per(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")
    out = t.customer.select("c_custkey").join(first, F.col("c_custkey") == F.col("user_id"))
    return out.select("c_custkey", "event_id", "event_type")


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-06-17' - INTERVAL 30 DAY""")
def retention_delete_set(t):
    old = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.expr("TIMESTAMP '1995-06-17' - INTERVAL 30 DAY")))
    return t.lineitem.join(old.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (1, 5, 9, 77, 1200)")
def any_array_lookup(t):
    wanted = [1, 5, 9, 77, 1200]
    return t.lineitem.filter(F.col("l_orderkey").isin(wanted)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT event_id, user_id, value FROM events""")
def exactly_once_ledger(t):
    rows = t.events.select("event_id", "user_id", "value")
    return S.once(rows.unionByName(rows.filter("event_id % 3 = 0")), "event_id")


@query("SELECT event_id, user_id FROM events")
def ledger_append_once(t):
    rows = t.events.select("event_id", "user_id")
    return S.append_once(rows.filter("event_id % 2 = 0"), rows.unionByName(rows.filter("event_id % 5 = 0")), "event_id")


@query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(DISTINCT json_extract_string(props, '$.k')) AS kinds
          FROM events GROUP BY 1""")
def json_props(t):
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.sum(k.cast("long")).alias("total"), F.count_distinct(k).alias("kinds"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"queue_id":' || user_id || '}' AS data FROM events""")
def json_merge(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("queue_id"))).alias("data"))


@query("""SELECT o_orderkey, (ord - 1)::BIGINT AS position, word FROM orders, unnest(string_split(o_orderpriority, '-')) WITH ORDINALITY AS u(word, ord)""")
def unnest_ordinality(t):
    out = t.orders.select("o_orderkey", F.posexplode(F.split("o_orderpriority", "-")).alias("position", "word"))
    return out.withColumn("position", F.col("position").cast("long"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' LIMIT 100)")
def bounded_count(t):
    return t.orders.filter("o_orderstatus = 'P'").select(F.lit(1)).limit(100).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderpriority AS pack FROM orders WHERE o_orderstatus = 'O'")
def distinct_packs(t):
    return t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("pack")).distinct()


@query("""
    SELECT c_custkey, max_jobs, max_mb FROM customer JOIN (VALUES ('BUILDING', 100, 500), ('MACHINERY', 25, 250), ('HOUSEHOLD', 5, 50)) p(seg, max_jobs, max_mb) ON c_mktsegment = seg""")
def plan_lookup(t):
    plans = t.spark.createDataFrame([("BUILDING", 100, 500), ("MACHINERY", 25, 250), ("HOUSEHOLD", 5, 50)], "c_mktsegment string, max_jobs int, max_mb int")
    return t.customer.join(F.broadcast(plans), "c_mktsegment").select("c_custkey", "max_jobs", "max_mb")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def guarded_update(t):
    early = F.col("o_orderdate") < F.expr("TIMESTAMP '1996-01-01'")
    status = F.when(early, S.guarded(F.col("o_orderstatus"), "X", ["O", "P"])).otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", status.alias("status"))


@query("""
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
       AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)
       AND coalesce(c_acctbal, 0) < 5000 ORDER BY c_custkey LIMIT 100""")
def unused_client_cleanup(t):
    rows = t.customer.filter(F.coalesce("c_acctbal", F.lit(0.0)) < 5000).select("c_custkey")
    jobs = t.orders.filter("o_orderstatus = 'P'")
    out = S.orphans(rows, "c_custkey", (jobs, "o_custkey"), (t.events, "user_id"), (t.supplier, "s_suppkey"))
    return out.orderBy("c_custkey").limit(100)


@query("""SELECT o_orderpriority AS pack, count(*) AS depth, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def queue_metrics(t):
    out = t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("pack"))
    return out.agg(F.count("*").alias("depth"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 5 THEN l_linenumber * 30 END::BIGINT AS delay_s FROM lineitem""")
def retry_backoff(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.backoff(F.col("l_linenumber"), 30, 5).alias("delay_s"))


@query("""SELECT event_id, date_trunc('minute', ts) AS bucket, ceil(60 - (epoch_us(ts) - epoch_us(date_trunc('minute', ts))) / 1000000)::BIGINT AS remaining FROM events""")
def minute_bucket(t):
    bucket = F.date_trunc("minute", "ts")
    remaining = F.ceil(F.lit(60) - (S.micros("ts") - S.micros(bucket)) / 1_000_000)
    return t.events.select("event_id", bucket.alias("bucket"), remaining.cast("long").alias("remaining"))


@query("""
    WITH c AS (SELECT user_id, sum(value) AS v FROM events GROUP BY 1)
    SELECT coalesce(s_suppkey, user_id) AS s_suppkey, round(CASE WHEN user_id IS NOT NULL THEN v ELSE s_acctbal END, 4) AS s_acctbal
    FROM supplier FULL OUTER JOIN c ON s_suppkey = user_id""")
def upsert_balances(t):
    changes = t.events.groupBy(F.col("user_id").alias("s_suppkey")).agg(F.sum("value").alias("s_acctbal"))
    out = S.upsert(t.supplier.select("s_suppkey", "s_acctbal"), changes, "s_suppkey", ["s_acctbal"])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 4))


@query("""
    SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (user_id, event_type)""")
def usage_rollup(t):
    return t.events.rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pages_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""
    SELECT event_type, w AS window_start, count(*) AS n FROM events, LATERAL (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS w) x
    GROUP BY ALL""")
def sliding_windows(t):
    return t.events.groupBy("event_type", F.window("ts", "1 day", "6 hours").start.alias("window_start")).agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT before AS from_state, event_type AS to_state, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL""")
def state_transitions(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = t.events.withColumn("from_state", before).filter("from_state IS NOT NULL")
    return out.groupBy("from_state", F.col("event_type").alias("to_state")).agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, user_id, event_type, ts FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id AND x.ts <= TIMESTAMP '2024-01-20 00:00:00')""")
def latest_state(t):
    seen = t.events.filter(F.col("ts") <= as_of())
    last = seen.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return t.events.join(last, ["user_id", "ts"]).select("event_id", "user_id", "event_type", "ts")
