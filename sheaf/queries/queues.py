"""Queries over claims, visibility, notices, ordered results and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.plans import registry as G
from sheaf.queries.registry import query
from sheaf.streaming import queue as S

_NOW = "TIMESTAMP '2024-01-02 00:00:00'"


@query("""
    WITH l AS (SELECT DISTINCT user_id AS path, 0 AS source FROM events WHERE event_type = 'error'), s AS (SELECT DISTINCT user_id AS path, 1 AS source FROM events),
    d AS (SELECT DISTINCT user_id AS path FROM events WHERE value > 480)
    SELECT path, min(source) = 0 AS recovered FROM (SELECT * FROM l UNION ALL SELECT * FROM s) WHERE path NOT IN (SELECT path FROM d) GROUP BY 1""")
def claim_recover(t):
    files = t.events.select(F.col("user_id").alias("path"), "event_type", "value")
    done = files.filter("value > 480").select("path").distinct()
    return S.claimable(files.filter("event_type = 'error'").select("path").distinct(), files.select("path").distinct(), "path", done)


def _messages(t):
    held = F.when(F.col("event_id") % 3 > 0, F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 3600))
    return t.events.select("event_id", held.alias("visible_at"), (F.col("event_id") % 4).cast("long").alias("read_ct"))


@query(f"""
    WITH m AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN date_trunc('second', ts) + INTERVAL 1 HOUR END AS visible_at, event_id % 4 AS read_ct FROM events)
    SELECT event_id, epoch({_NOW})::BIGINT + 30 AS hidden_until, read_ct + 1 AS read_ct FROM m WHERE visible_at IS NULL OR visible_at <= {_NOW}""")
def visibility_timeout(t):
    out = S.read(_messages(t), F.expr(_NOW), 30)
    return out.select("event_id", F.unix_seconds("visible_at").alias("hidden_until"), "read_ct")


@query("""
    WITH m AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN date_trunc('second', ts) + INTERVAL 1 HOUR END AS visible_at, date_trunc('second', ts) + INTERVAL 1 MINUTE * (event_id % 100) AS beat FROM events)
    SELECT event_id, epoch(CASE WHEN event_id % 2 = 0 AND beat < visible_at THEN greatest(visible_at, beat + INTERVAL 30 MINUTE) ELSE visible_at END)::BIGINT AS hidden_until FROM m WHERE visible_at IS NOT NULL""")
def heartbeats(t):
    beat = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 100 * 60)
    beats = t.events.filter("event_id % 2 = 0").select("event_id", beat.alias("at"))
    out = S.extended(_messages(t), beats, "event_id", 1800).filter("visible_at is not null")
    return out.select("event_id", F.unix_seconds("visible_at").alias("hidden_until"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS batch, event_type AS channel, user_id AS payload, min(event_id) AS ord FROM events GROUP BY ALL""")
def notices(t):
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd HH").alias("batch"), F.col("event_type").alias("channel"), F.col("user_id").alias("payload"), F.col("event_id").alias("ord"))
    return S.notices(rows, "channel", "payload", "batch")


@query("""
    WITH r AS (SELECT user_id AS job, event_id AS page, value, CASE WHEN value < 5 THEN 'page ' || event_id END AS error FROM events),
    f AS (SELECT job, min(page) AS stop FROM r WHERE error IS NOT NULL GROUP BY 1)
    SELECT r.job, count(*) AS results, max(error) AS error FROM r LEFT JOIN f ON r.job = f.job WHERE stop IS NULL OR page <= stop GROUP BY 1""")
def ordered_results(t):
    error = F.when(F.col("value") < 5, F.concat(F.lit("page "), F.col("event_id").cast("string")))
    rows = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("page"), error.alias("error"))
    return S.in_order(rows, "job", "page").groupBy("job").agg(F.count("*").alias("results"), F.max("error").alias("error"))


@query("""SELECT user_id, event_id, event_type AS event, 'v ' || event_id || e'\\n' || props AS data, (event_id % 9)::BIGINT AS retry FROM events""")
def event_stream_messages(t):
    one = F.concat(
        F.lit(": keep\r\nid:"), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\nretry: "), (F.col("event_id") % 9).cast("string"),
        F.lit("\ndata:v "), F.col("event_id").cast("string"), F.lit("\ndata: "), "props", F.lit("\r\r\n"),
    )
    streams = t.events.groupBy("user_id").agg(F.array_join(F.collect_list(one), "id: 1\n\n").alias("body"))
    found = streams.select("user_id", F.inline(S.messages_of(F.col("body"))))
    return found.select("user_id", F.col("id").cast("long").alias("event_id"), "event", "data", "retry")


@query(f"SELECT * FROM (VALUES {', '.join(str((x.id, x.group, x.least, x.most, x.tier)) for x in G.TOOLS)}) AS v(id, \"group\", least, most, tier)")
def tool_registry(t):
    return G.table(t.spark).select("id", "group", F.col("least").cast("int").alias("least"), F.col("most").cast("int").alias("most"), "tier")


@query(f"SELECT \"group\", count(*) AS tools, count(*) FILTER (tier = 'free') AS free FROM (VALUES {', '.join(str((x.id, x.group, x.tier)) for x in G.TOOLS)}) AS v(id, \"group\", tier) GROUP BY 1")
def registry_report(t):
    return G.table(t.spark).groupBy("group").agg(F.count("*").alias("tools"), F.count_if(F.col("tier") == "free").alias("free"))
