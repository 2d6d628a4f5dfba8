"""Streaming queries: the event table read as a stream, run until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.queries.registry import ORACLE_SQL, query
from sheaf.streaming import service as S


def _events(t):
    stream = S.arriving(t.spark, f"{t.folder}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLE_SQL["rate_limit_windows"])
def stream_rate_windows(t):
    return S.drained(S.rate_windows(_events(t), "user_id", "ts", "1 hour", 1), "complete")


@query("SELECT user_id, first_seen, renewals FROM (" + ORACLE_SQL["lease_sessions"] + ")")
def stream_sessions(t):
    return S.drained(S.sessions(_events(t), "user_id", "ts", "12 hours"), "complete")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS kinds FROM events")
def stream_once(t):
    twice = _events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = S.drained(S.once(twice, "event_id", "ts").select("event_id"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("kinds"))


@query()
def stream_job_states(t):
    names = ["running", "succeeded", "failed", "queued", "canceled"]
    kinds = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    return S.drained(S.job_states(_events(t).withColumn("kind", kinds), "user_id", "kind", "ts"), "update")
