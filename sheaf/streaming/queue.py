"""Queue semantics over tables and streams: claims, visibility, notices, ordered results and event streams as text."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def claimable(left_over: DataFrame, settled: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """What a round takes: claims that an interrupted round left come first, then settled files; what the ledger knows is left out.
    A file that is both is taken once, as a claim."""
    rows = left_over.withColumn("source", F.lit(0)).unionByName(settled.withColumn("source", F.lit(1)))
    rows = rows.groupBy(key).agg(F.min("source").alias("source"))
    return rows.join(done.select(key), key, "left_anti").withColumn("recovered", F.col("source") == 0).drop("source")


def visible(messages: DataFrame, now: Column) -> DataFrame:
    """Messages that no reader holds: the time until which one does is over."""
    return messages.filter(F.col("visible_at").isNull() | (F.col("visible_at") <= now))


def read(messages: DataFrame, now: Column, hold_s: int) -> DataFrame:
    """The visible messages after a reader has taken them: hidden for hold_s seconds, one more read."""
    until = F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + hold_s)
    return visible(messages, now).withColumn("visible_at", until).withColumn("read_ct", F.col("read_ct") + 1)


def extended(messages: DataFrame, beats: DataFrame, key: str, hold_s: int) -> DataFrame:
    """Messages after heartbeats (key, at): one that came while a message was held hides it from then on for hold_s seconds."""
    last = beats.groupBy(key).agg(F.max("at").alias("at"))
    out = messages.join(last, key, "left")
    later = F.timestamp_seconds(F.unix_micros("at") / 1_000_000 + hold_s)
    held = F.col("at") < F.col("visible_at")
    return out.withColumn("visible_at", F.when(held, F.greatest("visible_at", later)).otherwise(F.col("visible_at"))).drop("at")


def notices(events: DataFrame, channel: str, payload: str, batch: str) -> DataFrame:
    """What listeners get: of equal notices of one batch one, in the order of their first."""
    return events.groupBy(batch, channel, payload).agg(F.min("ord").alias("ord"))


def in_order(results: DataFrame, job: str, index: str) -> DataFrame:
    """Results of parallel work in order, up to the first error of each job, and that error: (job, index, value, error)."""
    before = F.coalesce(F.max(F.col("error").isNotNull()).over(Window.partitionBy(job).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return results.withColumn("__over", before).filter(~F.col("__over")).drop("__over")


_MESSAGE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("event", "data", "id")] + [T.StructField("retry", T.LongType())]))


def parse_events(text: str) -> list[dict]:
    """Messages of an event stream: a blank line sends what has data; comments are skipped, identifiers last."""
    out: list[dict] = []
    data: list[str] = []
    event, last, retry = "", None, None
    for line in re.split("\r\n|\r|\n", text)[:-1]:  # a line without an end is not complete
        if not line:
            if data:
                out.append({"event": event or "message", "data": "\n".join(data), "id": last, "retry": retry})
            data, event, retry = [], "", None
            continue
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "event":
            event = value
        elif name == "id" and "\0" not in value:
            last = value
        elif name == "retry" and re.fullmatch("[0-9]+", value):
            retry = int(value)
    return out


@F.pandas_udf(_MESSAGE)
def messages_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [] if x is None else parse_events(x))


def chunked_digest(size: int = 1 << 16):
    """SHA-256 of a text's bytes, worked through in chunks of `size`."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            raw, found = memoryview(x.encode()), hashlib.sha256()
            for i in range(0, len(raw), size):
                found.update(raw[i : i + size])
            return found.hexdigest()

        return text.map(one)

    return digest
