"""Streaming forms of the service queries: event time, watermarks and state in place of clocks and tables.

Each function takes a streaming (or static) frame and returns one; `drained` runs what has arrived through and returns it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.scratch import scratch_path


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder, or one file, as a stream with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may also match a single file, which a plain path may not name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def rate_windows(events: DataFrame, bucket: str, ts: str, window: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests of each bucket and fixed window and how many exceed the limit; windows that are older than `late` are dropped."""
    counted = events.withWatermark(ts, late).groupBy(bucket, F.window(ts, window).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(bucket, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).cast("long").alias("denied"))


def sessions(events: DataFrame, subject: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Leases renewed within the gap."""
    found = events.withWatermark(ts, late).groupBy(subject, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("renewals"))
    return found.select(subject, F.col("s.start").alias("first_seen"), "renewals")


def trailing_windows(events: DataFrame, subject: str, ts: str, amount: str, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    used = events.withWatermark(ts, late).groupBy(subject, F.window(ts, length, slide).alias("w"))
    return used.agg(F.count("*").alias("uses"), F.sum(amount).alias("amount")).select(subject, F.col("w.start").alias("window_start"), "uses", "amount")


def once(events: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """Exactly-once metering: a key that comes again within `late` is ignored."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


# The states of a job and what they may become.
TRANSITIONS = {
    "queued": ("running", "canceled", "expired"), "running": ("succeeded", "failed", "canceled", "queued"),
    "succeeded": ("expired",), "failed": ("queued", "expired"), "canceled": ("expired",), "expired": (),
}


def job_states(events: DataFrame, job: str, kind: str, ts: str, max_attempts: int = 3, backoff_s: int = 30) -> DataFrame:
    """Each job's state after its events: transitions that are not allowed are counted and ignored, retries end after
    max_attempts, and the delay before the next one grows with their number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, refused = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(frames)).sort_values("ts")
        for target in rows["kind"]:
            if target not in TRANSITIONS[status] or (status == "failed" and target == "queued" and attempts >= max_attempts):
                refused += 1
                continue
            attempts += target == "running"
            status = target
        state.update((status, int(attempts), int(refused)))
        delay = backoff_s * attempts if status == "failed" and attempts < max_attempts else None
        yield pd.DataFrame({"job": [key[0]], "status": [status], "attempts": [attempts], "refused": [refused], "delay_s": [delay]})

    slim = events.select(F.col(job).cast("string").alias("job"), F.col(kind).alias("kind"), F.col(ts).cast("timestamp").alias("ts"))
    out = "job string, status string, attempts int, refused int, delay_s double"
    return slim.groupBy("job").applyInPandasWithState(step, out, "status string, attempts int, refused int", "update", GroupStateTimeout.NoTimeout)


def settled(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) that two listings show alike; hidden ones are left out."""
    keys = ["path", "length", "modificationTime"]
    return files.join(before.select(*keys), keys).filter(~F.col("path").rlike(r"/\.[^/]*$"))


def converted(batch: Callable[[DataFrame], DataFrame], good: str, bad: str):
    """A foreachBatch function that splits a batch by its error column into results and dead letters."""

    def run(df: DataFrame, number: int) -> None:
        out = batch(df).persist()
        try:
            out.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{good}/batch={number}")
            out.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            out.unpersist()

    return run


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what has arrived. Complete and update results are kept in the last rows of each batch's table."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    kept = "batch" if mode != "append" else None

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).option("basePath", f"{path}/out").parquet(f"{path}/out")
    if kept and mode == "complete":
        last = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").agg(F.max("batch")).first()[0]
        return spark.read.schema(stream.schema).parquet(f"{path}/out/batch={last}")
    return out.select(*stream.columns)
