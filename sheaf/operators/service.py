"""The operational queries of a metered service over DataFrames: quotas, rate limits, queues, paging and retention.

Every function takes frames and column names and returns a lazy frame; clocks are parameters, never the time of the run.
Aggregations have partial sums before their shuffle, and top-n reads keep n rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators.prefix import ranked

DAY = 86_400


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def trailing(df: DataFrame, ts: str, as_of: Column, interval: str) -> DataFrame:
    """Rows of the interval before as_of; the early edge itself is outside."""
    return df.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= as_of))


def usage(ledger: DataFrame, subject: str, amount: str, ts: str, as_of: Column, interval: str = "1 DAY") -> DataFrame:
    """Number of uses and total amount of each subject in the trailing interval."""
    recent = trailing(ledger, ts, as_of, interval)
    return recent.groupBy(subject).agg(F.count("*").alias("uses"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"))


def with_quota(subjects: DataFrame, used: DataFrame, key: str, max_uses: int, max_amount: float) -> DataFrame:
    """All subjects with their usage, zero where there is none, and whether one more use is allowed."""
    out = subjects.join(used, key, "left").fillna({"uses": 0, "amount": 0.0})
    return out.withColumn("allowed", (F.col("uses") < max_uses) & (F.col("amount") < max_amount))


def rate_windows(df: DataFrame, bucket: str, ts: str, window: str, limit: int) -> DataFrame:
    """Requests of each bucket and fixed window, and how many of them exceed the limit."""
    out = df.groupBy(bucket, F.window(ts, window).start.alias("window_start")).agg(F.count("*").alias("requests"))
    return out.withColumn("denied", F.greatest(F.col("requests") - limit, F.lit(0)).cast("long"))


def admissions(df: DataFrame, bucket: str, ts: str, order: str, unit: str, seconds: int, limit: int) -> DataFrame:
    """Per request: admitted while its window has room, else after how many seconds to retry."""
    start = F.date_trunc(unit, F.col(ts))
    place = F.row_number().over(Window.partitionBy(bucket, start).orderBy(ts, order))
    left = F.lit(seconds) - (micros(ts) - micros(start)) / 1_000_000
    out = df.withColumn("admitted", place <= limit)
    return out.withColumn("retry_after", F.when(~F.col("admitted"), F.greatest(F.ceil(left), F.lit(1))).cast("long"))


def trailing_usage(df: DataFrame, subject: str, ts: str, amount: str, seconds: int = DAY) -> DataFrame:
    """Per event: uses and amount of its subject in the trailing interval, the event included, the early edge excluded."""
    w = Window.partitionBy(subject).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("uses", F.count("*").over(w)).withColumn("amount", F.round(F.sum(amount).over(w), 6))


def sessions(df: DataFrame, subject: str, ts: str, gap: str) -> DataFrame:
    """Leases that were renewed within the gap, as one row each."""
    out = df.groupBy(subject, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("renewals"), F.max(ts).alias("last_seen"))
    return out.select(subject, F.col("s.start").alias("first_seen"), "last_seen", "renewals")


def keyset_page(df: DataFrame, keys: list[str], cursor: list[Column] | None, size: int) -> DataFrame:
    """The page behind the cursor, newest first."""
    if cursor:
        df = df.filter(F.struct(*keys) < F.struct(*[c.alias(k) for c, k in zip(cursor, keys, strict=True)]))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(size)


def cursor_text(*columns: str) -> Column:
    """An opaque cursor."""
    return F.base64(F.to_json(F.struct(*columns)).cast("binary"))


def fair_order(queue: DataFrame, subject: str, enqueued: str, message: str) -> DataFrame:
    """The order in which subjects that take turns get their messages through; oldest message first within a subject.

    A subject's turn comes round once in each round, in the order of the subjects' first messages. Places within a subject come from
    ranks over range partitions, so that a subject with a large part of the backlog is not one task.
    """
    keys = [subject, enqueued, message]
    placed = ranked(queue, keys, "__place")
    firsts = placed.groupBy(subject).agg(F.min("__place").alias("__first"), F.min(F.struct(enqueued, message)).alias("__least"))
    out = placed.join(firsts, subject)
    out = out.withColumn("round", F.col("__place") - F.col("__first") + 1).withColumn("first_at", F.col(f"__least.{enqueued}"))
    return out.withColumn("first_id", F.col(f"__least.{message}")).drop("__place", "__first", "__least")


def claim(queue: DataFrame, subject: str, enqueued: str, message: str, size: int) -> DataFrame:
    """The next messages in fair order."""
    return fair_order(queue, subject, enqueued, message).orderBy("round", "first_at", "first_id").limit(size)


def orphans(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parents to which no child table refers."""
    for child, ref in children:
        parents = parents.join(child.select(F.col(ref).alias("__ref")), F.col(key) == F.col("__ref"), "left_anti")
    return parents


def referenced(parents: DataFrame, key: str, child: DataFrame, ref: str) -> DataFrame:
    return parents.join(child.select(F.col(ref).alias("__ref")), F.col(key) == F.col("__ref"), "left_semi")


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key: a lateral top-1 without a sort of the whole group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(key, "first.*")


def once(ledger: DataFrame, *keys: str) -> DataFrame:
    """Exactly-once metering: one row of each event key."""
    return ledger.dropDuplicates(list(keys))


def append_once(ledger: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """The ledger after an insert that ignores keys it holds already."""
    return ledger.unionByName(arriving.dropDuplicates([key]).join(ledger.select(key), key, "left_anti"))


def filtered_counts(df: DataFrame, key: str, kind: str, kinds: list[str], amount: str) -> DataFrame:
    """count and sum with a filter for each kind, in one pass."""
    columns = []
    for k in kinds:
        mine = F.col(kind) == k
        columns += [F.count_if(mine).alias(f"n_{k}"), F.round(F.coalesce(F.sum(F.when(mine, F.col(amount))), F.lit(0.0)), 4).alias(f"sum_{k}")]
    return df.groupBy(key).agg(*columns)


def guarded(current: Column, target: str, allowed: list[str]) -> Column:
    """A state after a guarded transition: the target if the current state allows it."""
    return F.when(current.isin(allowed), F.lit(target)).otherwise(current)


def backoff(attempts: Column, base_seconds: int, max_attempts: int) -> Column:
    """Seconds until the next attempt, null after the last one."""
    return F.when(attempts < max_attempts, attempts * base_seconds).cast("long")


def upsert(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The target after changes: rows of known keys are updated, others inserted."""
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__changed"))
    both = target.join(renamed, key, "full_outer")
    return both.select(key, *[F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])
