import random

from pyspark.sql import functions as F

from sheaf.operators import service as S
from sheaf.plans import routes as R
from sheaf.streaming import service as T


def test_fair_queue_against_a_simulation(spark):
    rng = random.Random(7)
    queue = [(i, f"s{rng.randrange(6)}", rng.randrange(50)) for i in range(120)]
    got = [r.m for r in S.claim(spark.createDataFrame(queue, "m long, s string, at long"), "s", "at", "m", 120).collect()]
    turns, waiting, want = {}, sorted(queue, key=lambda q: (q[2], q[0])), []
    while waiting:
        m = min(waiting, key=lambda q: (turns.get(q[1], 0), next((x[2], x[0]) for x in sorted(queue, key=lambda y: (y[2], y[0])) if x[1] == q[1]), q[2], q[0]))
        turns[m[1]] = turns.get(m[1], 0) + 1
        waiting.remove(m)
        want.append(m[0])
    assert got == want


def test_trailing_edge_is_excluded(spark):
    df = spark.createDataFrame([(1, 0), (1, 86_400), (1, 86_401)], "u long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("v", F.lit(1.0))
    assert [r.uses for r in S.trailing_usage(df, "u", "ts", "v").orderBy("s").collect()] == [1, 1, 2]


def test_ledger_and_upsert(spark):
    ledger = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    more = spark.createDataFrame([(2, 9.0), (3, 3.0), (3, 3.0)], "k long, v double")
    assert sorted((r.k, r.v) for r in S.append_once(ledger, more, "k").collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    changed = S.upsert(ledger, more.dropDuplicates(["k"]), "k", ["v"])
    assert sorted((r.k, r.v) for r in changed.collect()) == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_unmeasured_edges_and_ties(spark):
    edges = [("a", "b", "e2", ["local"], 1.0, 1.0, 0.0), ("a", "b", "e1", ["local"], 1.0, 1.0, 0.0), ("b", "c", "e1", ["cloud"], None, None, None), ("a", "c", "e9", ["local"], 0.0, 0.0, 9e9)]
    df = spark.createDataFrame(edges, R.EDGE_SCHEMA)
    best = {(r.from_id, r.to_id): r for r in R.ranked(R.routes(df, "faithful"), 1).collect()}
    assert best["a", "b"].engines == ["e1"] and abs(best["a", "b"].cost - 0.05) < 1e-9
    assert best["a", "c"].engines == ["e9"] and abs(best["b", "c"].cost - 1.55) < 1e-9
    assert R.runnable(df, "cloud", "private").count() == 0


def test_job_states(spark, tmp_path):
    rows = [("j", "running", 1), ("j", "failed", 2), ("j", "queued", 3), ("j", "succeeded", 4), ("j", "running", 5), ("j", "succeeded", 6), ("j", "running", 7), ("k", "canceled", 1)]
    df = spark.createDataFrame(rows, "job string, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = T.drained(T.job_states(T.arriving(spark, f"{tmp_path}/in"), "job", "kind", "ts"), "update")
    assert {r.job: (r.status, r.attempts, r.refused) for r in out.collect()} == {"j": ("succeeded", 2, 2), "k": ("canceled", 0, 0)}


def test_dead_letters(spark, tmp_path):
    run = T.converted(lambda df: df.withColumn("error", F.when(F.col("x") < 0, "negative")), f"{tmp_path}/good", f"{tmp_path}/bad")
    run(spark.createDataFrame([(1,), (-1,)], "x int"), 0)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 1 and spark.read.parquet(f"{tmp_path}/bad").first().error == "negative"


def test_settled_files(spark):
    before = spark.createDataFrame([("/a", 1, 5), ("/b", 1, 5), ("/.c", 1, 5)], "path string, length long, modificationTime long")
    now = spark.createDataFrame([("/a", 1, 5), ("/b", 2, 6), ("/.c", 1, 5), ("/d", 1, 1)], "path string, length long, modificationTime long")
    assert [r.path for r in T.settled(now, before).collect()] == ["/a"]
