"""Conversion routes over a table of edges: costs, best routes, alternatives and reachability.

Paths grow one step at a time by a join with the edges; a step costs at least STEP, so routes of more than `steps` steps can't be
among the best of the small graphs that converters form. Every comparison has a full order: cost, steps, then the path itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of fidelity, editability and time by profile, the price of a step and of an unmeasured edge.
PROFILES = {"editable": (0.30, 0.60, 0.10), "faithful": (0.70, 0.20, 0.10), "fast": (0.15, 0.15, 0.70), "private": (0.30, 0.60, 0.10)}
STEP, UNMEASURED, SLOWEST_MS = 0.05, 1.55, 5000.0

EDGE_SCHEMA = "from_id string, to_id string, engine string, runtime array<string>, fidelity double, editability double, p50_ms double"


def duration(p50: Column) -> Column:
    """Milliseconds as a share of the slowest that counts; 0 where there is no sensible number."""
    return F.when(p50.isNull() | F.isnan(p50) | (p50 <= 0), 0.0).otherwise(F.least(p50 / SLOWEST_MS, F.lit(1.0)))


def edge_cost(profile: str) -> Column:
    f, e, t = PROFILES[profile]
    cost = f * (1 - F.col("fidelity")) + e * (1 - F.col("editability")) + t * duration(F.col("p50_ms")) + STEP
    return F.when(F.col("fidelity").isNull() | F.col("editability").isNull(), UNMEASURED).otherwise(cost)


def runnable(edges: DataFrame, runtime: str, profile: str) -> DataFrame:
    """Edges of a runtime; the private profile leaves out what only the cloud runs."""
    out = edges.filter(F.array_contains("runtime", runtime))
    return out.filter(F.col("runtime") != F.array(F.lit("cloud"))) if profile == "private" else out


def routes(edges: DataFrame, profile: str, steps: int = 4) -> DataFrame:
    """All simple routes of up to `steps` steps: from_id, to_id, cost, steps, path, engines."""
    priced = edges.select("from_id", "to_id", "engine", edge_cost(profile).alias("cost"))
    last = priced.select("from_id", "to_id", F.array("from_id", "to_id").alias("path"), F.array("engine").alias("engines"), "cost")
    out = last
    step = priced.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "engine", F.col("cost").alias("more"))
    for _ in range(steps - 1):
        last = last.join(F.broadcast(step), (F.col("to_id") == F.col("at")) & ~F.array_contains("path", F.col("next")))
        last = last.select(
            "from_id", F.col("next").alias("to_id"), F.concat("path", F.array("next")).alias("path"), F.concat("engines", F.array("engine")).alias("engines"), (F.col("cost") + F.col("more")).alias("cost")
        )
        out = out.unionByName(last)
    return out.withColumn("steps", F.size("engines")).withColumn("cost", F.round("cost", 9))


def ranked(found: DataFrame, keep: int) -> DataFrame:
    """The best routes of every pair of formats."""
    order = Window.partitionBy("from_id", "to_id").orderBy("cost", "steps", F.array_join("engines", ">"), F.array_join("path", ">"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def reachable(edges: DataFrame, steps: int = 4) -> DataFrame:
    """(from_id, to_id) of all targets, a format itself left out."""
    step = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")).distinct()
    out = last = edges.select("from_id", "to_id").distinct()
    for _ in range(steps - 1):
        last = last.join(F.broadcast(step), F.col("to_id") == F.col("at")).select("from_id", F.col("next").alias("to_id")).distinct()
        out = out.unionByName(last)
    return out.filter("from_id <> to_id").distinct()


def path_scores(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Products of fidelity and editability and the sum of times along routes; null where an edge is unmeasured."""
    legs = found.select("path", "engines", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"), F.col("engines").alias("e"))).alias("leg"))
    known = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("engine").alias("e"), "fidelity", "editability", "p50_ms")
    legs = legs.select("path", "engines", "leg.*").join(F.broadcast(known), ["a", "b", "e"], "left")
    whole = F.bool_and(F.col("fidelity").isNotNull() & F.col("editability").isNotNull())
    out = legs.groupBy("path", "engines").agg(
        F.when(whole, F.round(F.product("fidelity"), 6)).alias("fidelity"), F.when(whole, F.round(F.product("editability"), 6)).alias("editability"), F.when(whole, F.sum("p50_ms")).alias("p50_ms")
    )
    return out


def engines(edges: DataFrame) -> DataFrame:
    """Per engine: its edges, those that are measured and those that run locally, and numbers of formats."""
    return edges.groupBy("engine").agg(
        F.count("*").alias("edges"), F.count("fidelity").alias("measured"), F.count_if(F.array_contains("runtime", "local")).alias("local"),
        F.count_distinct("from_id").alias("inputs"), F.count_distinct("to_id").alias("outputs"),
    )


def coverage(edges: DataFrame, best: DataFrame) -> DataFrame:
    """Per format: numbers of targets and the steps of the longest best route; null steps where nothing is reached."""
    formats = edges.select(F.col("from_id").alias("format")).unionByName(edges.select(F.col("to_id").alias("format"))).distinct()
    found = best.filter("from_id <> to_id").groupBy(F.col("from_id").alias("format")).agg(F.count("*").alias("targets"), F.max("steps").alias("steps"))
    return formats.join(found, "format", "left").fillna(0, ["targets"])
