"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed up to cells of (source, language, topic) with their numbers of tokens, by partial aggregation, so that
a source with a third of all rows is a few rows before the shuffle. Target weights are given per dimension; a dimension without
any keeps its tempered marginals. Raking scales the cells' weights to one marginal after the other, in rounds of SWEEPS sweeps until
every marginal is within TOLERANCE of its target. Targets that can't be met together, as their cells are empty, end with the
round that no longer halves the error, or with the last of ROUNDS, and a warning that names the error left. The fitted weights are
calibrated to a budget of tokens: a cell's documents are kept with the probability budgeted / present tokens, at most 1, and
what full cells leave over goes to the others. A document's draw is a hash of its identifier, so it is the same in
every run and does not depend on how rows are dealt out.

Up to SINGLE_CELLS cells the fit runs as one task without any shuffle, and the cells are broadcast to the documents; beyond that,
every scaling is an aggregation and a join over a written table, and the documents join the cells by their key.

Defined results. Null sources and languages are categories of their own. Null and empty texts have the topic `empty` and no
tokens; a cell without tokens is kept whole. A null identifier draws like the empty string; repeated rows draw alike. An
empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.common import ROW, packed, unpacked, written

#: Exponent of a marginal's shares in its targets: 1 leaves them as they are, 0 makes them equal.
TEMPER = 0.7
#: Share of all tokens that the sample has in expectation.
BUDGET = 0.8
SWEEPS, SPILLS = 20, 6
#: Largest relative error of a marginal, and rounds of sweeps at most.
TOLERANCE, ROUNDS = 1e-6, 5
SINGLE_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
#: Characters of markup and noise, by which topics are told apart.
NOISE = "%&$*#!~^"


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _without(text: Column, marks: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def token_count(text: Column) -> Column:
    """Words between white space, without regular expressions."""
    text = F.coalesce(text, F.lit(""))
    for mark in "\t\n\v\f\r":
        text = F.replace(text, F.lit(mark), F.lit(" "))
    plain = F.trim(text)
    # no tab or line end is left, so they can mark a space's begin and end; where an end meets a begin, a run goes on
    runs = F.replace(F.replace(plain, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))
    return F.when(plain == "", 0).otherwise(F.length(runs) - F.length(F.replace(runs, F.lit("\t"), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The kind of a text by its form: empty, table, noisy, short or prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    bars = size - F.length(_without(text, "|"))
    noise = size - F.length(_without(text, NOISE))
    return (
        F.when(_blank(text), "empty").when(bars * 20 >= size, "table").when(noise * 20 >= size, "noisy").when(size < 400, "short").otherwise("prose")
    )


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the identifier only."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _by(*names: str):
    return Window.partitionBy(*names) if names else Window.partitionBy()


def _wanted(name: str, own: Column, temper: float, targets: dict[str, dict] | None) -> Column:
    """The target of a category before normalisation: what is given for it, 0 for others of that dimension, or its tempered tokens."""
    if not targets or name not in targets:
        return F.when(own > 0, F.pow(own, F.lit(temper))).otherwise(0.0)
    given = F.lit(0.0)
    for value, weight in targets[name].items():
        given = F.when(F.col(name).eqNullSafe(F.lit(value)), F.lit(float(weight))).otherwise(given)
    return F.when(own > 0, given).otherwise(0.0)


def _start_single(cells: DataFrame, temper: float, targets: dict[str, dict] | None) -> DataFrame:
    fit = cells.coalesce(1).withColumn("w", F.col("tokens").cast("double"))
    for name in DIMENSIONS:
        own = F.sum("tokens").over(_by(name)).cast("double")
        fit = fit.withColumn("own", own).withColumn("own", _wanted(name, F.col("own"), temper, targets))
        # every category counts once in the sum of the targets
        fit = fit.withColumn("cells_of", F.count("*").over(_by(name)))
        fit = fit.withColumn(f"target_{name}", F.col("own") / F.sum(F.col("own") / F.col("cells_of")).over(_by())).drop("own", "cells_of")
    return fit


def _sweep_single(fit: DataFrame, sweeps: int) -> DataFrame:
    """All scalings as window sums over one partition, and the largest relative error that is left."""
    for _ in range(sweeps):
        for name in DIMENSIONS:
            total = F.sum("w").over(_by(name))
            fit = fit.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"target_{name}") / total).otherwise(0.0))
    errors = [F.abs(F.sum("w").over(_by(name)) / F.col(f"target_{name}") - 1) for name in DIMENSIONS]
    return fit.withColumn("off", F.greatest(*[F.when(F.col(f"target_{name}") > 0, e) for name, e in zip(DIMENSIONS, errors, strict=True)]))


def _calibrated_single(fit: DataFrame, budget: float) -> DataFrame:
    fit = fit.withColumn("p", F.lit(0.0)).withColumn("all", F.sum("tokens").over(_by()).cast("double"))
    for _ in range(SPILLS):
        full = F.col("p") >= 1
        rest = budget * F.col("all") - F.coalesce(F.sum(F.when(full, F.col("tokens"))).over(_by()), F.lit(0))
        share = F.sum(F.when(~full, F.col("w"))).over(_by())
        next_p = F.when(full, 1.0).when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("w") * rest / share / F.col("tokens"), F.lit(0.0))))
        fit = fit.withColumn("next_p", next_p).withColumn("p", F.col("next_p")).drop("next_p")
    return fit.select(*DIMENSIONS, "tokens", "w", "p")


def _unmet(errors: list[float | None]) -> bool:
    """Whether another round is due, by the errors after each round; warns where the last one leaves an error."""
    off = errors[-1] or 0.0
    if off <= TOLERANCE:
        return False
    if len(errors) == ROUNDS or len(errors) > 1 and off > errors[-2] / 2:
        warnings.warn(f"mixing: the targets can't be met together; a marginal is off by {off:.2g} of its target", stacklevel=4)
        return False
    return True


def _fit_single(cells: DataFrame, temper: float, budget: float, sweeps: int, targets: dict[str, dict] | None = None) -> DataFrame:
    fit = _start_single(cells, temper, targets)
    errors = []
    while not errors or _unmet(errors):
        fit = written(_sweep_single(fit, sweeps), "mix-fit").coalesce(1)
        errors.append(fit.agg(F.max("off")).first()[0])
    return _calibrated_single(fit, budget)


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, nulls equal to nulls; the right side's are dropped."""
    other = right.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in right.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    return left.join(other, on, how).drop(*[f"__{c}" for c in names])


def _fit_spread(cells: DataFrame, temper: float, budget: float, sweeps: int, targets: dict[str, dict] | None = None) -> DataFrame:
    """The same scalings, each an aggregation and a join over a written table."""
    fit = cells.withColumn("w", F.col("tokens").cast("double"))
    goals = {}
    for name in DIMENSIONS:
        own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("own")).withColumn("own", _wanted(name, F.col("own"), temper, targets))
        total = own.agg(F.sum("own")).first()[0] or 1.0
        goals[name] = written(own.select(name, (F.col("own") / total).alias("target")), "mix-targets")
    errors = []
    while not errors or _unmet(errors):
        for _ in range(sweeps):
            for name in DIMENSIONS:
                totals = _same(fit.groupBy(name).agg(F.sum("w").alias("total")), goals[name], [name])
                fit = _same(fit, totals, [name])
                fit = fit.withColumn("w", F.when(F.col("total") > 0, F.col("w") * F.col("target") / F.col("total")).otherwise(0.0))
                fit = written(fit.drop("total", "target"), "mix-fit")
        off = 0.0
        for name in DIMENSIONS:
            left = _same(fit.groupBy(name).agg(F.sum("w").alias("total")), goals[name], [name]).filter("target > 0")
            off = max(off, left.agg(F.max(F.abs(F.col("total") / F.col("target") - 1))).first()[0] or 0.0)
        errors.append(off)
    everything = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fit = fit.withColumn("p", F.lit(0.0))
    for _ in range(SPILLS):
        full = F.col("p") >= 1
        taken, share = fit.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("w")))).first()
        rest = budget * everything - (taken or 0)
        p = F.when(full | (F.col("tokens") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("w") * rest / (share or 1.0) / F.col("tokens"), F.lit(0.0))))
        fit = written(fit.withColumn("p", p), "mix-fit")
    return fit.select(*DIMENSIONS, "tokens", "w", "p")


def described(docs: DataFrame) -> DataFrame:
    """The input rows as ROW with source, lang, topic and n_tokens."""
    rows = packed(docs)
    text = F.col(f"{ROW}.text")
    return rows.select(
        ROW, F.col(f"{ROW}.source").alias("source"), F.col(f"{ROW}.lang").alias("lang"), topic_of(text).alias("topic"), token_count(text).alias("n_tokens")
    )


def drawn(
    rows: DataFrame, temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, single_cells: int = SINGLE_CELLS,
    targets: dict[str, dict] | None = None,
) -> DataFrame:
    """Described rows with their probability and whether they are kept. targets: for any of source, lang and topic the weights of
    its values; values that are not named get none. A cell without any weight is left out, unless it has no tokens."""
    if set(targets or ()) - set(DIMENSIONS):
        raise ValueError(f"targets are given for {', '.join(DIMENSIONS)}")
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    small = cells.count() <= single_cells
    fit = (_fit_single if small else _fit_spread)(cells, temper, budget, sweeps, targets)
    fit = written(fit.select(*DIMENSIONS, "p"), "mix-fit")
    out = _same(rows, F.broadcast(fit) if small else fit, list(DIMENSIONS))
    out = out.withColumn("probability", F.round("p", 9)).drop("p")
    return out.withColumn("kept", draw(F.col(f"{ROW}.doc_id")) < F.col("probability"))


def sample_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The input rows, with all their columns, that are drawn."""
    return unpacked(drawn(described(docs), **parameters).filter("kept"))


def probabilities(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every row; texts are read once."""
    slim = described(docs).select(F.struct(F.col(f"{ROW}.doc_id").cast("long").alias("doc_id")).alias(ROW), *DIMENSIONS, "n_tokens")
    out = drawn(written(slim, "mix-rows"), **parameters)
    return out.select(f"{ROW}.doc_id", *DIMENSIONS, "n_tokens", "probability", "kept")


def mixing_sql(temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """DuckDB SQL for the rows of the registered query."""
    space = r"[\x20\x09-\x0D]+"
    plain = f"trim(regexp_replace(coalesce(text, ''), '{space}', ' ', 'g'), ' ')"
    size = "length(coalesce(text, ''))"
    steps = [
        f"""rows AS (SELECT doc_id, source, lang,
            CASE WHEN {plain} = '' THEN 'empty'
                 WHEN ({size} - length(replace(coalesce(text, ''), '|', ''))) * 20 >= {size} THEN 'table'
                 WHEN ({size} - length(translate(coalesce(text, ''), '{NOISE}', ''))) * 20 >= {size} THEN 'noisy'
                 WHEN {size} < 400 THEN 'short' ELSE 'prose' END AS topic,
            CASE WHEN {plain} = '' THEN 0 ELSE length({plain}) - length(replace({plain}, ' ', '')) + 1 END AS n_tokens
            FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL)",
        "f0 AS (SELECT *, tokens AS w FROM cells)",
    ]
    for name in DIMENSIONS:
        steps.append(f"s_{name} AS (SELECT {name}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {temper}) ELSE 0 END AS own FROM cells GROUP BY {name})")
        steps.append(f"t_{name} AS (SELECT {name}, own / (SELECT sum(own) FROM s_{name}) AS target FROM s_{name})")
    last = "f0"
    for i in range(sweeps):
        for name in DIMENSIONS:
            here = f"f{i}_{name}"
            steps.append(
                f"{here} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN total > 0 THEN w * target / total ELSE 0 END AS w"
                f" FROM (SELECT *, sum(w) OVER (PARTITION BY {name}) AS total FROM {last}) x JOIN t_{name} t ON x.{name} IS NOT DISTINCT FROM t.{name})"
                .replace("SELECT source, lang, topic, tokens,", "SELECT x.source, x.lang, x.topic, x.tokens,")
            )
            last = here
    steps.append(f"p0 AS (SELECT *, 0.0::DOUBLE AS p, sum(tokens) OVER () AS everything FROM {last})")
    for k in range(SPILLS):
        steps.append(
            f"p{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w, everything, CASE WHEN p >= 1 OR tokens = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE,"
            f" w * ({budget} * everything - coalesce(sum(tokens) FILTER (p >= 1) OVER (), 0)) / (sum(w) FILTER (p < 1) OVER ()) / tokens) END AS p FROM p{k})"
        )
    return (
        "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(p, 9) AS probability,
               ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < round(p, 9) AS kept
        FROM rows r JOIN p{SPILLS} c ON r.source IS NOT DISTINCT FROM c.source AND r.lang IS NOT DISTINCT FROM c.lang AND r.topic = c.topic"""
    )
