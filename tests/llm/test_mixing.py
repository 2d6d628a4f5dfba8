from collections import defaultdict

import pytest

from sheaf.llm import mixing as M


def brute(rows, temper=M.TEMPER, budget=M.BUDGET, sweeps=M.SWEEPS):
    """Probabilities of cells, in plain Python; rows: (source, lang, topic, tokens)."""
    cells = defaultdict(float)
    for *cell, n in rows:
        cells[tuple(cell)] += n
    weights, targets = dict(cells), []
    for d in range(3):
        own = defaultdict(float)
        for cell, n in cells.items():
            own[cell[d]] += n
        own = {k: v**temper if v > 0 else 0.0 for k, v in own.items()}
        targets.append({k: v / sum(own.values()) if sum(own.values()) else 0.0 for k, v in own.items()})
    def marginal(d):
        total = defaultdict(float)
        for cell, w in weights.items():
            total[cell[d]] += w
        return total

    errors = []
    while len(errors) < M.ROUNDS and (len(errors) < 2 or errors[-1] <= errors[-2] / 2) and not (errors and errors[-1] <= M.TOLERANCE):
        for _ in range(sweeps):
            for d in range(3):
                total = marginal(d)
                weights = {c: w * targets[d][c[d]] / total[c[d]] if total[c[d]] > 0 else 0.0 for c, w in weights.items()}
        errors.append(max((abs(marginal(d)[k] / t - 1) for d in range(3) for k, t in targets[d].items() if t > 0), default=0.0))
    p, whole = dict.fromkeys(cells, 0.0), sum(cells.values())
    for _ in range(M.SPILLS):
        rest = budget * whole - sum(n for c, n in cells.items() if p[c] >= 1)
        share = sum(w for c, w in weights.items() if p[c] < 1)
        p = {c: 1.0 if p[c] >= 1 or not n else min(1.0, weights[c] * rest / share / n) for c, n in cells.items()}
    return p


@pytest.mark.parametrize("single", [100_000, 0])
def test_probabilities(small, single):
    """The fit in one task and the one over written tables."""
    sweeps = M.SWEEPS if single else 6
    out = M.drawn(M.described(small), single_cells=single, sweeps=sweeps).collect()
    want = brute([(r.source, r.lang, r.topic, r.n_tokens) for r in out], sweeps=sweeps)
    assert len(out) == small.count()
    for r in out:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], abs=2e-9)
        assert r.kept == (M_draw(r) < r.probability)


def M_draw(r):
    import hashlib

    key = "" if r["__row"].doc_id is None else str(r["__row"].doc_id)
    return int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:12], 16) / (1 << 48)


def test_marginals_meet_the_targets(spark):
    rows = [(i, "w " * (20 + i % 7), f"l{i % 3}", f"s{min(i % 10, 4)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.drawn(M.described(df), budget=0.3).collect()
    weight, own = defaultdict(float), defaultdict(float)
    for r in out:
        weight[r.source] += r.probability * r.n_tokens
        own[r.source] += r.n_tokens
    total, tempered = sum(weight.values()), sum(v**M.TEMPER for v in own.values())
    for s in own:
        assert weight[s] / total == pytest.approx(own[s] ** M.TEMPER / tempered, rel=1e-3)
    assert total / sum(own.values()) == pytest.approx(0.3, rel=1e-3)


def test_odd_rows(odd, odd_extended, none):
    for frame in (odd, odd_extended):
        out = M.drawn(M.described(frame), sweeps=3).collect()
        assert len(out) == frame.count()
        assert {r.topic for r in out if not (r["__row"].text or "").strip()} == {"empty"}
        sample = M.sample_documents(frame, sweeps=3)
        assert sample.columns == frame.columns and sample.count() == sum(r.kept for r in out)
        assert M.probabilities(frame, sweeps=3).count() == frame.count()
    assert M.sample_documents(none).count() == 0
    assert M.drawn(M.described(none), single_cells=-1, sweeps=1).count() == 0


def test_words_and_topics(spark):
    """Words are runs between any white space; each noise character counts."""
    texts = ["a\tb\vc\fd\re\nf", "  a   b \n\n c  ", "a \t \n b", " \t\r\n\v\f ", "", None, "a b c", "\t\n", "\n\t", "a\n\tb\t\nc", "x" * 500, "|" * 30 + "x" * 500]
    texts += [f"{mark} " + "word" * 4 for mark in "%&$*#!~^"] + ["word!! " * 100, "word~ " * 100, "word^ " * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = df.select("doc_id", M.token_count(df.text).alias("n"), M.topic_of(df.text).alias("topic")).collect()

    def topic(text):
        if not text.strip(" \t\n\v\f\r"):
            return "empty"
        if text.count("|") * 20 >= len(text):
            return "table"
        if sum(map(text.count, "%&$*#!~^")) * 20 >= len(text):
            return "noisy"
        return "short" if len(text) < 400 else "prose"

    want = [(i, len((t or "").encode().split()), topic(t or "")) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("single_cells", [100_000, 0])
def test_given_targets_are_met(spark, single_cells):
    """Expected tokens of the sample have the shares that are asked for, and the other dimensions keep theirs."""
    rows = [(i, "word " * (5 + i % 30), "en" if i % 3 else "de", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    parameters = {"targets": {"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 1}}, "budget": 0.2, "single_cells": single_cells, "sweeps": 4}
    out = M.probabilities(docs, **parameters).toPandas()
    out["expected"] = out["n_tokens"] * out["probability"]
    total = out["expected"].sum()
    assert total == pytest.approx(0.2 * out["n_tokens"].sum(), rel=1e-4)
    assert out.groupby("source")["expected"].sum()["a"] / total == pytest.approx(0.75, rel=1e-4)
    assert out.groupby("lang")["expected"].sum()["de"] / total == pytest.approx(0.5, rel=1e-4)


def test_targets_that_cannot_be_met_are_named(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "a"), (2, "c d", "de", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="can't be met"):
        M.probabilities(docs, targets={"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 3}})
    with pytest.raises(ValueError, match="source"):
        M.probabilities(docs, targets={"colour": {"red": 1}})
