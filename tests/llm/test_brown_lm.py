import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sheaf.llm import brown_lm as B


def words(text):
    return (text or "").encode().lower().split() + [B.END]


def check(docs, train, out):
    counts = Counter(w for r in train for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r.doc_id, len(words(r.text)), sum(counts[w] > 0 for w in words(r.text)), n,
                    round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 4)) for r in docs), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-6)


@pytest.mark.parametrize("hot_words", [20, 131_072])
def test_base_scores(small, hot_words):
    """With few hot words nearly all counts come from the join."""
    rows = small.collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    ids = [r.doc_id for r in train]
    out = B.score_texts(small, small.filter(small.doc_id.isin(ids)), hot_words=hot_words, hot_units=10, classes=6).collect()
    check(rows, train, out)
    held = [r for r in out if r.doc_id not in set(ids)]
    assert all(r.score < 0 for r in held)


def test_classes_beat_the_base(small):
    out = B.score_texts(small, small.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, odd_extended, none):
    rows = odd.collect()
    check(rows, rows, B.score_texts(odd, odd).collect())
    check(rows, rows, B.score_texts(odd_extended, odd_extended).collect())
    assert B.score_texts(none, odd).count() == 0
    unseen = B.score_texts(odd, none).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in unseen)


def test_exchange_finds_two_kinds():
    """Words of two kinds follow one another; clustering tells the kinds apart."""
    rng = np.random.default_rng(2)
    counts = np.zeros((10, 10))
    for a in range(1, 5):
        for b in range(5, 9):
            counts[a, b], counts[b, a] = rng.integers(50, 60, 2)
    own = B.exchange(counts, 3, 10)
    assert len(set(own[1:5])) == 1 and len(set(own[5:9])) == 1 and own[1] != own[5]
    assert own[0] == 0 and own[9] == 3


def likelihood(table):
    return B._xlogx(table).sum() - B._xlogx(table.sum(0)).sum() - B._xlogx(table.sum(1)).sum()


def test_gains_equal_the_likelihood():
    rng = np.random.default_rng(5)
    table = rng.integers(1, 50, (5, 5)).astype(float)
    cells = [(np.array([0, 4, 5 + 0]), np.array([2, 1, 3])), (np.array([0, 5 + 4]), np.array([4, 4]))]  # neighbours of other classes
    got = B.gains(table, np.concatenate([c for c, _ in cells]), np.concatenate([n for _, n in cells]), np.array([0, 3]))
    for row, (cell, n) in zip(got, cells, strict=True):
        after = []
        for c in range(1, 4):
            other = table.copy()
            for k, m in zip(cell, n, strict=True):
                other[(k, c) if k < 5 else (c, k - 5)] += m
            after.append(likelihood(other))
        assert row[1:4] - row[1] == pytest.approx(np.array(after) - after[0])  # the rest is the same for all classes


def test_words_of_all_frequencies_join_their_kind(spark):
    """Names stand before verbs, also those beyond the lexicon; a class holds words of one kind only."""
    rng = np.random.default_rng(7)
    names, verbs = [f"n{i}" for i in range(120)], [f"v{i}" for i in range(120)]
    weight = 1 / np.arange(1, 121)
    texts = [" ".join(f"{rng.choice(names, p=weight / weight.sum())} {rng.choice(verbs, p=weight / weight.sum())}" for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    trained = B.Trained(df, hot_words=60, hot_units=20, classes=5)
    classes = {w.decode()[0]: set() for w in trained.lexicon.words[1:]}
    for w, c in zip(trained.lexicon.words[1:], trained.own[1:], strict=True):
        classes[w.decode()[0]].add(int(c))
    rare = trained.rare.collect()
    for r in rare:
        classes[bytes(r.word).decode()[0]].add(r["class"])
    assert len(trained.lexicon.words) <= 61 and len(rare) > 100
    assert not classes["n"] & classes["v"]


def brute_score(trained, text):
    """Each word by the definition, one after the other."""
    counts, classes = dict(zip(trained.lexicon.words, trained.lexicon.counts, strict=True)), dict(zip(trained.lexicon.words, trained.own, strict=True))
    for r in trained.rare.collect():
        counts[bytes(r.word)], classes[bytes(r.word)] = r.c, r["class"]
    model, unseen = trained.model, len(trained.model.step) - 1
    total, before = 0.0, 0
    for w in words(text):
        c = classes.get(w, unseen)
        total += model.step[before, c]
        if c not in (0, unseen):
            total += math.log10(counts[w] - model.discount) - model.size[c]
        before = c
    return total


@pytest.mark.parametrize("hot_words", [30, 131_072])
def test_scores_against_brute_force(spark, small, hot_words):
    docs = small.limit(40).cache()
    train = docs.filter("doc_id % 3 > 0")
    trained = B.Trained(train, hot_words, 10, 6)
    again = B.score_texts(docs, train, hot_words, 10, 6).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in again[:15]:
        assert r.score == pytest.approx(brute_score(trained, texts[r.doc_id]), rel=1e-6)


def test_probabilities_sum_to_one(spark, small):
    """Over all known words and the event of an unseen one, whatever class stands before."""
    trained = B.Trained(small.limit(30), 200, 20, 6)
    counts, classes = trained.lexicon.counts.astype(float), trained.own
    rare = trained.rare.toPandas()
    counts, classes = np.append(counts, rare["c"]), np.append(classes, rare["class"])
    assert counts.sum() == trained.tokens and len(counts) == trained.distinct
    model = trained.model
    emit = 10 ** model.emit(classes.astype(int), counts)
    for before in range(7):
        total = (10 ** model.step[before, classes.astype(int)] * emit).sum() + 10 ** model.step[before, -1]
        assert total == pytest.approx(1.0)


def test_frequent_words_of_one_frequency(spark):
    vocab = spark.createDataFrame([(f"w{i}".encode(), 7) for i in range(5000)] + [(B.END, 9)], "word binary, c long")
    words_, counts = B.frequent_words(vocab, 1000)
    assert words_[0] == B.END and 900 <= len(words_) <= 1001 and set(counts[1:]) == {7}


def test_transitions_hold_every_two_neighbours(spark, small):
    """Also those that are both beyond the lexicon: the class bigrams are those of the texts, each word by its class."""
    train = small.limit(40).cache()
    trained = B.Trained(train, 30, 10, 6)
    own = dict(zip(trained.lexicon.words, trained.own, strict=True)) | {bytes(r.word): r["class"] for r in trained.rare.collect()}
    want = np.zeros((6, 6))
    for r in train.collect():
        classes = [0] + [own[w] for w in words(r.text)]
        np.add.at(want, (classes[:-1], classes[1:]), 1)
    assert want.sum() == trained.tokens
    assert (trained.table == want).all()


def test_words_among_rare_words_join_their_kind(spark):
    """x words stand between rare verbs only, so that nothing of the lexicon is around them."""
    texts = [f"n{i % 9} v{i % 7} n{(i + 4) % 9} v{(i + 3) % 7}" for i in range(400)]
    texts += [f"v{i % 7} n{i % 9} v{(i + 1) % 7}" for i in range(200)]  # verbs are the largest class
    texts += [f"n1 v{100 + i} x{i} v{300 + i} n2" for i in range(60)]
    trained = B.Trained(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot_words=16, hot_units=16, classes=3)
    classes = {bytes(r.word).decode(): r["class"] for r in trained.rare.collect()}
    names = {int(c) for w, c in zip(trained.lexicon.words, trained.own, strict=True) if w.startswith(b"n")}
    assert len(trained.lexicon.words) == 17 and len(classes) == 180
    assert {classes[f"x{i}"] for i in range(60)} == names
    assert not {c for w, c in classes.items() if w[0] == "v"} & names


def test_cells_of_a_word_are_merged():
    cell, n, starts = B._merged(np.array([1, 0, 1, 1]), np.array([3, 2, 3, 9]), np.array([2, 1, 5, 0]), 3, 5)
    assert [(cell[a:b].tolist(), n[a:b].tolist()) for a, b in zip(starts, [*starts[1:], len(cell)], strict=True)] == [([0, 2], [0, 1]), ([0, 3], [0, 7]), ([0], [0])]


def test_learning_from_rows_of_the_same_table(spark, small, odd):
    """A condition on the rows gives what the table of these rows gives; rows for which it is null are not learnt from."""
    for docs, rows in ((small.limit(60).cache(), "doc_id % 3 > 0"), (odd, "doc_id % 2 = 0")):
        want = B.score_texts(docs, docs.filter(rows), 30, 10, 6).collect()
        got = B.score_texts(docs, B.F.expr(rows), 30, 10, 6).collect()
        assert len(got) == len(want) == docs.count()
        plain = [sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in x), key=str) for x in (got, want)]
        assert plain[0] == plain[1]
