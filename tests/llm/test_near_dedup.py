import random

import numpy as np

from sheaf.llm import near_dedup as N
from sheaf.llm.near_dedup import keep_one, near_duplicates


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, words, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert found(near_duplicates(small, words=2)) == brute(rows, 2)
    assert found(near_duplicates(small)) == brute(rows, 5)


def test_chains_and_outsiders(spark):
    """One family whose members are linked by chains, with members near the threshold on both sides."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, words=2)) == brute(rows, 2)


def test_odd_rows(odd, odd_extended):
    want = brute([(r.doc_id, r.text) for r in odd.collect()], 5)
    assert found(near_duplicates(odd)) == want
    assert found(near_duplicates(odd_extended)) == want
    assert keep_one(odd_extended).columns == odd_extended.columns


def test_keep_one_keeps_one_of_each_component(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert sorted(r.doc_id for r in keep_one(small).collect()) == sorted({c for _, _, c in brute(rows, 5)})


def test_keep_one_drops_rows_not_identifiers(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (9, text + " more"), (9, "a text of its own that nobody else has"), (9, "a text of its own that nobody else has"),
            (None, text), (None, "no identifier and no copy anywhere"), (7, ""), (7, ""), (7, None), (9, "  "), (5, "same id one"), (5, "same id two")]
    got = sorted(((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [rows[0], rows[2], *rows[5:]]
    assert got == sorted(want, key=str)


def test_empty(none):
    assert near_duplicates(none).count() == 0
    assert keep_one(none).count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for size in (4, 40, 400):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, size * 8, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, (2, size), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, o])) for o in own)
            agree.append((N.signature(a) == N.signature(b)).mean())
        assert abs(np.mean(agree) - 0.8) < 0.04
