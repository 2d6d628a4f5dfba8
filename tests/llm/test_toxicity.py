import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import toxicity as X


def made(spark):
    """Texts of harmless words, a tenth of them with an insult."""
    rng = np.random.default_rng(5)
    syllables = ["an", "er", "in", "th", "on", "re", "st", "al", "ou", "le"]
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, 40)), ["idiot", "moron", "clown"][int(rng.integers(0, 3))])
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_texts_and_spellings(spark, odd, odd_extended, none):
    docs = made(spark)
    machine = X.train(docs, docs.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    out = {r.doc_id: r for r in X.score_texts(docs, machine).collect()}
    held = [r for r in docs.collect() if r.doc_id % 3 == 1]
    right = [out[r.doc_id].predicted == r.toxic for r in held]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())
    odd_spellings = [(1, "anerst inth i d i o t alou rest i d i o t"), (2, "you i.d.i.o.t an mo-ron"), (3, "the idxiot and the morxon"), (4, "anerst inth alou rest")]
    got = {r.doc_id: r for r in X.score_texts(spark.createDataFrame(odd_spellings, "doc_id long, text string"), machine).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 1, 1, 0]
    assert got[2].sentence == 0
    for frame in (odd, odd_extended):
        assert X.score_texts(frame, machine).filter("predicted = 1").count() == 0
        assert X.score_texts(frame, machine).count() == frame.count()
    assert X.score_texts(none, machine).count() == 0


def test_keep_clean(spark, odd_extended, none):
    docs = made(spark)
    labels = docs.select("doc_id", "toxic")
    kept = X.keep_clean(docs.drop("toxic"), docs, labels)
    assert kept.columns == ["doc_id", "text"]
    left = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in docs.filter("toxic = 1").collect()}
    assert len(left & toxic) <= 2 and len(left) >= 600 - len(toxic) - 4
    out = X.keep_clean(odd_extended, docs, labels)
    assert out.columns == odd_extended.columns and out.count() == odd_extended.count()
    assert X.keep_clean(none, docs, labels).count() == 0


def test_nothing_to_learn_from(odd, none, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1), (78, 0)], "doc_id long, toxic int")
    machine = X.train(odd, labels)
    assert X.score_texts(odd, machine).filter("predicted = 1").count() == 0
    assert X.train(none, labels).bias == machine.bias


def test_features_are_the_kernel():
    """Cosines of explicit features equal a plain count of weighted subsequences."""

    def plain(a, b):
        def phi(s):
            out = {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + X.SPAN)):
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + X.DECAY ** (k - i + 1)
            return out

        x, y = phi(a), phi(b)
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y.get(key, 0) for key, v in x.items()) / size

    words = [b"idiot", b"idxiot", b"banana", b"moron", b"oron"]
    rows, _ = X.symbols(words)
    got = X.kernel(rows, rows)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain(f"^{a.decode()}|", f"^{b.decode()}|")) < 1e-4


def test_null_labels_do_not_count(spark):
    docs = made(spark)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("toxic")).alias("toxic"))
    assert X.train(docs, labels.unionByName(labels)).slopes[0] >= 0


def test_a_spelling_counts_once():
    from sheaf.llm.toxicity import words_of

    assert words_of("i_d_i_o_t") == [b"idiot"] == words_of("i.d.i.o.t!")
    assert words_of("i d i o t").count(b"idiot") == 1 and words_of("x i-d i.o t").count(b"xidiot") == 1
    assert words_of("idi-ot and more") == [b"idiot", b"and", b"more"]
