import functools
import zlib

import numpy as np
from tokenizers import Tokenizer

from sheaf.llm.packing import CAPACITY, END_ID, OpenBins, cut, pack_documents


@functools.lru_cache
def whole_tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return whole_tokenizer().encode(text or "", add_special_tokens=False).ids + [END_ID]


def check(df, rows):
    out = df.collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str)
    want = []
    for key, text in rows:
        ids = np.array(ids_of(text), "<u4")
        want += [(key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), CAPACITY))]
    assert got == sorted(want, key=str)
    return by_sequence


def test_pieces_and_places(small):
    sequences = check(pack_documents(small), [(r.doc_id, r.text) for r in small.collect()])
    total = sum(r.length for members in sequences.values() for r in members)
    assert len(sequences) <= 1.05 * total / CAPACITY + 1


def test_odd_rows(odd, odd_extended, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(pack_documents(odd), rows)
    check(pack_documents(odd_extended), rows)
    assert pack_documents(none).count() == 0


def test_special_strings_and_runs(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "a" * 3000), (3, "中文" * 900), (4, "<|endoftext|>"), (5, "x  <|endoftext|><|endoftext|>\n\n y<|endoftext|")]
    rows += [(10 + i, run * n) for i, (run, n) in enumerate(((" ", 1_200_000), ("\n", 1_200_000), ("a", 100_000), ("7", 100_000), ("-", 100_000)))]
    rows += [(20, " " * 5000 + "word" + "\n \t" * 3000 + " end"), (21, "a" + "\u2003" * 9000 + "\x1c" * 5000 + "b" + "\r" * 4096)]
    check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_cut():
    assert cut(1, 10) == [(0, 1)]
    assert cut(10, 10) == [(0, 10)]
    assert cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_the_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)  # free 4
    assert bins.place(7) == (1, 0)  # free 3
    assert bins.place(5) == (2, 0)  # free 5: bin 1, the fullest, closes
    assert bins.place(3) == (0, 6)
    assert bins.open == 2
