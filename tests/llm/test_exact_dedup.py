import hashlib
import re

from pyspark.sql import functions as F

from sheaf.llm.exact_dedup import MergeIndex, exact_dedup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[norm(r.text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), hashlib.sha256(norm(r.text).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.sha) for r in df.collect()), key=str)


def test_odd_rows(odd, odd_extended):
    want = expected(odd.collect())
    assert found(exact_dedup(odd)) == want
    assert found(exact_dedup(odd_extended)) == want


def test_one_row_of_each_group_is_kept(odd):
    kept = exact_dedup(odd).filter("kept").collect()
    assert len(kept) == len({norm(r.text) for r in odd.collect()})
    out = MergeIndex(odd).survivors()
    assert out.columns == odd.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r.text) for r in odd.collect()})


def test_collisions_are_settled_on_the_bytes(odd, small):
    def weak(text):
        return F.substring(F.sha2(text.cast("binary"), 256), 1, 1)

    assert found(exact_dedup(odd, digest=weak)) == expected(odd.collect())
    assert found(exact_dedup(small, digest=weak)) == expected(small.collect())
    kept = MergeIndex(small, digest=weak).survivors()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in expected(small.collect())})


def test_empty(none):
    assert exact_dedup(none).count() == 0
    assert MergeIndex(none).survivors().count() == 0


def test_lookups_reach_the_scan(small, capsys):
    import hashlib

    index = MergeIndex(small)
    rows = [(r.doc_id, " ".join(r.text.split())) for r in small.collect()]
    wanted = [hashlib.sha256(normal.encode()).hexdigest() for _, normal in rows[:5]]
    found = index.lookup([*wanted, "0" * 64])
    assert {r.digest for r in found.collect()} <= set(wanted) and found.count() > 0
    found.explain("formatted")
    assert "PushedFilters: [In(digest" in capsys.readouterr().out
