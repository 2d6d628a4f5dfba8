"""Queries that SQL cannot express, against plain versions over all their rows."""

import html
import re
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sheaf.operators import matching as M
from sheaf.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.fixture(scope="module")
def turns(spark):
    texts = {(r.conv_id, r.turn): r.text for r in table(spark, "conversations").collect()}
    keys = defaultdict(list)
    for conv, turn in sorted(texts):
        keys[conv].append(turn)
    return {(c, a): (texts[c, a], texts[c, b]) for c, own in keys.items() for a, b in zip(own, own[1:], strict=False)}


def edit_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_error_rates(spark, turns):
    got = {(r.conv_id, r.turn): r.wer for r in run(spark, "wer_pairs")}
    assert got == {k: pytest.approx(edit_table(a.split(), b.split()) / len(a.split()), abs=1e-6) for k, (a, b) in turns.items()}


def test_character_error_rates(spark, turns):
    got = {(r.conv_id, r.turn): r.cer for r in run(spark, "cer_pairs")}
    assert set(got) == set(turns)
    for key in sorted(turns)[:12]:
        a, b = (" ".join(x.split()) for x in turns[key])
        if len(a) * len(b) < 3_000_000:
            assert got[key] == pytest.approx(edit_table(a, b) / len(a), abs=1e-6)


def test_word_differences(spark, turns):
    """The changes turn one text into the other, and no fewer words could."""
    found = defaultdict(list)
    for r in run(spark, "word_diff"):
        found[r.conv_id, r.turn].append(r)
    for key, (a, b) in turns.items():
        old, new, out, at = a.split(), b.split(), [], 0
        for r in sorted(found[key], key=lambda r: r.at):
            out += old[at : r.at]
            gone = (r.old or "").split()
            assert old[r.at : r.at + len(gone)] == gone
            out += (r.new or "").split()
            at = r.at + len(gone)
        assert out + old[at:] == new
        common = [0] * (len(new) + 1)
        for x in old:
            last = common[:]
            for j, y in enumerate(new, 1):
                common[j] = last[j - 1] + 1 if x == y else max(last[j], common[j - 1])
        edits = sum(len((r.old or "").split()) + len((r.new or "").split()) for r in found[key])
        assert edits == len(old) + len(new) - 2 * common[-1]


def test_exact_targets(spark):
    want = {}
    for r in table(spark, "documents").collect():
        text = M.search_form(r.text)
        at = [i for i in range(len(text)) if text.startswith("an", i)]
        if at:
            want[r.doc_id] = (len(at), at[0])
    assert {r.doc_id: (r.n, r.first) for r in run(spark, "exact_target_places")} == want


def test_glossary(spark):
    """Word by word, without a pattern of all terms."""
    terms = {"the": "der", "and": "und", "of the": "des"}

    def put(word):
        new = terms[word.lower()]
        return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:] if word[:1].isupper() else new

    def translated(text):
        out = []
        for part in re.split(r"(`[^`]*`|<[^>]*>|https?://\S+)", text):
            if re.fullmatch(r"`[^`]*`|<[^>]*>|https?://\S+", part):
                out.append(part)
                continue
            pieces = re.split(r"(\w+)", part)
            i = 0
            while i < len(pieces):
                if "".join(pieces[i : i + 3]).lower() == "of the":
                    out.append(put("".join(pieces[i : i + 3])))
                    i += 3
                else:
                    out.append(put(pieces[i]) if pieces[i].lower() in terms else pieces[i])
                    i += 1
        return "".join(out)

    texts = {r.doc_id: translated(r.text) for r in table(spark, "documents").collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, t string")
    want = {r.doc_id: r.d for r in frame.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("d")).collect()}
    assert {r.doc_id: r.digest for r in run(spark, "glossary_translate")} == want


def test_list_overlaps(spark):
    items = defaultdict(lambda: defaultdict(list))
    for r in table(spark, "lineitem").collect():
        items[r.l_orderkey][r.l_returnflag].append(str(r.l_linenumber))
    lists = {doc: [sorted(own[k]) for k in sorted(own)] for doc, own in items.items()}
    want, last = [], {}
    for doc in sorted(lists):
        got, free = last.get(doc // 64, [["1", "2"]]), None
        free = list(range(len(got)))
        for i, ref in enumerate(lists[doc]):
            share, place = 0.0, None
            for j in free:
                s = len(set(ref) & set(got[j])) / len(set(ref))
                if place is None or s > share:
                    share, place = s, j
            if place is not None and share >= 0.5:
                free.remove(place)
            else:
                place = None
            want.append((doc, i, place, round(share, 6)))
        last[doc // 64] = lists[doc]
    got = [(r.doc, r.reference, r.found, round(r.share, 6)) for r in run(spark, "list_overlaps")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_heading_distances(spark):
    """Forests by the recursive definition."""
    heads = defaultdict(list)
    for r in sorted(table(spark, "part").collect(), key=lambda r: r.p_partkey):
        heads[r.p_partkey // 8].append((r.p_size % 3 + 1, r.p_name))

    def tree(own):
        root = [0, "", []]
        stack = [root]
        for level, text in own:
            while stack[-1][0] >= level:
                stack.pop()
            node = [level, text, []]
            stack[-1][2].append(node)
            stack.append(node)

        def fixed(n):
            return (n[0], n[1], tuple(map(fixed, n[2])))

        return (fixed(root),)

    @lru_cache(None)
    def size(forest):
        return sum(1 + size(n[2]) for n in forest)

    @lru_cache(None)
    def cost(a, b):
        if not a or not b:
            return size(a) + size(b)
        x, y = a[-1], b[-1]
        swap = edit_table(x[1], y[1]) / max(len(x[1]), len(y[1]), 1) if x[0] == y[0] else 1
        return min(cost(a[:-1] + x[2], b) + 1, cost(a, b[:-1] + y[2]) + 1, cost(a[:-1], b[:-1]) + cost(x[2], y[2]) + swap)

    want = {d: min(1.0, cost(tree(heads[d]), tree(heads[d + 1])) / max(len(heads[d]), len(heads[d + 1]))) for d in heads if d + 1 in heads}
    assert {r.doc: r.distance for r in run(spark, "heading_distances")} == pytest.approx(want)


def test_layout_pairs(spark):
    left, right = defaultdict(list), defaultdict(list)
    for r in table(spark, "lineitem").collect():
        if r.l_linestatus == "O":
            left[r.l_orderkey].append((r.l_partkey, r.l_returnflag, r.l_linenumber))
        else:
            right[r.l_orderkey].append((r.l_suppkey * 10 + r.l_linenumber, r.l_returnflag, r.l_linenumber))
    got = run(spark, "layout_pairs")
    assert len({(r.doc, r.id, r.other, r.step) for r in got}) == len(got)
    steps = defaultdict(lambda: [0, 0])
    for r in got:
        steps[r.doc][r.step - 1] += 1
    for doc in set(left) | set(right):
        a, b = left[doc], right[doc]
        if len({x[0] for x in a}) < len(a) or len({x[0] for x in b}) < len(b):
            continue  # an identifier that comes twice names two boxes
        exact = sum(min(sum(x[1:] == k for x in a), sum(x[1:] == k for x in b)) for k in {x[1:] for x in a})
        by_text = sum(min(sum(x[1] == k for x in a), sum(x[1] == k for x in b)) for k in {x[1] for x in a})
        assert steps[doc] == [exact, by_text - exact]


def test_job_states(spark):
    allowed = {"queued": {"running", "canceled", "expired"}, "running": {"succeeded", "failed", "canceled", "queued"}, "failed": {"queued", "expired"}}
    names = ["running", "succeeded", "failed", "queued", "canceled"]
    jobs = defaultdict(list)
    for r in table(spark, "events").collect():
        jobs[str(r.user_id)].append((r.ts, r.event_id, names[r.event_id % 5]))
    want = {}
    for job, own in jobs.items():
        state, attempts, refused = "queued", 0, 0
        for _, _, target in sorted(own, key=lambda x: x[0]):
            if target not in allowed.get(state, {"expired"}) or state == "failed" and target == "queued" and attempts >= 3:
                refused += 1
            else:
                attempts += target == "running"
                state = target
        want[job] = (state, attempts, refused)
    assert {r.job: (r.status, r.attempts, r.refused) for r in run(spark, "stream_job_states")} == want


def test_page_text(spark):
    """Blocks and cells hold all characters of a page's body, in any order."""
    from sheaf.sources.html import read_html

    pages = table(spark, "pages")
    for r in read_html(pages).join(pages, "page_id").collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<title>.*?</title>", "", r.html)
        body = html.unescape(re.sub(r"""(?s)</?[a-zA-Z!](?:"[^"]*"|'[^']*'|[^'">])*>""", "", body))
        found = "".join(b.text for b in r.blocks) + "".join(c.text for c in r.cells)
        assert sorted(re.sub(r"\s", "", found)) == sorted(re.sub(r"\s", "", body)), r.page_id
    counts = {r.page_id: r for r in run(spark, "html_counts")}
    blocks = defaultdict(list)
    for b in run(spark, "html_blocks"):
        blocks[b.page_id].append(b)
    for key, r in counts.items():
        assert r.words == sum(len(b.text.split()) for b in blocks[key])
        assert r.paragraphs == sum(b.kind == "paragraph" for b in blocks[key])


def test_markdown_blocks(spark):
    """Without fences, marks and tables, the blocks' characters are those of the text."""
    found = defaultdict(str)
    for r in run(spark, "markdown_blocks"):
        found[r.doc_id] += r.text or ""
    checked = 0
    for r in table(spark, "documents").collect():
        if not re.search(r"[`*_~|<>#\[\]\\!+=:-]|^\s*\d+[.)]|^ {4}|\t", r.text, re.MULTILINE):
            assert sorted(re.sub(r"\s", "", found[r.doc_id])) == sorted(re.sub(r"\s", "", r.text)), r.doc_id
            checked += 1
    assert checked > 20
