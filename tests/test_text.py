import random
import string

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import matching as M
from sheaf.operators import scoring as C
from sheaf.operators import search as Q


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first().c


def test_overlapping_targets_and_checksums(spark):
    text = "banana 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32"
    assert M.overlapping(text, "ana") == [1, 3]
    assert one(spark, F.size(M.matches(F.col("v"), "card")), text) == 1
    assert one(spark, M.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32"))) is True
    assert one(spark, M.iban_valid(F.lit("GB82 WEST 1234 5698 7654 33"))) is False
    assert one(spark, F.size(M.matches(F.col("v"), "cccd")), "ID: 123 456 789 012.") == 1
    assert one(spark, F.size(M.matches(F.col("v"), "cccd")), "1123456789012") == 0
    assert one(spark, F.size(M.matches(F.col("v"), "iban")), text) == 1
    assert one(spark, M.hits(F.col("v"), "iban", "card"), text) == ["4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"]


def test_overlaps_against_a_plain_scan():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        target = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        assert M.overlapping(text, target) == [i for i in range(len(text)) if text.startswith(target, i)]


def test_search_form():
    assert M.search_form("１２–３ a­b​") == "12-3 ab"
    assert M.regex_places("aaa", "aa") == [(0, 2), (1, 3)]


def test_redaction_leaves_nothing(spark):
    text = "write a@b.org or a@b.org.uk, card 4111111111111111"
    clean = one(spark, M.redact(F.col("v"), ["email", "card"]), text)
    assert len(clean) == len(text) and "@" not in clean and "4111" not in clean
    assert M.covered("mail b@c.org or ab@c.org", ["email"], "#") == "mail ####### or ########"
    assert M.covered("a\u200bb@c.org x", ["email"], "#") == "######### x"
    assert M.covered("card ４１１１\u200b1111 1111 1111!", ["card"], "#") == "card " + "#" * 19 + "!"
    assert M.covered("e\u0301a@b.com@c.org, 0912345678", ["email", "phone"], "#") == "e\u0301" + "#" * 13 + ", " + "#" * 10
    assert M.covered(None, ["email"], "#") is None and M.covered("", ["email"], "#") == ""


def windows(text, pattern, lengths, valid, edge):
    """All places by trying every substring."""
    import re

    out = []
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            code = re.sub("[^A-Za-z0-9]", "", text[i:j])
            outside = (text[i - 1 : i], text[j : j + 1])
            if len(code) in lengths and re.fullmatch(pattern, text[i:j]) and not any(x and re.match(edge, x) for x in outside) and valid(code):
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize(
    ("preset", "pattern", "edge"),
    [("card", r"[0-9](?:[ -]?[0-9])*", "[0-9]"), ("cccd", r"[0-9](?:[ .-]?[0-9])*", "[0-9]"), ("cmnd", r"[0-9](?:[ .-]?[0-9])*", "[0-9]"),
     ("iban", r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9])*", "[A-Za-z0-9]")],
)
def test_places_against_all_substrings(preset, pattern, edge):
    rng = random.Random(5)
    parts = ["4111", "1111", "12", "123456", "7", " ", " ", "-", ".", "x", "DE89", "GB82 WEST 1234 5698 7654 32", "3704 0044 0532 0130 00", "4111111111111111"]
    check = {"card": M.luhn, "iban": M.iban}.get(preset, lambda code: True)
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert sorted((i, j) for _, i, j in M.places(text, [preset])) == windows(text, pattern, M.LENGTHS[preset], check, edge), text


def test_phones():
    assert [(i, j) for _, i, j in M.places("+84912345678, 0912345678; 5+84912345678 +0912345678 00912345678901 ++12", ["phone"])] == [(0, 12), (14, 24), (41, 51), (68, 71)]


def test_folded_words_and_passages():
    assert Q.tokens("The naïve Đỗ café, der Hund_1") == ["naive", "do", "cafe", "der", "hund_1"][:1] + ["cafe", "der", "hund_1"]
    assert Q.passages("One. Two!\nThree") == ["One.", "Two!", "Three"] and len(Q.passages("x" * 5000)) == 3
    assert [s["sentence"] for s in Q.best_sentences("A cat. A cat sat.\n\nNothing", 1)] == ["A cat sat."]


def test_lines_of_tables(spark):
    text = "a  b\tc\n\n| x | y \\| z |\n|---|:--:|\n| 1 |  |\n| 2 | 3\nend\none  two"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r.table, r.row, list(r.cells)) for r in Q.line_tables(df, "id", "text").orderBy("table", "row").collect()]
    assert got == [(1, 1, ["x", "y \\| z"]), (1, 2, ["1", ""]), (1, 3, ["2", "3"])]


@pytest.mark.parametrize(
    ("url", "allowed"),
    [("#a", True), ("http://x", True), ("HTTPS://x", True), ("mailto:a@b", True), ("javascript:x", False), ("/x", False), (" http://x", False), ("ftp://x", False), ("data:x", False)],
)
def test_links(spark, url, allowed):
    assert one(spark, X.link_allowed(F.col("v")), url) is allowed


@pytest.mark.parametrize(
    ("line", "number"),
    [("3", True), ("- 3 -", True), ("Page 3 of 9", True), ("Trang 2", True), ("xiv", True), ("XLIX", True), ("l", True), ("mix", False), ("Chapter 3", False), ("3.5 kg", False)],
)
def test_page_numbers(spark, line, number):
    assert one(spark, X.is_page_number(F.col("v")), line) is number


def test_spreadsheet_helpers(spark):
    names = [r.n for r in spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (16383,)], "i int").select(X.column_name(F.col("i")).alias("n")).collect()]
    assert names == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    for cell, numeric in (("12", True), ("012", False), ("+1", False), ("-0.5", True), ("1e5", True), ("1e999", False), ("", False)):
        assert one(spark, X.is_numeric(F.col("v")), cell) is numeric
    assert one(spark, X.guard_formula(F.col("v")), "=1+1") == "'=1+1"
    assert one(spark, X.escape_csv(F.col("v")), 'a"b') == '"a""b"'
    assert [one(spark, X.sniff_delimiter(F.col("v")), t) for t in ("a,b", "a;b;c,d", "a\tb", '"a;b;c",d', "none")] == [",", ";", "\t", ",", ","]


def test_natural_order(spark):
    names = ["a10", "a2", "A1", "b", "a02"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in got] == ["A1", "a02", "a2", "a10", "b"]


def test_tags(spark):
    html = 'a<!-- <b> --><b title="x > y">c</b><script>var t="</p>";</script> 1 < 2'
    assert one(spark, X.strip_tags(F.col("v")), html) == "ac 1 < 2"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distances_against_the_table():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        assert C.distance(a, b) == plain_distance(a, b) == C.distance("".join(a), "".join(b))
    assert C.character_rate("e\u0301 x", "é  x") == 0 and C.character_rate("", "a") == 1 and C.character_rate("ab" * 2000, "cd" * 2000) is None
    assert C.character_rate("x" * 100_001, "") is None
    words = [str(i) for i in range(20_000)]
    assert C.distance(words, words[::-1]) == 20_000 and len(C.shortest_edits(words, words[::2])) == 10_000


def test_shortest_edits_are_shortest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        script = C.shortest_edits(a, b)
        out, at = [], 0
        for kind, x, y in script:
            out += a[at:x]
            at = x
            if kind == "delete":
                at += 1
            else:
                out.append(b[y])
        assert out + a[at:] == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert len(script) == len(a) + len(b) - 2 * table[-1][-1]


def test_word_changes():
    assert [(c["kind"], c["old"], c["new"]) for c in C.word_changes("one two three", "one 2 three four")] == [("replace", ["two"], ["2"]), ("insert", [], ["four"])]


def test_tree_and_table_scores():
    a = [(1, "Intro"), (2, "Scope"), (1, "End")]
    assert C.heading_distance(a, a) == 0 and C.heading_distance([], []) == 0
    assert C.heading_distance(a, a[:2]) == pytest.approx(1 / 3)
    table = [["a", "b"], ["c", "d"]]
    assert C.table_similarity(table, table) == 1
    assert C.table_similarity(table, [["a", "b"], ["c", "x"]]) == pytest.approx(1 - 1 / 7)
    assert C.table_similarity([["x"] * 600], table) is None


def test_rates(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("", ""), ("one two", "one 2")], "a string, b string")
    got = df.select(C.character_error_rate(F.col("a"), F.col("b")).alias("c"), C.word_error_rate("a", "b").alias("w")).collect()
    assert [round(r.c, 4) for r in got[:3]] == [0.3333, 1.0, 0.0]
    assert got[3].w == 0.5
    assert [r.m for r in df.select(C.mean_of(F.lit(None).cast("double"), F.lit(0.5), F.lit(1.0)).alias("m")).limit(1).collect()] == [0.75]


def test_glossary():
    glossary = {"machine": "Maschine", "machine learning": "maschinelles lernen"}
    assert Q.translated("Machine learning and MACHINE `machine` <machine>", glossary) == "Maschinelles lernen and MASCHINE `machine` <machine>"


def test_folding(spark):
    assert one(spark, X.fold(F.col("v")), "Đường CAFÉ") == "duong cafe"
    assert one(spark, X.clean(F.col("v")), " é   b ") == "é b"
    assert set(string.ascii_lowercase) >= set(one(spark, X.fold(F.col("v")), "ÀÉÎ"))
