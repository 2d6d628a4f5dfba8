import pytest
from pyspark.sql import functions as F

from sheaf.operators import layout as L
from sheaf.operators import prefix
from sheaf.operators import records as D
from sheaf.operators.matches import list_overlaps, rewritten
from sheaf.plans import recipes as R
from sheaf.plans.intents import draft
from sheaf.sources import forms
from sheaf.sources.markdown import read_markdown, write_markdown


def test_headings_and_body(spark):
    rows = [(1, 1, 0, "Title", 20.0), (1, 1, 1, "long body text " * 9, 10.0), (1, 1, 2, "Part", 14.0), (1, 1, 3, "cut off-", 14.0), (1, 1, 4, "lower case", 14.0)]
    df = spark.createDataFrame(rows, "doc long, page int, ord int, text string, size double")
    assert L.body_sizes(df).first().body == 10.0
    assert {r.ord: r.level for r in L.headings(df).collect()} == {0: 1, 1: None, 2: 2, 3: None, 4: None}


def test_running_heads_and_page_numbers(spark):
    rows = [(1, p, 0, f"Chapter {p}", 10.0) for p in (1, 2, 3)] + [(1, 1, 1, "once", 20.0), (1, 1, 9, "7", 790.0), (1, 1, 5, "Chapter 4", 400.0)]
    df = spark.createDataFrame(rows, "doc long, page int, ord int, text string, top double").withColumn("height", F.lit(800.0))
    assert sorted((r.page, r.ord) for r in L.furniture(df).collect()) == [(1, 0), (1, 9), (2, 0), (3, 0)]


def test_outline(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 3, 2, 1, 3])], "doc long, ord long, level int")
    assert [r.parent for r in L.outline(df).orderBy("ord").collect()] == [None, 0, 1, 0, None, 4]


def test_layout_pairs_prefer_the_page(spark):
    schema = "doc long, text string, page int, id long"
    left = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 11), (1, "b", 1, 12)], schema)
    right = spark.createDataFrame([(1, "a", 2, 20), (1, "a", 3, 21), (1, "c", 1, 22)], schema)
    assert sorted((r.id, r.other, r.step) for r in L.layout_pairs(left, right).collect()) == [(10, 21, 2), (11, 20, 1)]


def test_ranks_and_running_values_over_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(300)).alias("k"), "id")
    rows = sorted((r.k, r.id) for r in df.collect())
    got = prefix.ranked(df, ["k", "id"], partitions=7).collect()
    assert sorted((r.rank, r.k, r.id) for r in got) == [(i + 1, *r) for i, r in enumerate(rows)]
    got = {(r.k, r.id): (r.m, r.s) for r in prefix.running(prefix.running(df, ["k", "id"], "id", F.max, "m", 7), ["k", "id"], "id", F.sum, "s", 5).collect()}
    most, total = None, None
    for r in rows:
        assert got[r] == (most, total)
        most, total = max(r[1], most or 0), (total or 0) + r[1]


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, 10, True, "PDF"), (2, 5, 20, None, "md")], "id long, page_count int, size_bytes long, needs_ocr boolean, format string")
    cases = {"page_count != 5": [], "page_count >= 5": [2], "size_bytes < 15": [1], "!needs_ocr": [2], "needs_ocr": [1], "format == pdf": [1], 'format != "pdf"': [2]}
    for text, ids in cases.items():
        assert [r.id for r in df.filter(R.predicate(text)).collect()] == ids, text
    for text in ("page_count", "size > 3", "needs_ocr == 1", ""):
        with pytest.raises(R.RecipeError):
            R.predicate(text)
    assert R.recipe_key({"a": 1, "b": [2]}) == R.recipe_key({"b": [2], "a": 1})


def test_error_policies(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    tools = {"fail": lambda d: d.withColumn("error", F.when(F.col("x") == 1, "bad")), "add": lambda d: d.withColumn("x", F.col("x") + 10)}
    tools["mark"] = lambda d: d.withColumn("error", F.when(F.col("x") == 1, "bad")).withColumn("x", F.col("x") * 2)
    tools["raise"] = lambda d: d.select("nothing")

    def rows(*steps):
        return sorted((r.x, r.error, list(r.warnings)) for r in R.run(df, list(steps), tools).collect())

    assert rows({"tool": "fail"}, {"tool": "add"}) == [(1, "bad", []), (12, None, [])]
    assert rows({"tool": "mark", "on_error": "skip"}, {"tool": "add"}) == [(14, None, [])]
    assert rows({"tool": "mark", "on_error": "continue"}, {"tool": "add"}) == [(11, None, ["step 1: bad"]), (14, None, [])]
    assert rows({"tool": "raise", "on_error": "skip"}) == [] and len(rows({"tool": "raise", "on_error": "continue"})) == 2
    with pytest.raises(R.RecipeError, match="step 1"):
        rows({"tool": "raise"})


def test_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.32.0.1": True, "172.31.0.1": False, "256.1.1.1": False, "1.2.3": False, "1.2.3.4.": False, "x": False, "169.254.169.254": False}
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert {r.a: r.p for r in df.select("a", R.is_public(F.col("a")).alias("p")).collect()} == cases


def test_markdown_shapes():
    source = "---\ntitle: T\n---\n# A *b*\n\ntext [link](http://x)  \nnext\n\n- [x] done\n- [ ] open\n\n1. one\n\n> quoted\n> more\n\n```py\nx = 1\n```\n\n| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n\nHead\n----\n\n[^1]: note\n"
    got = read_markdown(source)
    assert got["title"] == "T" and got["links"] == ["http://x"]
    assert [(b["kind"], b["text"]) for b in got["blocks"]] == [
        ("heading", "A b"), ("paragraph", "text link\nnext"), ("list_item", "done"), ("list_item", "open"), ("list_item", "one"), ("quote", "quoted more"), ("code", "x = 1\n"), ("table", ""),
        ("heading", "Head"), ("footnote", "note"),
    ]
    assert got["blocks"][7]["rows"] == [["a", "b"], ["1", "2|3"]] and got["blocks"][2]["checked"] is True and got["blocks"][6]["lang"] == "py"
    kept = [b for b in got["blocks"] if b["kind"] != "footnote"]
    assert read_markdown(write_markdown(kept))["blocks"] == kept


def test_form_files():
    xfdf = '<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields><field name="a"><field name="b"><value>1</value></field></field><field name="c"><value/></field></fields></xfdf>'
    assert forms.read_records(xfdf, "xfdf") == [{"a.b": "1", "c": ""}]
    assert forms.read_records(r"<< /Fields [ << /T (na\)me) /V (v) >> << /T (x) /V /On >> ] >>", "fdf") == [{"na)me": "v", "x": "On"}]
    assert forms.read_records('[{"a": 1}, {"a": null}]', "json") == [{"a": "1"}, {"a": ""}]
    assert forms.read_records("a,b\n'=1,x\n", "csv") == [{"a": "=1", "b": "x"}]
    for bad in ("a,a\n1,2", "a,\n1,2"):
        with pytest.raises(forms.FormError):
            forms.read_records(bad, "csv")
    with pytest.raises(forms.FormError):
        forms.read_xfdf("<!DOCTYPE x><xfdf/>")


def test_small_readers():
    assert forms.read_css("COLOR: red; color: blue; width: 3px; line-height: 2; font-size: 9pt; color: url(x:y)") == {"color": "blue", "font-size": "9pt", "line-height": "2"}
    assert forms.read_svg("<svg xmlns='http://www.w3.org/2000/svg'><title>T</title><script/></svg>") == {"title": "T", "elements": 3, "active": 1}
    assert forms.json_depth('{"a": ["[[[", {"b": "\\"]"}]}') == 3
    words = forms.read_hocr("<p class='ocr_par' title='x'><span class='ocr_line' title='y'><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 90'>Hi</span></span></p>")
    assert words == [{"text": "Hi", "x0": 1, "y0": 2, "x1": 3, "y1": 4, "confidence": 90.0, "line": 0, "paragraph": 0}]


def test_records(spark):
    df = spark.createDataFrame([(bytearray(b"junk"),), (None,)], "b binary")
    assert [r.u for r in df.select(D.unpacked_stream("b").alias("u")).collect()] == [None, None]
    fields = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id long, parent long, part string")
    assert {r.id: r.name for r in D.dotted_names(fields).collect()} == {1: "a", 2: "a.b", 3: "a.b.c"}


def test_list_overlaps_take_each_list_once(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["a", "c"], ["x"]], [["a", "b", "c"], ["c", "q"]])], "doc long, a array<array<string>>, b array<array<string>>")
    got = [(r.reference, r.found, r.share) for r in list_overlaps(df).orderBy("reference").collect()]
    assert got == [(0, 0, 1.0), (1, 1, 0.5), (2, None, 0.0)]


def test_drafts():
    got = draft("Split the file every 3 pages, rotate by 90 degrees and redact emails, then convert to docx")
    assert [(s["tool"], s["params"]) for s in got["steps"]] == [("split", {"every": 3}), ("rotate", {"angle": 90}), ("redact", {"preset": "email"}), ("convert", {"to": "docx"})]
    with pytest.raises(ValueError, match="no tool"):
        draft("hello")


def test_only_text_nodes_are_rewritten():
    assert rewritten('{"text":"a","id":"b","items":[{"text":"c"},{"text":{"text":"d"}}]}', str.upper) == '{"text":"A","id":"b","items":[{"text":"C"},{"text":{"text":"D"}}]}'
