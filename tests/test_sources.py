import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.operators.tables import csv_lines, grids, placed, text_of_blocks
from sheaf.sources import formats, html
from sheaf.sources.csv import parsed, read_csv
from sheaf.sources.html import Page, read_html
from sheaf.sources.mail import FrontMatterError, front_matter, read_mail
from sheaf.sources.text import text_blocks


def blocks(html):
    return [(b["kind"], b["text"]) for b in Page(html).row()["blocks"]]


def test_white_space():
    assert blocks("<p>   Hello \t\n  world  !   </p>") == [("paragraph", "Hello world !")]
    assert blocks("<b>a </b> b") == [("paragraph", "a b")]


def test_implied_ends():
    assert blocks("<ul><li>a<li>b</ul><p>c<p>d<div>e</div>f") == [("list_item", "a"), ("list_item", "b"), ("paragraph", "c"), ("paragraph", "d"), ("paragraph", "e"), ("paragraph", "f")]
    assert blocks("<p><b>x<br><p>y</p>") == [("paragraph", "x"), ("paragraph", "y")]
    assert blocks("<h1>t<h2>u</h2>") == [("heading", "t"), ("heading", "u")]


def test_raw_text_and_dropped_elements():
    row = Page("<style>p{}</style><script>var t='</p>';</script><p>x</p><iframe src=a></iframe><hr>").row()
    assert [b["text"] for b in row["blocks"]] == ["x"]
    assert row["warnings"] == ["unsupported_node:style", "unsupported_node:script", "unsupported_node:iframe", "unsupported_node:hr"]
    assert blocks("<pre>a  b\n c</pre>") == [("code", "a  b\n c")]


def test_metadata_and_links():
    row = Page('<html lang="de"><title> A  b </title><meta name=author content=X><meta name=keywords content="a, b"><a href="/r">r</a><a href="http://x">y z</a>').row()
    assert (row["lang"], row["title"], row["authors"], row["keywords"]) == ("de", "A b", ["X"], ["a", "b"])
    assert [(x["text"], x["allowed"]) for x in row["links"]] == [("r", False), ("y z", True)]
    assert "link_dropped" in row["warnings"]


def test_tables():
    cells = Page("<table><tr><th>x<td rowspan=2>y<tr><td>z<tr><td colspan=2>w</table>").row()["cells"]
    assert placed(cells) == [["x", "y"], ["z", ""], ["w", ""]]
    assert [c["header"] for c in cells] == [True, False, False, False]


def test_grid_frames(spark):
    rows = [(1, 0, 0, 1, 2, "=a"), (1, 1, 0, 1, 1, 'b"'), (1, 1, 1, 1, 1, "c")]
    grid = grids(spark.createDataFrame(rows, "t long, r int, c int, rowspan int, colspan int, text string"), "t")
    assert csv_lines(grid, "t").first().csv == "'=a,\r\n\"b\"\"\",c"


def test_html_frames(spark):
    df = spark.createDataFrame([(1, "<h1>a</h1><p>b"), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r for r in read_html(df).select("page_id", F.size("blocks").alias("n"), text_of_blocks(F.col("blocks")).alias("t")).collect()}
    assert [got[i].n for i in (1, 2, 3)] == [2, 0, 0] and got[1].t == "# a\n\nb"


def test_text_reader(spark):
    df = spark.createDataFrame([(1, "﻿First line 1  \r\nline 2\n\n\n\nSecond.  "), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.ord, r.text, r.lines) for r in text_blocks(df).orderBy("ord").collect()] == [(1, 0, "First line 1\nline 2", 2), (1, 1, "Second.", 1)]


def test_csv(spark):
    assert parsed('a;b\n"x;y"\n\n1;2;3', ";") == [["a", "b", ""], ["x;y", "", ""], ["1", "2", "3"]]
    df = spark.createDataFrame([(1, "Name,Age,City\nA,1,X\nB,2"), (2, None)], "id long, body string")
    got = read_csv(df, "id", "body").orderBy("r").collect()
    assert [(r.columns, r.header, r.cells) for r in got] == [(3, True, ["Name", "Age", "City"]), (3, False, ["A", "1", "X"]), (3, False, ["B", "2", ""])]


def test_mail():
    source = (
        "From: a@x\nTo: b@x\nSubject: S‮ubject\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>Hi <b>you</b></p>\n"
        "--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=n.txt\n\n12345\n--B--\n"
    )
    got = read_mail(source)
    assert got["body"] == "Hi you" and got["subject"] == "Subject" and got["attachments"] == [{"name": "n.txt", "size": 5}]


def test_front_matter():
    meta, warnings, rest = front_matter("---\ntitle: 'A: b'\nkeywords: [x, y]\nauthors:\n  - P\n  - Q\nodd: 1\n---\nbody")
    assert meta == {"title": "A: b", "keywords": ["x", "y"], "authors": ["P", "Q"]} and warnings == ["unknown key odd"] and rest == "body"
    assert front_matter("no matter") == ({}, [], "no matter")
    with pytest.raises(FrontMatterError):
        front_matter("---\ntitle: &a x\n---\n")


def test_formats(spark):
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("[Content_Types].xml", "")
        z.writestr("xl/workbook.xml", "")
    cases = [(package.getvalue(), "a.bin", "xlsx"), (b"%PDF-1.7", "a.txt", "pdf"), (b"\xef\xbb\xbf <!doctype HTML>", "a", "html"), (b"<svg xmlns='x'>", "a.md", "markdown"),
             (b"<svg xmlns='x'>", "a.x", "svg"), (b"plain", "A.CSV", "csv"), (b"plain", "a", None), (b"RIFF1234WEBPVP8", "a", "webp")]
    df = spark.createDataFrame([(bytearray(c), n) for c, n, _ in cases], "content binary, name string")
    assert [r.f for r in df.select(formats.classify(F.col("content"), F.col("name")).alias("f")).collect()] == [f for _, _, f in cases]


def test_equal_pages_are_parsed_once(spark, monkeypatch):
    pages = pd.DataFrame({"page_id": range(50), "html": ["<p>a", "<div>" * 1100] * 25})
    seen = []
    monkeypatch.setattr(html, "_read", lambda x, read=html._read: seen.append(x) or read(x))

    class Pages:  # a frame that is worked off in this process
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return pd.concat(run([pages]))

    found = html.read_html(Pages())
    assert len(seen) == 2 and found["page_id"].tolist() == list(range(50))
    assert found["error"].tolist() == [None, "elements are nested too deeply"] * 25
    assert [[b["text"] for b in x] for x in found["blocks"]] == [["a"], []] * 25
