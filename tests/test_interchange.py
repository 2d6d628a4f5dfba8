"""Edge cases of document trees, packages, markup scalars, the registry and event streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.functions import markup as U
from sheaf.operators import checks as K
from sheaf.operators import editing as D
from sheaf.plans import registry as G
from sheaf.sources import formats, html
from sheaf.sources import interchange as I
from sheaf.streaming import queue as S


def package(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, "<styles/>")
    return out.getvalue()


def test_style_packages():
    assert I.styles_part(package("a.xml", "word/styles.xml")) == "<styles/>"
    assert I.styles_part(package("a.xml")) is None
    for names in (("../x",), ("/x",), ("a\\b",), ("c:x",), ("A.xml", "a.xml")):
        with pytest.raises(I.TreeError):
            I.styles_part(package(*names))


@pytest.mark.parametrize("version", ["x-ir/1", "sheaf-ir/2"])
def test_nested_blocks_have_paths(version):
    cell = {"blocks": [{"type": "paragraph", "id": "c", "content": [{"type": "text", "text": "in a cell"}]}]}
    tree = {
        "version": version, "meta": {"title": "T"},
        "body": [
            {"type": "list", "id": "l", "items": [{"blocks": [{"type": "code", "id": "x", "text": "a b"}]}]},
            {"type": "table", "id": "t", "head": [[cell]], "caption": [{"type": "image", "alt": "i", "target": {"url": "http://a"}}], "footnotes": []},
            {"type": "figure", "id": "f", "asset": {"url": "http://b"}, "caption": []},
        ],
        "furniture": [{"type": "paragraph", "id": "h", "content": [{"type": "math", "tex": "x^2"}]}],
    }
    found = I.read_ir(json.dumps(tree))
    rows = {b["path"]: (b["text"], b["linked_images"]) for b in found["blocks"]}
    assert found["title"] == "T"
    assert rows == {
        "body/0": ("", 0), "body/0/items/0/blocks/0": ("a b", 0), "body/1": ("i", 1), "body/1/head/0/cells/0/blocks/0": ("in a cell", 0),
        "body/2": ("", 1), "furniture/0": ("x^2", 0),
    }


def test_errors_are_columns(spark):
    sources = [(1, None), (2, "[]"), (3, "{"), (4, '{"version":"x-ir/2","body":7}'), (5, '{"version":"x-ir/2"}')]
    out = {r.id: r.d for r in spark.createDataFrame(sources, "id int, s string").select("id", I.ir()(F.col("s")).alias("d")).collect()}
    assert out[1].error is None and out[1].blocks is None and out[5].blocks == []
    assert out[2].error == "no document" and out[3].error == "no JSON" and out[4].error
    other = [(1, '{"schema_name":"x"}'), (2, '{"schema_name":"DoclingDocument","version":"2.0"}'), (3, '{"schema_name":"DoclingDocument","version":"1.1","body":{"children":[{"$ref":"x"}]}}')]
    out = {r.id: r.d for r in spark.createDataFrame(other, "id int, s string").select("id", I.layout()(F.col("s")).alias("d")).collect()}
    assert out[1].error == "no layout document" and out[2].error == "unsupported version" and out[3].dangling == 1


def test_layout_groups_tables_and_furniture():
    tree = {
        "schema_name": "DoclingDocument", "version": "1.2",
        "groups": [{"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}]}],
        "texts": [{"text": "item", "label": "list_item"}, {"text": "notes", "content_layer": "notes"}, {"text": "foot", "content_layer": "furniture"}],
        "tables": [{"data": {"grid": [[{"text": "a"}, {"text": "b"}]]}}],
        "body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/2"}]},
    }
    found = I.read_layout(json.dumps(tree))
    assert [(n["layer"], n["kind"], n["text"], n["depth"]) for n in found["nodes"]] == [("body", "text", "item", 2), ("body", "table", "a\tb", 1), ("furniture", "text", "foot", 1)]
    assert found["dangling"] == 0


def test_sheet_names():
    assert U.sheet_names(["a/b", "A_B", "", None, "'x'", "y" * 40, "Y" * 40]) == ["a_b", "A_B_2", "Table 3", "Table 4", "x", "y" * 31, "Y" * 29 + "_2"]


def test_sanitizer():
    assert U.sanitize("<b>x<i>y</b>z") == "<b>x<i>y</i></b>z"
    assert U.sanitize('<a href="javascript:x">a</a><a href="#f">b</a>') == '<a rel="noopener noreferrer">a</a><a href="#f" rel="noopener noreferrer">b</a>'
    assert U.sanitize("a &lt; b & c <script>d</script><style>e</style><!-- f --><object>g</object>") == "a &lt; b &amp; c g"
    assert U.sanitize("<td colspan=2 onclick=x>") == '<td colspan="2"></td>'


def test_asset_paths(spark):
    cases = {"a/./b.png": "a/b.png", "a/../b.png": "b.png", "../a": None, "a/../../b": None, "a%2F..%2F..%2Fb": None, "x?y": None, "": None, "c:/a": None, "a b.png": "a b.png", ".": None}
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    assert {r.h: r.p for r in df.select("h", K.asset_path(F.col("h")).alias("p")).collect()} == cases


def test_event_streams():
    text = "event: a\r\ndata: 1\rdata:2\n\n: c\nid: 7\n\nretry: x\nretry: 5\ndata\n\ndata: lost"
    assert S.parse_events(text) == [{"event": "a", "data": "1\n2", "id": None, "retry": None}, {"event": "message", "data": "", "id": "7", "retry": 5}]


def test_registry():
    tools = {t.id: t for t in G.TOOLS}
    assert len(tools) == len(G.TOOLS) and G.accepts(tools["ask"], "DOCX") and not G.accepts(tools["merge"], "docx")
    assert G.parameter_schema(tools["ask"]) == {
        "type": "object", "additionalProperties": False, "required": ["question"], "properties": {"question": {"type": "string"}, "max_citations": {"type": "integer"}},
    }
    assert G.parameter_schema(tools["booklet"]) == {"type": "object", "additionalProperties": False, "properties": {}}


def test_editing_html():
    blocks = D.read_blocks("<h1>A</h1><p>b <b>c</b></p><ul><li>d</ul>", "html")
    assert [(b["id"], b["text"]) for b in blocks] == [("b0", "A"), ("b1", "b c"), ("b2", "d")] and D.kept_share(blocks, "html") == 1.0
    with pytest.raises(ValueError):
        D.write_blocks(blocks, "pdf")


def test_html_parts():
    row = html.Page('<p>a <math><mi>x</mi></math> b<img src="data:image/gif;base64,@@"><img src="data:,hi"></p><aside role="doc-footnote" id="n">note</aside>c').row()
    assert row["math"] == ["x"] and row["blocks"][0]["text"] == "a x b" and row["warnings"] == ["invalid_asset"]
    assert [(a["media"], a["bytes"]) for a in row["assets"]] == [(None, None), ("text/plain", 2)]
    assert [(b["kind"], b["note"], b["text"]) for b in row["blocks"][1:]] == [("footnote", "n", "note"), ("paragraph", None, "c")]


def test_damaged_containers():
    assert formats.ole_streams(formats.OLE) == [] and formats.ole_streams(b"x") == []
    assert formats.compound(formats.OLE + bytes(600)) is None and formats.container(b"PK\x03\x04broken") is None
