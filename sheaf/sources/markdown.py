"""The Markdown reader and the writers of blocks: Markdown and HTML.

The reader takes front matter, ATX and setext headings, fenced and indented code, quotes, nested lists with task boxes, pipe tables,
footnotes, rules and raw HTML blocks, and turns inline marks into plain text with links listed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.sources.mail import FrontMatterError, front_matter

_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(?:\[([ xX])\]\s+)?(.*)$")
_FENCE = re.compile(r"^(`{3,}|~{3,})\s*([\w+-]*)\s*$")
_LINK = re.compile(r"!?\[([^\]]*)\]\(([^()\s]*(?:\([^()]*\))?[^()\s]*)(?:\s+\"[^\"]*\")?\)")
_MARK = re.compile(r"(\*\*|__|~~|\*|(?<!\w)_(?=\S)|(?<=\S)_(?!\w)|`)")

BLOCK = T.StructType(
    [T.StructField(n, k) for n, k in (("ord", T.IntegerType()), ("kind", T.StringType()), ("level", T.IntegerType()), ("text", T.StringType()),
     ("lang", T.StringType()), ("checked", T.BooleanType()), ("ordered", T.BooleanType()), ("rows", T.ArrayType(T.ArrayType(T.StringType()))))]
)
DOCUMENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("links", T.ArrayType(T.StringType()))])


def plain(text: str, links: list[str]) -> str:
    """Inline Markdown as text; link targets are added to links."""

    def link(m: re.Match) -> str:
        links.append(m[2])
        return m[1]

    text = _LINK.sub(link, text)
    text = re.sub(r"<(https?://[^>\s]+)>", lambda m: links.append(m[1]) or m[1], text)
    text = re.sub(r"\[\^([^\]]+)\]", "", text)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!-])", r"\1", _MARK.sub("", text)).strip()


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def read_markdown(source: str) -> dict:
    warnings: list[str] = []
    try:
        meta, warnings, body = front_matter(source)
    except FrontMatterError as e:
        meta, warnings, body = {}, [str(e)], source
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    blocks: list[dict] = []
    links: list[str] = []
    notes: list[dict] = []

    def add(kind: str, text: str, **more) -> None:
        target = notes if kind == "footnote" else blocks
        target.append({"ord": 0, "kind": kind, "level": None, "text": text, "lang": None, "checked": None, "ordered": None, "rows": None, **more})

    i, held = 0, []

    def flush() -> None:
        if held:
            text = plain(re.sub(r" {2,}\n|\\\n", "\v", "\n".join(held)).replace("\n", " ").replace("\v", "\n"), links)
            if text:
                add("paragraph", text)
            held.clear()

    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line.strip()):
            flush()
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            add("code", "".join(x + "\n" for x in lines[i + 1 : end]), lang=m[2] or None)
            i = end + 1
            continue
        if m := re.match(r"^ {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$", line):
            flush()
            add("heading", plain(m[2] or "", links), level=len(m[1]))
        elif held and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            text = plain(" ".join(held), links)
            held.clear()
            add("heading", text, level=1 if "=" in line else 2)
        elif re.match(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            flush()
            add("rule", "")
        elif m := re.match(r"^\[\^([^\]]+)\]:\s*(.*)$", line):
            flush()
            add("footnote", plain(m[2], links))
        elif line.lstrip().startswith(">"):
            flush()
            quoted = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                quoted.append(re.sub(r"^\s*>\s?", "", lines[i]))
                i += 1
            add("quote", plain(" ".join(quoted), links))
            continue
        elif m := _ITEM.match(line):
            flush()
            text = [m[4]]
            while i + 1 < len(lines) and lines[i + 1].strip() and not _ITEM.match(lines[i + 1]) and lines[i + 1].startswith("  "):
                i += 1
                text.append(lines[i].strip())
            add("list_item", plain(" ".join(text), links), level=len(m[1]) // 2 + 1, checked=None if m[3] is None else m[3] != " ", ordered=m[2][0].isdigit())
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "-" in lines[i + 1]:
            flush()
            rows = [_cells(line)]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(_cells(lines[i]))
                i += 1
            width = len(rows[0])
            add("table", "", rows=[[plain(c, links) for c in (r + [""] * width)[:width]] for r in rows])
            continue
        elif not held and line.startswith("    ") and line.strip():
            end = next((k for k in range(i, len(lines)) if lines[k].strip() and not lines[k].startswith("    ")), len(lines))
            add("code", "\n".join(x[4:] for x in lines[i:end]).rstrip("\n") + "\n")
            i = end
            continue
        elif not held and re.match(r"^<(?:[a-zA-Z!/])", line):
            end = next((k for k in range(i, len(lines)) if not lines[k].strip()), len(lines))
            add("raw", "\n".join(lines[i:end]))
            i = end
            continue
        elif line.strip():
            held.append(line.lstrip() if not line.endswith("  ") else line.lstrip())
        else:
            flush()
        i += 1
    flush()
    blocks += notes
    for n, b in enumerate(blocks):
        b["ord"] = n
    title = meta.get("title") or next((b["text"] for b in blocks if b["kind"] == "heading" and b["level"] == 1), None)
    return {"title": title, "warnings": warnings, "blocks": blocks, "links": links}


@F.pandas_udf(DOCUMENT)
def markdown(source: pd.Series) -> pd.DataFrame:
    rows = [read_markdown(x) if x is not None else {"title": None, "warnings": [], "blocks": [], "links": []} for x in source]
    return pd.DataFrame(rows, columns=["title", "warnings", "blocks", "links"])


def write_markdown(blocks: list[dict]) -> str:
    """Blocks as Markdown that reads back to the same blocks."""
    out = []
    for b in blocks:
        text = re.sub(r"([\\`*_\[\]])", r"\\\1", b["text"] or "")
        if b["kind"] == "heading":
            out.append("#" * (b["level"] or 1) + " " + text)
        elif b["kind"] == "code":
            out.append(f"```{b.get('lang') or ''}\n{b['text']}```")
        elif b["kind"] == "quote":
            out.append("> " + text.replace("\n", "\n> "))
        elif b["kind"] == "list_item":
            box = "" if b.get("checked") is None else f"[{'x' if b['checked'] else ' '}] "
            out.append("  " * ((b.get("level") or 1) - 1) + ("1. " if b.get("ordered") else "- ") + box + text)
        elif b["kind"] == "table":
            head, *rest = [["" if c is None else c.replace("|", "\\|") for c in r] for r in b["rows"]]
            out.append("\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rest]))
        elif b["kind"] == "rule":
            out.append("---")
        elif b["kind"] == "raw":
            out.append(b["text"])
        else:
            out.append(text.replace("\n", "  \n"))
    return "\n\n".join(out) + "\n"


def write_html(blocks: list[dict], title: str | None = None) -> str:
    """Blocks as an HTML page, everything escaped."""

    def esc(x: str | None) -> str:
        return (x or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    out, listed = [], None
    for b in [*blocks, {"kind": None}]:
        kind = ("ol" if b.get("ordered") else "ul") if b["kind"] == "list_item" else None
        if listed != kind:
            out += [f"</{listed}>"] * bool(listed) + [f"<{kind}>"] * bool(kind)
            listed = kind
        if b["kind"] is None:
            break
        if b["kind"] == "heading":
            out.append(f"<h{b['level'] or 1}>{esc(b['text'])}</h{b['level'] or 1}>")
        elif b["kind"] == "list_item":
            out.append(f"<li>{esc(b['text'])}</li>")
        elif b["kind"] == "code":
            name = f' class="language-{esc(b["lang"])}"' if b.get("lang") else ""
            out.append(f"<pre><code{name}>{esc(b['text'])}</code></pre>")
        elif b["kind"] == "quote":
            out.append(f"<blockquote><p>{esc(b['text'])}</p></blockquote>")
        elif b["kind"] == "table":
            rows = ["<tr>" + "".join(f"<{t}>{esc(c)}</{t}>" for c in r) + "</tr>" for t, r in zip(["th", *["td"] * len(b["rows"])], b["rows"], strict=False)]
            out.append("<table>" + "".join(rows) + "</table>")
        elif b["kind"] != "rule":
            out.append("<p>" + esc(b["text"]).replace("\n", "<br>") + "</p>")
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{esc(title) or 'Document'}</title></head><body>" + "".join(out) + "</body></html>"
