"""The HTML reader: blocks, inline runs, links and metadata of a page, from one parse.

The standard library's tokenizer does the lexing; the tree rules that pages rely on are here: implied ends of paragraphs, list
items, cells and rows, void and raw-text elements, formatting that is reopened in the next paragraph, and white space that is
collapsed across inline tags. One pass over a page yields all its rows as arrays, so pages are parsed once, in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = frozenset("a b code em i s small strike strong sub sup u".split())
STYLE = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "s": "s", "strike": "s", "del": "s", "code": "code", "sub": "sub", "sup": "sup"}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("script style template noscript iframe object embed svg button select textarea input canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
#: Nesting of elements, and elements of a page, at most.
MOST_DEPTH, MOST_NODES = 1024, 1_000_000
# Roles by which footnotes are told.
NOTE_REF, NOTES, BACKLINK = "doc-noteref", ("doc-footnote", "doc-endnote"), "doc-backlink"
_DATA = re.compile(r"(?is)^data:([a-z0-9.+-]+/[a-z0-9.+-]+)?((?:;[^,;]*)*),(.*)$")


class PageError(ValueError):
    pass

SCHEMA = (
    "page_id long, title string, lang string, blocks array<struct<ord:int,kind:string,level:int,path:string,text:string,ordered:boolean,checked:boolean,note:string>>,"
    " links array<struct<ord:int,href:string,text:string,allowed:boolean>>, cells array<struct<tab:int,r:int,c:int,header:boolean,rowspan:int,colspan:int,text:string>>,"
    " images int, warnings array<string>, keywords array<string>, authors array<string>, description string,"
    " math array<string>, note_refs array<string>, assets array<struct<ord:int,media:string,bytes:int,digest:string,alt:string,url:string>>, error string"
)
_ALLOWED = re.compile(r"(?i)^(#|(https?|mailto):)")


class Page(HTMLParser):
    """The rows of one page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.description = None, None, None
        self.authors: list[str] = []
        self.keywords: list[str] = []
        self.blocks: list[dict] = []
        self.links: list[dict] = []
        self.cells: list[dict] = []
        self.images, self.tables = 0, 0
        self.warnings: list[str] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.skipping, self.in_title, self.pre, self.paragraphs = 0, False, 0, 0
        self.grid: list[dict] = []
        self.math: list[str] = []
        self.formula: list[str] | None = None  # what stands in <math>, from its TeX annotation on if it has one
        self.annotated = False
        self.note_refs: list[str] = []
        self.notes: list[tuple[int, str]] = []  # open footnotes: place in the stack, identifier
        self.assets: list[dict] = []
        self.checked: bool | None = None
        self.quiet, self.nodes, self.endnotes = 0, 0, 0
        self.feed(html.removeprefix("﻿"))
        self.close()
        self._flush()

    def _warn(self, kind: str) -> None:
        if kind not in self.warnings:
            self.warnings.append(kind)

    def _kind(self) -> tuple[str, int | None]:
        if self.notes:
            return "footnote", None
        for tag in reversed(self.stack):
            if tag in HEADINGS:
                return "heading", int(tag[1])
            if tag in ("li", "blockquote", "pre", "figcaption", "caption"):
                return {"li": "list_item", "blockquote": "quote", "pre": "code"}.get(tag, tag), None
            if tag in ("td", "th"):
                return "cell", None
        return "paragraph", None

    def _flush(self) -> None:
        if not self.text:
            return
        raw = "".join(self.text)
        self.text = []
        text = raw.strip("\n") if self.pre else re.sub(r" *\v *", "\n", re.sub(r"[ \t\r\n\f]+", " ", raw)).strip()
        if not text.strip():
            return
        kind, level = self._kind()
        if kind == "cell" and self.grid:
            cell = self.grid[-1].get("cell")
            if cell is not None:
                cell["text"] = (cell["text"] + " " + text).strip()
            return
        path = "/".join(t for t in self.stack if t in BLOCKS)
        ordered = next((t == "ol" for t in reversed(self.stack) if t in ("ol", "ul")), None) if kind == "list_item" else None
        self.blocks.append({"ord": len(self.blocks), "kind": kind, "level": level, "path": path, "text": text, "ordered": ordered, "checked": self.checked, "note": self.notes[-1][1] if self.notes else None})
        self.checked = None

    def _close_to(self, at: int) -> None:
        """End all open elements from place `at`; formatting elements that were open inside stay open behind."""
        self._flush()
        kept = [t for t in self.stack[at + 1 :] if t in FORMATTING and t != "a"]
        for tag in self.stack[at:]:
            self._left(tag)
        self.stack[at:] = kept
        while self.notes and self.notes[-1][0] >= at:
            self.notes.pop()
        if self.endnotes > at:
            self.endnotes = 0

    def _left(self, tag: str) -> None:
        if tag == "pre":
            self.pre -= 1
        elif tag == "p":
            self.paragraphs -= 1
        elif tag == "table" and self.grid:
            table = self.grid.pop()
            for cell in table["cells"]:
                self.cells.append({"tab": table["n"], **cell})

    def _end_nearest(self, names: set[str] | frozenset[str], until: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] in names:
                self._close_to(i)
                return
            if self.stack[i] in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise PageError("too many elements")
        if self.formula is not None:
            if tag == "annotation" and "tex" in given.get("encoding", "").lower():
                self.formula, self.annotated = [], True
            return
        if tag == "math" and not self.skipping:
            self.formula, self.annotated = [], False
            return
        if tag == "input" and given.get("type", "").lower() == "checkbox" and "li" in self.stack and not self.skipping:
            self.checked = "checked" in given
            return
        if self.skipping:
            self.skipping += tag not in VOID
            return
        if tag in DROPPED:
            self._warn(f"unsupported_node:{tag}")
            self.skipping += tag not in VOID
            return
        if tag == "html":
            self.lang = given.get("lang", "").strip() or None
        elif tag == "title":
            self.in_title = True
            self.title = "" if self.title is None else self.title
            return
        elif tag == "meta":
            self._meta(given)
            return
        elif tag == "br":
            self.text.append("\n" if self.pre else "\v")
            return
        elif tag == "hr":
            self._flush()
            self._warn("unsupported_node:hr")
            return
        elif tag == "img":
            self.images += 1
            self._asset(given)
            return
        if tag in VOID:
            return
        if tag in BLOCKS:
            if self.paragraphs:
                self._end_nearest({"p"}, {"td", "th", "table"})
            if tag in CLOSES:
                self._end_nearest(CLOSES[tag], SCOPE[tag])
            if tag in HEADINGS:
                self._end_nearest(HEADINGS, {"table", "div", "section", "article"})
            self._flush()
            self._table_part(tag, given)
            self.pre += tag == "pre"
        elif tag == "a":
            if "a" in self.stack:
                self._leave_link()
            href, role = given.get("href"), given.get("role", "")
            if role == NOTE_REF and (href or "").startswith("#"):
                self.note_refs.append(href[1:])
            if role in (NOTE_REF, BACKLINK):
                self.quiet = len(self.stack) + 1
            elif href is not None:
                self.links.append({"ord": len(self.links), "href": href, "text": None, "allowed": bool(_ALLOWED.match(href)) and href == href.strip(), "at": len(self.text)})
                if not self.links[-1]["allowed"]:
                    self._warn("link_dropped")
        if len(self.stack) >= MOST_DEPTH:
            raise PageError("elements are nested too deeply")
        if given.get("role") == "doc-endnotes":
            self.endnotes = len(self.stack) + 1
        if given.get("id") and (given.get("role") in NOTES or self.endnotes and tag == "li"):
            self._flush()
            self.notes.append((len(self.stack), given["id"]))
        self.stack.append(tag)
        self.paragraphs += tag == "p"

    def _asset(self, given: dict) -> None:
        """An embedded image with its bytes' digest, or one that stays a link."""
        source = given.get("src", "").strip()
        row = {"ord": len(self.assets), "media": None, "bytes": None, "digest": None, "alt": given.get("alt", ""), "url": source or None}
        if m := _DATA.match(source):
            try:
                raw = base64.b64decode(unquote_to_bytes(m[3]), validate=True) if m[2].lower().endswith(";base64") else unquote_to_bytes(m[3])
            except ValueError:
                self._warn("invalid_asset")
            else:
                row |= {"media": (m[1] or "text/plain").lower(), "bytes": len(raw), "digest": hashlib.sha256(raw).hexdigest(), "url": None}
        self.assets.append(row)

    def _meta(self, given: dict) -> None:
        name, content = given.get("name", "").lower(), given.get("content", "").strip()
        if not content:
            return
        if name == "author":
            self.authors.append(content)
        elif name == "description":
            self.description = content
        elif name == "keywords":
            self.keywords += [k.strip() for k in content.split(",") if k.strip()]

    def _table_part(self, tag: str, given: dict) -> None:
        if tag == "table":
            self.grid.append({"n": self.tables, "r": -1, "c": 0, "cells": [], "taken": set()})
            self.tables += 1
        elif self.grid and tag == "tr":
            self.grid[-1]["r"] += 1
            self.grid[-1]["c"] = 0
        elif self.grid and tag in ("td", "th"):
            grid = self.grid[-1]
            span = {k: max(1, min(1024, int(given[k]) if given.get(k, "").isdigit() else 1)) for k in ("rowspan", "colspan")}
            while (grid["r"], grid["c"]) in grid["taken"]:
                grid["c"] += 1
            for r in range(span["rowspan"]):
                for c in range(span["colspan"]):
                    grid["taken"].add((grid["r"] + r, grid["c"] + c))
            grid["cell"] = {"r": grid["r"], "c": grid["c"], "header": tag == "th", **span, "text": ""}
            grid["cells"].append(grid["cell"])
            grid["c"] += span["colspan"]

    def _leave_link(self) -> None:
        link = next((x for x in reversed(self.links) if x["text"] is None), None)
        if link is not None:
            link["text"] = " ".join("".join(self.text[min(link["at"], len(self.text)) :]).split())

    def handle_endtag(self, tag: str) -> None:
        if self.formula is not None:
            if tag == "annotation" and self.annotated:
                self.annotated = None  # the rest of the formula is not TeX
            elif tag == "math":
                tex = " ".join("".join(self.formula).split())
                self.formula = None
                self.math.append(tex)
                self.text.append(tex)
            return
        if self.quiet and tag == "a":
            self.quiet = 0
        if self.skipping:
            self.skipping -= tag not in VOID
            return
        if tag == "title":
            self.in_title = False
        elif tag == "a" and "a" in self.stack:
            self._leave_link()
            self.stack.pop(len(self.stack) - 1 - self.stack[::-1].index("a"))
        elif tag in FORMATTING and tag in self.stack:
            self.stack.pop(len(self.stack) - 1 - self.stack[::-1].index(tag))
        elif tag == "p" and "p" not in self.stack:
            self._flush()
        elif tag in self.stack:
            self._close_to(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if self.formula is not None:
            if self.annotated is not None:
                self.formula.append(data)
        elif self.in_title:
            self.title += data
        elif self.quiet:
            return
        elif not self.skipping:
            self.text.append(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))

    def row(self) -> dict:
        links = [{k: (v if k != "text" else v or "") for k, v in x.items() if k != "at"} for x in self.links]
        return {
            "title": None if self.title is None else " ".join(self.title.split()) or None, "lang": self.lang, "blocks": self.blocks, "links": links,
            "cells": self.cells, "images": self.images, "warnings": self.warnings, "keywords": self.keywords, "authors": self.authors, "description": self.description, "math": self.math, "note_refs": self.note_refs, "assets": self.assets,
        }


def _read(html: str) -> dict:
    try:
        return {**Page(html).row(), "error": None}
    except PageError as fault:
        return {**Page("").row(), "error": str(fault)}


def read_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page with its blocks, links, cells, formulas, footnotes, images and metadata. A page beyond the limits has an
    error and nothing else. Equal pages of a batch are parsed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [x or "" for x in frame["html"]]
            found = {x: _read(x) for x in dict.fromkeys(texts)}
            rows = [{"page_id": k, **found[x]} for k, x in zip(frame["page_id"], texts, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")).mapInPandas(run, SCHEMA)
