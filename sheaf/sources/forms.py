"""Form values and recognised text from interchange files: XFDF, FDF, JSON, CSV and hOCR; inline CSS and SVG titles."""

from __future__ import annotations

import csv
import io
import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FormError(ValueError):
    pass


def _unguarded(value: str) -> str:
    """A CSV cell without the apostrophe that keeps spreadsheets from reading a formula."""
    return value[1:] if re.match(r"^'[=+\-@\t\r]", value) else value


def read_xfdf(source: str) -> dict[str, str]:
    if "<!DOCTYPE" in source or "<!ENTITY" in source:
        raise FormError("document types are not read")
    out: dict[str, str] = {}

    def visit(node: ElementTree.Element, names: list[str]) -> None:
        for child in node:
            tag = child.tag.rpartition("}")[2]
            if tag == "field":
                visit(child, [*names, child.get("name", "")])
            elif tag == "value" and names:
                out[".".join(names)] = child.text or ""
            elif tag == "fields":
                visit(child, names)

    visit(ElementTree.fromstring(source), [])
    return out


def read_fdf(source: str) -> dict[str, str]:
    text = r"\(((?:\\.|[^\\()])*)\)"
    pairs = re.findall(rf"/T\s*{text}\s*/V\s*(?:{text}|/(\w+))", source)
    return {re.sub(r"\\(.)", r"\1", t): re.sub(r"\\(.)", r"\1", v) or name for t, v, name in pairs}


def read_records(source: str, kind: str) -> list[dict[str, str]]:
    """All records of a file; names are unique and not empty."""
    if kind == "xfdf":
        return [read_xfdf(source)]
    if kind == "fdf":
        return [read_fdf(source)]
    if kind == "json":
        found = json.loads(source)
        return [{str(k): "" if v is None else str(v) for k, v in r.items()} for r in (found if isinstance(found, list) else [found])]
    rows = list(csv.reader(io.StringIO(source.removeprefix("﻿"), newline="")))
    names = rows[0] if rows else []
    if len(set(names)) < len(names) or "" in names:
        raise FormError("names of columns are missing or come twice")
    return [dict(zip(names, map(_unguarded, r), strict=False)) for r in rows[1:] if r]


_RECORDS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


@F.pandas_udf(_RECORDS)
def records(source: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([[] if s is None else read_records(s, k) for s, k in zip(source, kind, strict=True)])


def read_hocr(source: str) -> list[dict]:
    """Words with their boxes, confidence, line and paragraph."""
    out, line, paragraph = [], -1, -1
    for m in re.finditer(r"<(?:span|p|div)\b[^>]*class=['\"](ocr_par|ocr_line|ocrx_word)['\"][^>]*title=['\"]([^'\"]*)['\"][^>]*>([^<]*)", source):
        if m[1] == "ocr_par":
            paragraph += 1
        elif m[1] == "ocr_line":
            line += 1
        else:
            box = re.search(r"bbox (\d+) (\d+) (\d+) (\d+)", m[2])
            sure = re.search(r"x_wconf (\d+(?:\.\d+)?)", m[2])
            if box:
                x0, y0, x1, y1 = map(int, box.groups())
                out.append({"text": m[3].strip(), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "confidence": float(sure[1]) if sure else None, "line": line, "paragraph": paragraph})
    return out


# Properties that inline styles may set.
CSS = ("color", "background-color", "font-size", "font-weight", "font-style", "font-family", "text-align", "text-decoration", "line-height", "margin-left")


def read_css(style: str) -> dict[str, str]:
    """Allowed declarations of a style attribute, the last of each; line-height comes last. Anything that could escape is dropped."""
    out: dict[str, str] = {}
    for part in style.split(";"):
        name, _, value = (x.strip() for x in part.partition(":"))
        name = name.lower()
        if name in CSS and value and value.lower() != "inherit" and not re.search(r"[\\@{}<>!:\x00-\x1f\x7f]", value):
            out.pop(name, None)
            out[name] = value
    if "line-height" in out:
        out["line-height"] = out.pop("line-height")
    return out


def read_svg(source: str) -> dict:
    """The title of an SVG image; other XML is an error."""
    if "<!DOCTYPE" in source or "<!ENTITY" in source:
        raise FormError("document types are not read")
    root = ElementTree.fromstring(source)
    if root.tag.rpartition("}")[2] != "svg":
        raise FormError("no SVG image")
    title = next((x.text for x in root.iter() if x.tag.rpartition("}")[2] == "title"), None)
    scripts = sum(x.tag.rpartition("}")[2] in ("script", "foreignObject") or any(k.lower().startswith("on") for k in x.attrib) for x in root.iter())
    return {"title": title, "elements": sum(1 for _ in root.iter()), "active": scripts}


def json_depth(source: str) -> int:
    """Nesting of brackets outside strings."""
    depth = most = 0
    quoted = escaped = False
    for c in source:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most
