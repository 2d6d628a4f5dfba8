"""The e-mail reader and the front matter of Markdown files."""

from __future__ import annotations

import re
from email import message_from_bytes
from email.policy import default

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import BIDI
from sheaf.sources.html import Page

_NAMES = ("from", "to", "cc", "date", "subject")
MAIL = T.StructType(
    [T.StructField(n, T.StringType()) for n in (*_NAMES, "body")]
    + [T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType())])))]
)
_NO_BIDI = dict.fromkeys(map(ord, BIDI))


def read_mail(source: str) -> dict:
    """Headers, the body (HTML before plain text) and the attachments' names and sizes."""
    message = message_from_bytes(source.encode(), policy=default)
    out = {n: None if message[n] is None else str(message[n]).translate(_NO_BIDI) for n in _NAMES}
    body = message.get_body(("html", "plain"))
    content = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        content = "\n".join(b["text"] for b in Page(content).row()["blocks"])
    files = [(a.get_filename() or "attachment", len(a.get_payload(decode=True) or b"")) for a in message.iter_attachments()]
    return out | {"body": content.strip().translate(_NO_BIDI), "attachments": [{"name": n, "size": s} for n, s in files]}


@F.pandas_udf(MAIL)
def mail(source: pd.Series) -> pd.DataFrame:
    rows = [read_mail(x) if x is not None else dict.fromkeys((*_NAMES, "body", "attachments")) for x in source]
    return pd.DataFrame(rows, columns=[f.name for f in MAIL])


class FrontMatterError(ValueError):
    pass


# The keys of front matter that become metadata.
KEYS = ("title", "author", "authors", "lang", "date", "subject", "keywords")


def front_matter(text: str, most: int = 65_536) -> tuple[dict, list[str], str]:
    """(metadata, warnings, rest). Scalars and lists of scalars are read; anchors, aliases and oversized blocks are errors."""
    m = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", text, re.DOTALL)
    if not m:
        return {}, [], text
    block, meta, warnings, key = m[1], {}, [], None
    if len(block.encode()) > most:
        raise FrontMatterError("front matter is too large")
    for line in block.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if re.match(r"^\s*(?:-\s+|[\w-]+:\s*)[&*]\w", line):
            raise FrontMatterError("anchors and aliases are not read")
        if (item := re.match(r"^\s*-\s+(.*)$", line)) and key:
            if isinstance(meta.get(key), list):
                meta[key].append(_scalar(item[1]))
            continue
        if pair := re.match(r"^([\w-]+):\s*(.*)$", line):
            key = pair[1].lower()
            if key not in KEYS:
                warnings.append(f"unknown key {key}")
                continue
            value = pair[2].strip()
            meta[key] = [] if not value else [_scalar(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value)
    return meta, warnings, text[m.end() :]


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text
