"""Format classification of files by content, then by name."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Magic bytes and extensions.
MAGIC = (
    ("pdf", "^25504446 ?2D"), ("rtf", "^7B5C727466"), ("png", "^89504E470D0A1A0A"), ("jpeg", "^FFD8FF"), ("wpd", "^FF575043"),
    ("webp", "^52494646.{8}57454250"), ("tiff", "^(49492A00|4D4D002A)"), ("ole", "^D0CF11E0A1B11AE1"), ("zip", "^504B0304"),
)
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text", "csv": "csv", "tsv": "csv", "eml": "eml", "msg": "msg",
    "svg": "svg", "json": "json", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "epub": "epub", "odt": "odt", "ods": "ods", "odp": "odp",
}
_MAIN_PARTS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
_MIMETYPES = {
    "application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
}


def sniff(content: Column) -> Column:
    """The format that the first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern.replace(" ?", "")), name).otherwise(out)
    return out


def looks_like_html(content: Column) -> Column:
    text = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return text.rlike(r"(?i)^(?:ï»¿)?\s*(?:<!doctype html|<html)")


def looks_like_svg(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"(?is)^(?:ï»¿)?\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)?<svg\b")


def by_extension(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def container(content: bytes | None) -> str | None:
    """The format of a ZIP package: its stored mimetype entry, or its main part."""
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if names and names[0] == "mimetype":
                return _MIMETYPES.get(z.read("mimetype").decode("ascii", "replace").strip())
            if "[Content_Types].xml" in names:
                return next((kind for part, kind in _MAIN_PARTS if part in names), None)
    except (zipfile.BadZipFile, OSError):
        return None
    return None


# Streams of office files in the old container, mail first.
_STREAMS = (("__properties_version1.0", "msg"), ("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"))
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE = 0xFFFFFFFA  # numbers from here on name no sector


def ole_streams(content: bytes) -> list[str]:
    """Names in the directory of a compound file, whose sectors a table chains; damaged chains end where they break."""
    if not content.startswith(OLE) or len(content) < 512:
        return []
    size = 1 << min(int.from_bytes(content[30:32], "little"), 12)
    listed = struct.unpack("<109I", content[76:512])
    table = b"".join(content[(s + 1) * size : (s + 2) * size] for s in listed if s < _FREE)
    names, sector, seen = [], int.from_bytes(content[48:52], "little"), set()
    while sector < _FREE and sector not in seen:
        seen.add(sector)
        part = content[(sector + 1) * size : (sector + 2) * size]
        for i in range(0, len(part) - 127, 128):
            length = int.from_bytes(part[i + 64 : i + 66], "little")
            if 2 <= length <= 64:
                names.append(part[i : i + length - 2].decode("utf-16-le", "replace"))
        link = table[4 * sector : 4 * sector + 4]
        sector = int.from_bytes(link, "little") if len(link) == 4 else _FREE
    return names


def compound(content: bytes) -> str | None:
    """The format of a compound file by its streams."""
    names = {n.lower() for n in ole_streams(content)}
    return next((kind for stream, kind in _STREAMS if stream.lower() in names), None)


@F.pandas_udf(T.StringType())
def container_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else compound(x) if x.startswith(OLE) else container(x))


def looks_like_layout(content: Column) -> Column:
    """JSON that names the schema of layout documents near its begin."""
    return F.decode(F.substring(content, 1, 4096), "ISO-8859-1").rlike(r'(?s)^(?:ï»¿)?\s*\{.*"schema_name"\s*:\s*"DoclingDocument"')


def classify(content: Column, name: Column) -> Column:
    """Containers, magic bytes, layout JSON, HTML by its begin, then the extension; SVG content loses to the extension of a text."""
    magic = sniff(content)
    packed = magic.isin("zip", "ole")
    inside = F.when(packed, container_udf(F.when(packed, content)))
    named = by_extension(name)
    svg = F.when(looks_like_svg(content), F.when(named.isin("text", "markdown", "html"), named).otherwise("svg"))
    found = F.when(packed, F.coalesce(inside, named, magic)).otherwise(magic)
    return F.coalesce(found, svg, F.when(looks_like_layout(content), "layout_json"), F.when(looks_like_html(content), "html"), named)
