"""Scalars for writers and readers of markup: escapes, safe names, dates, number cells and the sanitizer of raw HTML."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a sheet's name.
SHEET_NAME = 31


def css_string(text: Column) -> Column:
    """A quoted CSS string; everything but letters, digits, blanks and hyphens is a hexadecimal escape."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    coded = F.transform(signs, lambda c: F.when(c.rlike(r"^[\p{L}\p{N} -]$"), c).otherwise(F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(c))), F.lit(" "))))
    return F.concat(F.lit('"'), F.array_join(coded, ""), F.lit('"'))


def percent_decoded(href: Column) -> Column:
    """A link without percent escapes; null where an escape is broken or the bytes are no UTF-8. A plus sign stays."""
    whole = ~href.rlike("%(?![0-9A-Fa-f]{2})")
    decoded = F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B")))
    return F.when(whole & ~F.contains(decoded, F.lit("�")), decoded)


def pdf_date(seconds: Column) -> Column:
    """Seconds since 1970 as the date of a document, in UTC; clamped to the years 1970 to 9999."""
    at = F.timestamp_seconds(F.greatest(F.least(seconds.cast("long"), F.lit(253_402_300_799)), F.lit(0)))
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.concat(F.lit("D:"), F.date_format(utc, "yyyyMMddHHmmss"), F.lit("Z"))


# Marks, units, currencies and months in cells of numbers.
_MARKS = r".,%()\-–—−+$€£¥/:"
_UNITS = "mg|g|kg|mm|cm|m|km|ml|l|kb|mb|gb|tb|ms|s|min|h"
_MONEY = "usd|eur|gbp|jpy|cny|vnd|aud|cad|chf|inr|krw"
_MONTHS = "january february march april may june july august september october november december".split()


def is_number_cell(text: Column) -> Column:
    """Whether a cell of a table is a number: digits and marks, a short word that begins with a digit, a number with a unit or a
    currency, or a date."""
    digits = rf"[{_MARKS}]*[0-9][0-9{_MARKS}]*"
    month = "|".join(f"{m}|{m[:3]}" for m in _MONTHS)
    forms = (
        rf"^[{_MARKS} ]*[0-9][0-9{_MARKS} ]*$", r"^[0-9][^ ]{0,7}$", rf"(?i)^\s*{digits}\s+(?:{_UNITS}|{_MONEY})\s*$", rf"(?i)^\s*(?:{_MONEY})\s+{digits}\s*$",
        rf"(?i)^\s*(?:0?[1-9]|[12][0-9]|3[01])\s+(?:{month})\.*\s+[0-9]{{4}}\s*$",
    )
    found = F.lit(False)
    for form in forms:
        found = found | text.rlike(form)
    return F.coalesce(found, F.lit(False))


def is_neutral_cell(text: Column) -> Column:
    """Punctuation alone, which marks a missing value."""
    return (text != "") & ~text.rlike(r"[\p{L}\p{N}]")


#: Cells that a column has at least to be judged, and the share that must show a feature.
CELLS, SHARE = 3, 0.6
#: Shares of the cells of a column that are relation symbols, and of all cells that end like statements of a program.
RELATIONS, STATEMENTS = 0.8, 0.4
_MARKER = r"^(?:[•◦▪‣·]|\(?(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)])(?:\s|$)"


def _said(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~is_neutral_cell(c) & (c != ""))


def column_is_numeric(cells: Column) -> Column:
    """Whether most of a column's cells that say something are numbers."""
    said = _said(cells)
    return (F.size(said) >= CELLS) & (F.size(F.filter(said, is_number_cell)) >= SHARE * F.size(said))


def aligned_layout(columns: Column) -> Column:
    """What aligned text is if it is no table: prose, labels, enumeration, code, equations or words; null for a table. columns:
    an array of columns, each an array of its filled cells."""

    def any_column(share: float, feature) -> Column:
        return F.exists(columns, lambda c: (F.size(c) >= CELLS) & (F.size(F.filter(c, feature)) >= share * F.size(c)))

    def phrase(cell: Column) -> Column:
        return F.size(F.regexp_extract_all(cell, F.lit(r"\p{L}{2,}"), F.lit(0))) >= 3

    cells = F.flatten(columns)
    code = F.size(F.filter(cells, lambda c: c.rlike(r"[;{}]\s*$") | c.rlike(r"^\s*(?://|/\*)"))) >= STATEMENTS * F.size(cells)
    return (
        F.when(any_column(SHARE, phrase), "prose")
        .when(any_column(SHARE, lambda c: c.endswith(":")), "labels")
        .when(any_column(SHARE, lambda c: c.rlike(_MARKER)), "enumeration")
        .when((F.size(cells) > 0) & code, "code")
        .when(any_column(RELATIONS, lambda c: c.rlike("^[=<>≤≥≈≠±]+$")) | any_column(SHARE, lambda c: c.rlike(r"^\([0-9]+(?:\.[0-9]+)*\)$")), "equations")
        .when(~F.exists(columns, column_is_numeric), "words")
    )


def sheet_base(name: str, place: int) -> str:
    clean = re.sub("[\\\\/?*:\\[\\]￾￿\x00-\x1f]", "_", name).strip().strip("'").strip()
    return clean[:SHEET_NAME].rstrip("'").strip() or f"Table {place}"


def sheet_names(names: list[str | None]) -> list[str]:
    """Names for the sheets of one workbook: safe, at most 31 characters, and told apart by numbers whatever their case."""
    used: set[str] = set()
    out = []
    for place, name in enumerate(names, 1):
        base = found = sheet_base(name or "", place)
        number = 2
        while found.lower() in used:
            end = f"_{number}"
            found = (base[: SHEET_NAME - len(end)].rstrip("'") or f"Table_{number}") + end
            number += 1
        used.add(found.lower())
        out.append(found)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sheet_names_of(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else sheet_names(list(x)))


# Elements and attributes that raw HTML may keep.
TAGS = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption"
    " figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li main map mark nav ol p pre q rp rt rtc ruby s samp small span strike strong"
    " sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
_EVERY = ("title", "lang", "dir")
_OWN = {
    "a": ("href", "hreflang"), "img": ("src", "alt", "width", "height"), "ol": ("start", "reversed", "type"), "col": ("span", "width"),
    "colgroup": ("span", "width"), "time": ("datetime",), "details": ("open",), "data": ("value",), "blockquote": ("cite",), "q": ("cite",),
    "ins": ("cite",), "del": ("cite",), "th": ("colspan", "rowspan", "headers", "scope"), "td": ("colspan", "rowspan", "headers", "scope"),
}
_LINKS = ("href", "src", "cite")
_EMPTY = frozenset("area br col hr img wbr".split())
_SILENT = frozenset(("script", "style"))


class _Sanitizer(HTMLParser):
    """Writes what is allowed, in well-formed nesting."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if self.silent or tag not in TAGS:
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            if name not in _EVERY and name not in _OWN.get(tag, ()):
                continue
            if name in _LINKS and not re.match(r"(?i)(#|(https?|mailto):)\S*$", value):
                continue
            kept.append(f' {name}="{escape(value)}"')
        if tag == "a":
            kept.append(' rel="noopener noreferrer"')
        self.out.append(f"<{tag}{''.join(kept)}>")
        if tag not in _EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(escape(data, quote=False))

    def text(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def sanitize(html: str) -> str:
    """Raw HTML with allowed elements, attributes and links only; scripts and styles go with their content, comments too."""
    parser = _Sanitizer()
    parser.feed(html)
    parser.close()
    return parser.text()


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else sanitize(x))
