"""Scalar functions over text, as Column expressions wherever the built-in functions can say it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as a Java character class with the flag for it.
UNICODE_SPACE = r"(?U)\s+"
# The twelve code points that steer the direction of text.
BIDI = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"
# Letters by which Vietnamese is told from English.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def folded(text: str) -> str:
    """Lower case, đ as d, without combining marks."""
    low = text.lower().replace("đ", "d")
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else folded(x))


def clean(text: Column) -> Column:
    """NFC, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(nfc(text), UNICODE_SPACE, " "))


def nonempty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def unix_lines(text: Column) -> Column:
    """Line ends as LF."""
    return F.regexp_replace(text, "\r\n|[\r \u0085]", "\n")


def single_line(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|[\r\n \u0085]", " ")


def strip_bidi(text: Column) -> Column:
    return F.translate(text, BIDI, "")


def escape_csv(text: Column) -> Column:
    """A CSV field, quoted where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def guard_formula(text: Column) -> Column:
    """A field that a spreadsheet would read as a formula, with an apostrophe before it."""
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def strip_tags(html: Column) -> Column:
    """Text without comments, scripts, styles and tags; quotes inside tags are respected, a bare < stays."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(out, r"""(?s)<[/!a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*>""", "")


def running_text(text: Column) -> Column:
    """A running head in the form by which repeats are recognised: lower case, digits as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))


_ROMAN = "(?:x{0,4}(?:ix|iv|v?i{1,3}|v)|x{1,4}|l|xl(?:ix|iv|v?i{0,3}))"


def is_page_number(text: Column) -> Column:
    """Whether a line is a page number alone: 3, - 3 -, Page 3 of 9, 3 / 9, or a roman numeral to 50."""
    pattern = rf"(?i)^\s*(?:(?:page|trang|seite|p\.?)\s*)?[-–—(\[]?\s*(?:[0-9]{{1,4}}|{_ROMAN})\s*[-–—)\]]?(?:\s*(?:/|of|von|sur)\s*[0-9]{{1,4}})?\s*$"
    return text.rlike(pattern)


def link_allowed(url: Column) -> Column:
    """Fragments, http, https and mailto, without space around."""
    return url.rlike(r"(?i)^(#|(https?|mailto):)") & (F.trim(url) == url)


def sanitize_stem(name: Column) -> Column:
    """A safe file stem."""
    out = F.regexp_replace(name, r"[^A-Za-z0-9._ -]+", "_")
    out = F.regexp_replace(out, r"^[. ]+|[. ]+$", "")
    return F.when(out == "", "document").otherwise(F.left(out, F.lit(100)))


def code_point(value: Column) -> Column:
    """The character of a code point; Spark's own char() takes it modulo 256."""
    v = value.cast("long")

    def tail(k: int) -> Column:
        return (F.shiftright(v, 6 * k) % 64 + 0x80) * 256**k

    coded = (
        F.when(v < 0x80, v)
        .when(v < 0x800, (F.shiftright(v, 6) + 0xC0) * 256 + tail(0))
        .when(v < 0x10000, (F.shiftright(v, 12) + 0xE0) * 256**2 + tail(1) + tail(0))
        .otherwise((F.shiftright(v, 18) + 0xF0) * 256**3 + tail(2) + tail(1) + tail(0))
    )
    return F.unhex(F.hex(coded)).cast("string")


def column_name(index: Column) -> Column:
    """Spreadsheet columns from 0: A, Z, AA, ZZZ. Behind ZZZ three places stay, and the first runs on through the code points."""

    def letter(value: Column) -> Column:
        return code_point(F.lit(65) + value)

    two, three = F.floor((index - 26) / 26), F.floor((index - 702) / 676)
    last = letter(F.pmod(index, F.lit(26)))
    return (
        F.when(index < 26, last)
        .when(index < 702, F.concat(letter(two), last))
        .otherwise(F.concat(letter(three), letter(F.floor(F.pmod(index - 702, F.lit(676)) / 26)), last))
    )


def is_numeric(text: Column) -> Column:
    """Whether a cell is a number to a spreadsheet: no plus sign, no leading zeros, finite."""
    return text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,2})?$")


def natural_key(text: Column) -> Column:
    """A key by which digit runs sort as numbers: runs are padded to twenty digits, letters lower-cased."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def words(text: Column, pattern: str = r"[\p{L}\p{M}\p{N}_]+") -> Column:
    """Lower-case words of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def is_vietnamese(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)  # nothing to look for in ASCII
    return F.when(~plain & F.lower(text).rlike(f"[{VIETNAMESE}]"), "vi").otherwise("en")


def sniff_delimiter(text: Column) -> Column:
    """The delimiter that occurs most on the first line that has any, outside quotes; ties favour the comma, then the semicolon."""
    plain = F.regexp_replace(text, r'"(?:[^"]|"")*"', "")
    line = F.regexp_extract(plain, r"(?m)^[^\n]*[,;\t][^\n]*$", 0)

    def count(mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    comma, semicolon, tab = count(","), count(";"), count("\t")
    return F.when((semicolon > comma) & (semicolon >= tab), ";").when((tab > comma) & (tab > semicolon), "\t").otherwise(",")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def expand_name(template: str, values: dict[str, Column]) -> Column:
    """A file name from a template with {stem}, {n}, {date} and {title}; anything else in braces is an error."""
    for token in re.findall(r"\{(\w*)\}", template):
        if token not in values:
            raise ValueError(f"naming template: unknown token {{{token}}}")
    out = F.lit(template)
    for token, value in values.items():
        out = F.replace(out, F.lit("{" + token + "}"), value.cast("string"))
    return F.regexp_replace(out, r"[^A-Za-z0-9._ -]", "_")
