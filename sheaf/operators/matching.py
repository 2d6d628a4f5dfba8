"""Search for personal data in text, redaction, and its verification.

Texts are searched in their search form: NFC, with digits, spaces and dashes of other kinds unified and invisible characters
dropped. Every character of that form knows the stretch of the text that it stands for, so places are told in the text's own
offsets, and redaction covers whole stretches: spans that touch one another's characters are merged before anything is written.

Numbers are looked for as groups of digits that one separator joins; a place is a run of whole groups of a fitting length and a
fitting checksum. All of a text's places are found, also those that overlap. The work runs in Arrow batches, as offsets under
normalisation are beyond the built-in functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern of addresses, and of the numbers' digits with what may stand between two of them.
EMAIL = r"(?i)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+"
GROUPS = {"card": r"[0-9]+(?:[ -][0-9]+)*", "cccd": r"[0-9]+(?:[ .-][0-9]+)*", "cmnd": r"[0-9]+(?:[ .-][0-9]+)*", "iban": r"[A-Za-z0-9]+(?: [A-Za-z0-9]+)*"}
# Numbers of characters that a place may have.
LENGTHS = {"card": range(13, 20), "cccd": (12,), "cmnd": (9, 12), "iban": range(15, 35)}
PRESETS = ("email", "phone", "card", "iban", "cccd", "cmnd")
# Characters that count as others in a search.
_AS_DIGITS = {ord(c): str(i) for block in ("０１２３４５６７８９", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹") for i, c in enumerate(block)}
_AS_OTHERS = {0x00A0: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2212: "-"}
_DROPPED = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_MAP = _AS_DIGITS | _AS_OTHERS | _DROPPED

_EMAIL, _RUN = re.compile(EMAIL), re.compile(r"\+?[0-9]+")
_CHAINS = {preset: re.compile(pattern) for preset, pattern in GROUPS.items()}
_BEGINS = {preset: re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}" if preset == "iban" else r"(?<![0-9])[0-9]") for preset in GROUPS}
_MAPPED = re.compile("[" + "".join(map(chr, _MAP)) + "]")
_PART = re.compile(r"[A-Za-z0-9]+")


def search_form(text: str) -> str:
    """The text in which searches run: digits of other scripts, dashes and spaces unified, invisible characters dropped, NFC."""
    return unicodedata.normalize("NFC", text.translate(_MAP))


def with_offsets(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The search form, and for each of its characters the stretch of the text that it stands for; None where they are the same."""
    if text.isascii() or not _MAPPED.search(text) and unicodedata.is_normalized("NFC", text):
        return text, None
    out, spans, held, begin, end = [], [], "", 0, 0

    def close() -> None:
        form = unicodedata.normalize("NFC", held)
        out.append(form)
        spans.extend([(begin, end)] * len(form))

    for at, c in enumerate(text):
        c = c.translate(_MAP)
        if not c:
            continue
        # a character that composes or changes places with those before it belongs to their stretch
        if held and (unicodedata.combining(c) or len(unicodedata.normalize("NFC", held[-1] + c)) < 2):
            held, end = held + c, at + 1
            continue
        if held:
            close()
        held, begin, end = c, at, at + 1
    if held:
        close()
    return "".join(out), spans


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban(code: str) -> bool:
    """Two letters, two digits, eleven to thirty more characters, and a value of 1 modulo 97."""
    if not re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _valid(preset: str, code: str) -> bool:
    return luhn(code) if preset == "card" else iban(code) if preset == "iban" else True


def _groups(form: str, preset: str) -> Iterator[tuple[int, int]]:
    """Runs of whole groups with a fitting length and checksum."""
    lengths = LENGTHS[preset]
    most = max(lengths)
    for begin in _BEGINS[preset].finditer(form):
        first = begin.start()
        # every second character may separate groups; whatever the window cuts off is too long anyway
        chain = _CHAINS[preset].match(form, first, first + 2 * most + 2)
        code = ""
        for part in _PART.finditer(form, first, chain.end()):
            code += part[0]
            if len(code) > most:
                break
            if len(code) in lengths and _valid(preset, code):
                yield first, part.end()


def _emails(form: str) -> Iterator[tuple[int, int]]:
    """One place for each at sign that has one; the domain of one address may begin another."""
    at = 0
    while found := _EMAIL.search(form, at):
        yield found.span()
        at = form.index("@", found.start()) + 1


def _phones(form: str) -> Iterator[tuple[int, int]]:
    """International numbers of up to fifteen digits behind a plus, and national ones of ten or eleven that begin with 0."""
    for run in _RUN.finditer(form):
        first, last = run.span()
        digits = run[0].lstrip("+")
        plus = run[0][0] == "+" and digits[0] != "0" and 2 <= len(digits) <= 15
        if plus and not (first and "0" <= form[first - 1] <= "9"):
            yield first, last
        elif digits[0] == "0" and len(digits) in (10, 11):
            yield last - len(digits), last


def places(text: str | None, presets: list[str]) -> list[tuple[str, int, int]]:
    """(preset, start, end) of all places, in the text's own offsets."""
    if not text:
        return []
    form, spans = with_offsets(text)
    out = []
    for preset in presets:
        found = _emails(form) if preset == "email" else _phones(form) if preset == "phone" else _groups(form, preset)
        for first, last in found if preset != "email" or "@" in form else ():
            out.append((preset, first, last) if spans is None else (preset, min(x for x, _ in spans[first:last]), max(y for _, y in spans[first:last])))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first < out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def covered(text: str | None, presets: list[str], mark: str) -> str | None:
    spans = merged([(x, y) for _, x, y in places(text, presets)])
    if text is None or not spans:
        return text
    out, at = [], 0
    for first, last in spans:
        out += [text[at:first], mark * (last - first)]
        at = last
    return "".join([*out, text[at:]])


_PLACES = T.ArrayType(T.StructType([T.StructField("preset", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def matches(text: Column, *presets: str) -> Column:
    """All places of the presets: array of preset, start and end, in characters from 0."""

    @F.pandas_udf(_PLACES)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [dict(zip(("preset", "start", "end"), p, strict=True)) for p in places(x, list(presets))])

    return find(text)


def hits(text: Column, *presets: str) -> Column:
    """The stretches of the text that redaction would cover."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [x[a:b] for a, b in merged([(i, j) for _, i, j in places(x, list(presets))])] if x else [])

    return find(text)


def redact(text: Column, presets: list[str], mark: str = "█") -> Column:
    """The text with every place covered by as many marks as it has characters."""

    @F.pandas_udf(T.StringType())
    def cover(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: covered(x, presets, mark))

    return cover(text)


def iban_valid(text: Column) -> Column:
    """Whether a code without or with single spaces is valid; an expression, for columns of codes."""
    plain = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    ints = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    value = F.aggregate(ints, F.lit(0), lambda acc, d: (acc * F.when(d > 9, 100).otherwise(10) + F.coalesce(d, F.lit(0))) % 97)
    return plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (value == 1)


def overlapping(text: str, target: str) -> list[int]:
    """Where a target begins; places may overlap. Knuth, Morris and Pratt's border table."""
    if not target:
        return []
    border, k = [0] * len(target), 0
    for i in range(1, len(target)):
        while k and target[i] != target[k]:
            k = border[k - 1]
        k += target[i] == target[k]
        border[i] = k
    out, k = [], 0
    for i, c in enumerate(text):
        while k and (k == len(target) or c != target[k]):
            k = border[k - 1]
        k += c == target[k]
        if k == len(target):
            out.append(i - k + 1)
    return out


def exact_places(target: str):
    """A function of a text column: begins of a target, compared in the search form, in the text's own offsets."""
    wanted = search_form(target)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def begins(text: pd.Series) -> pd.Series:
        def find(x: str | None) -> list[int]:
            form, spans = with_offsets(x or "")
            found = overlapping(form, wanted)
            return found if spans is None else [spans[i][0] for i in found]

        return text.map(find)

    return begins


def regex_places(text: str, pattern: str) -> list[tuple[int, int]]:
    """All non-empty matches, the search starting again one character after each begin."""
    if not 1 <= len(pattern.encode()) <= 1024:
        raise ValueError("a pattern has 1 to 1024 bytes")
    rule, out, at = re.compile(pattern), [], 0
    while at <= len(text) and (m := rule.search(text, at)):
        if m.end() > m.start():
            out.append(m.span())
        at = m.start() + 1
    return out
