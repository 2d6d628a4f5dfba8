"""The text reader: paragraphs with their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import nfc


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, text, lines): blocks between empty lines, trimmed, empty ones dropped, lines without trailing space."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "^\ufeff", ""), "\r\n?", "\n")
    parts = F.transform(F.split(nfc(plain), "\n\n"), lambda b: F.regexp_replace(b, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    blocks = docs.select(key, F.posexplode(F.filter(parts, lambda b: b != "")).alias("ord", "raw"))
    return blocks.select(key, "ord", F.regexp_replace("raw", "[ \t]+\n", "\n").alias("text"), F.size(F.split("raw", "\n")).alias("lines"))
