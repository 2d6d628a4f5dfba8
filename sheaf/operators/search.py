"""Passages, questions and summaries by word overlap and word frequencies."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheaf.functions.text import folded

# Words that carry no meaning in a question or summary.
STOP_WORDS = (
    "the a an is are was were what when where how why does do of in to and or for with from this that document please"
    " la cua va cac nhung gi nao o cho"
).split()
#: Characters of a passage and of a summary's sentence, at most; sentences of a summary by its length; citations of an answer.
PASSAGE, BULLET = 2000, 1000
SENTENCES = {"brief": 1, "standard": 3, "detailed": 6}
CITATIONS = range(1, 21)
#: Different words that a counting task holds before it passes them on.
HELD = 300_000

_WORD, _END = re.compile(r"\w+"), re.compile(r"(?<=[.!?])\s+|\n+")
_PASSAGE = re.compile(rf"[^\n.!?]{{1,{PASSAGE}}}[.!?]?")
_STOP = frozenset(STOP_WORDS)


def tokens(text: str) -> list[str]:
    """Folded words without stop words; repeats stay."""
    return [w for w in _WORD.findall(folded(text)) if w not in _STOP]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["key", "token", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, n in Counter(tokens(text.as_py() or "")).items():
                held[key, word] += n
        if len(held) > HELD:
            yield flush()
    yield flush()


def token_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n); tasks count before anything is shuffled."""
    found = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(_counted, "key string, token string, n long")
    return found.groupBy(F.col("key").alias(key), "token").agg(F.sum("n").alias("n"))


_SENTENCE = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])


def best_sentences(text: str, k: int) -> list[dict]:
    """The k best sentences of a text in their own order; a sentence scores its words' frequencies over the root of its length."""
    parts = [s for s in (x.strip() for x in _END.split(text)) if s]
    spoken = [tokens(s) for s in parts]
    often = Counter(w for own in spoken for w in own)
    scores = [round(sum(often[w] for w in own) / max(1.0, math.sqrt(len(own))), 6) for own in spoken]
    best = sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:k]
    return [{"position": i, "sentence": parts[i][:BULLET], "score": scores[i]} for i in sorted(best)]


def summary(docs: DataFrame, key: str, text: str, length: str = "standard") -> DataFrame:
    """(key, position, sentence, score): a summary depends on its own text only, so nothing is shuffled."""
    if length not in SENTENCES:
        raise ValueError("length must be brief, standard or detailed")

    @F.pandas_udf(T.ArrayType(_SENTENCE))
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [] if x is None else best_sentences(x, SENTENCES[length]))

    return docs.select(key, F.inline(best(text)))


def passages(text: str) -> list[str]:
    """Stretches without line ends and sentence ends, each with the sentence end behind it."""
    return [m[0].strip() for m in _PASSAGE.finditer(text)]


def answers(docs: DataFrame, key: str, text: str, question: str, k: int = 5) -> DataFrame:
    """The k passages of all texts that share most of a question's words, in the order of the texts among equals: (key, position,
    quote, score). Positions are those of the passages in their text."""
    wanted = frozenset(tokens(question))
    if k not in CITATIONS or not question.strip():
        raise ValueError(f"a question and {CITATIONS[0]} to {CITATIONS[-1]} citations are asked for")
    kind = "array<struct<position:int,quote:string,score:double>>"

    @F.pandas_udf(kind)
    def cited(texts: pd.Series) -> pd.Series:
        def find(x: str | None) -> list[dict]:
            found = []
            for i, quote in enumerate(passages(x or "")):
                if both := wanted & set(tokens(quote)):
                    found.append({"position": i, "quote": quote, "score": len(both) / len(wanted)})
            return sorted(found, key=lambda r: -r["score"])[:k]  # no text can have more among the best

        return texts.map(find)

    return docs.select(key, F.inline(cited(text))).orderBy(F.desc("score"), key, "position").limit(k)


def translated(text: str, glossary: dict[str, str]) -> str:
    """Glossary terms replaced, longest first, at word boundaries, with the case of the text; code, tags and links stay."""
    terms = sorted(glossary, key=lambda t: (-len(t), t))
    rule = re.compile(r"(`[^`]*`|<[^>]*>|https?://\S+)|(?<!\w)(" + "|".join(map(re.escape, terms)) + r")(?!\w)", re.IGNORECASE)
    low = {k.lower(): v for k, v in glossary.items()}

    def put(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        new = low[m[2].lower()]
        return new.upper() if m[2].isupper() and len(m[2]) > 1 else new[:1].upper() + new[1:] if m[2][:1].isupper() else new

    return rule.sub(put, text)


def translate(glossary: dict[str, str]):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else translated(x, glossary))

    return run


#: Line ends, and space around a line or a cell.
LINE_ENDS = "\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
_AROUND = r"(?U)^\s+|\s+$"


def line_cells(line):
    """The cells of a line: between bars, of which a backslash escapes one and those around the line don't count, or else
    between tabs and runs of spaces."""
    line = F.regexp_replace(line, _AROUND, "")
    barred = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"(?<!\\)\|", -1), lambda c: F.regexp_replace(c, _AROUND, ""))
    return F.when(F.contains(line, F.lit("|")), barred).otherwise(F.split(line, r"\t| {2,}", -1))


def line_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of lines with at least two cells each, by gaps and islands: (key, table, row, cells). Rows of dashes are left out;
    a table has two other rows at least."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), LINE_ENDS)).alias("line", "raw"))
    lines = lines.withColumn("cells", line_cells(F.col("raw")))
    rows = lines.filter((F.size("cells") > 1) & F.exists("cells", lambda c: c != ""))
    rows = rows.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line")))
    rows = rows.filter(~F.forall("cells", lambda c: c.rlike("^:?-{2,}:?$")))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(key, "island"))).filter("size >= 2")
    rows = rows.withColumn("table", F.dense_rank().over(Window.partitionBy(key).orderBy("island")))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(key, "island").orderBy("line"))).select(key, "table", "row", "cells")
