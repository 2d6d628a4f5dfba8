"""Opening documents for editing and writing them back with what changed and how much of the text the new form keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.scoring import character_rate
from sheaf.sources.html import Page
from sheaf.sources.markdown import read_markdown, write_html, write_markdown

#: Formats that can be opened, and written.
OPENED, WRITTEN = ("markdown", "html"), ("markdown", "html")
_FIELDS = ("ord", "kind", "level", "text", "lang", "checked", "ordered", "rows")
BLOCK = "struct<id:string,ord:int,kind:string,level:int,text:string,lang:string,checked:boolean,ordered:boolean,rows:array<array<string>>>"


def read_blocks(source: str, kind: str) -> list[dict]:
    if kind == "markdown":
        found = read_markdown(source)["blocks"]
    elif kind == "html":
        found = [{k: b.get(k) for k in _FIELDS} for b in Page(source).row()["blocks"]]
    else:
        raise ValueError(f"cannot open {kind!r}")
    return [{"id": f"b{b['ord']}", **{k: b.get(k) for k in _FIELDS}} for b in found]


def write_blocks(blocks: list[dict], kind: str) -> str:
    if kind not in WRITTEN:
        raise ValueError(f"cannot write {kind!r}")
    return (write_markdown if kind == "markdown" else write_html)(blocks)


def _plain(blocks: list[dict]) -> str:
    return "\n".join("\n".join("\t".join(c or "" for c in row) for row in b["rows"]) if b.get("rows") else b["text"] or "" for b in blocks)


def kept_share(blocks: list[dict], kind: str) -> float | None:
    """How much of the text is still there once the blocks are written and read again; None beyond the limits."""
    rate = character_rate(_plain(blocks), _plain(read_blocks(write_blocks(blocks, kind), kind)))
    return None if rate is None else max(0.0, 1 - rate)


def opened(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, blocks, preview): the blocks with identifiers by which edits name them, and the share of the text that writing would keep."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [read_blocks(x or "", kind) for x in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "blocks": found, "preview": [kept_share(b, kind) for b in found]})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, blocks array<{BLOCK}>, preview double")
    return out.withColumnRenamed("key", key)


def exported(docs: DataFrame, edits: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, text, changes, fidelity) of opened documents with edits (key, id, text), where a null text removes a block. Edits of
    blocks that a document doesn't have are ignored; changes are sorted by identifier, each with its kind."""
    given = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("text")))).alias("edits"))

    def one(blocks: list[dict], wanted: dict[str, str | None]) -> dict:
        out, changes = [], []
        for block in blocks:
            text = wanted.get(block["id"], block["text"])
            if text is None and block["id"] in wanted:
                changes.append({"id": block["id"], "kind": "removed"})
                continue
            if text != block["text"]:
                changes.append({"id": block["id"], "kind": "changed"})
            out.append(block | {"text": text})
        return {"text": write_blocks(out, kind), "changes": sorted(changes, key=lambda c: c["id"]), "fidelity": kept_share(out, kind)}

    written = pa.struct([("text", pa.string()), ("changes", pa.list_(pa.struct([("id", pa.string()), ("kind", pa.string())]))), ("fidelity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [{k: v["text"] for k, v in e or ()} for e in batch.column("edits").to_pylist()]
            found = pa.array([one(b, e) for b, e in zip(batch.column("blocks").to_pylist(), wanted, strict=True)], written)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *found.flatten()], names=["key", "text", "changes", "fidelity"])

    rows = docs.join(given, key, "left").select(F.col(key).alias("key"), "blocks", "edits")
    schema = f"key {dict(rows.dtypes)['key']}, text string, changes array<struct<id:string,kind:string>>, fidelity double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
