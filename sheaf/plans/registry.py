"""The registry of tools: what each takes and needs, and the JSON Schema of its parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANY = 10_000


@dataclass(frozen=True)
class Tool:
    """An operation on documents: its group, numbers of inputs, formats, plan, and parameters as a Spark schema in DDL."""

    id: str
    group: str
    least: int = 1
    most: int = 1
    formats: tuple[str, ...] = ("pdf",)
    tier: str = "free"
    parameters: str = ""
    required: tuple[str, ...] = field(default=())


def _tools(group: str, *rows: tuple) -> list[Tool]:
    return [Tool(row[0], group, **(row[1] if len(row) > 1 else {})) for row in rows]


TOOLS: list[Tool] = [
    *_tools("pages", ("merge", {"least": 2, "most": MANY}), ("split", {"parameters": "every int, max_bytes long, at array<int>"}), ("extract", {"parameters": "pages string", "required": ("pages",)}),
            ("delete", {"parameters": "pages string", "required": ("pages",)}), ("reorder", {"parameters": "preset string, order array<int>"}), ("rotate", {"parameters": "pages string, angle int", "required": ("angle",)}),
            ("alternate_mix", {"least": 2, "most": 2, "parameters": "reverse_second boolean"}), ("insert_blank", {"parameters": "pages string"}), ("crop", {"parameters": "left double, top double, right double, bottom double"}),
            ("scale", {"parameters": "width double, height double"}), ("nup", {"parameters": "columns int, rows int"}), ("booklet",), ("divide", {"parameters": "columns int, rows int"}), ("posterize", {"parameters": "columns int, rows int, overlap double"}),
            ("overlay", {"least": 2, "most": 2, "parameters": "pages string, repeat boolean"}), ("single_page",), ("remove_blank", {"parameters": "threshold double"})),
    *_tools("stamps", ("page_numbers", {"parameters": "template string, start int"}), ("bates", {"parameters": "prefix string, digits int, suffix string, start long"}), ("header_footer", {"parameters": "template string"}),
            ("toc_page", {"parameters": "per_page int"}), ("watermark_detect", {"parameters": "min_page_ratio double"}), ("watermark_remove", {"parameters": "min_page_ratio double"})),
    *_tools("records", ("metadata", {"parameters": "set map<string,string>, remove array<string>"}), ("outline",), ("attachments", {"parameters": "add array<string>, remove array<string>"}), ("page_labels",), ("viewer_prefs", {"parameters": "page_layout string, fit_window boolean"}),
            ("layers", {"parameters": "names array<string>, visible boolean"}), ("annotations", {"parameters": "remove array<string>"}), ("annotations_export", {"parameters": "format string"}), ("annotations_import", {"formats": ("pdf", "xfdf", "json")})),
    *_tools("forms", ("forms_list",), ("forms_fill", {"parameters": "values map<string,string>", "required": ("values",)}), ("forms_create",), ("forms_flatten", {"parameters": "pages string, fields array<string>"}), ("forms_import", {"formats": ("csv", "fdf", "xfdf", "json")}), ("forms_export", {"parameters": "format string"})),
    *_tools("privacy", ("redact", {"parameters": "presets array<string>, exact array<string>, patterns array<string>", "tier": "pro"}), ("redact_verify", {"tier": "pro"}), ("sanitize", {"parameters": "categories array<string>"}), ("permissions", {"parameters": "flags int"}), ("encrypt", {"parameters": "key string", "required": ("key",)}), ("decrypt", {"parameters": "key string", "required": ("key",)})),
    *_tools("text", ("summarize", {"formats": ("md", "html", "docx", "pdf", "json"), "parameters": "length string, language string", "tier": "pro"}), ("ask", {"formats": ("md", "html", "docx", "pdf", "json"), "parameters": "question string, max_citations int", "required": ("question",), "tier": "pro"}),
            ("translate", {"formats": ("md", "html", "docx", "pdf", "json"), "parameters": "target_lang string, source_lang string, format string", "required": ("target_lang",), "tier": "pro"}), ("extract_tables", {"formats": ("md", "html", "docx", "pdf", "json"), "tier": "pro"}), ("recipe_from_text", {"least": 0, "most": 0, "parameters": "text string", "required": ("text",), "tier": "pro"})),
    *_tools("reports", ("info",), ("compare", {"least": 2, "most": 2}), ("detect_scanned",), ("accessibility_report",), ("tables_to_csv",), ("extract_images",), ("text_layout",)),
]


def accepts(tool: Tool, name: str) -> bool:
    """Whether a tool takes a format, whatever the case of its name."""
    return name.lower() in tool.formats


def _schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _schema(f.dataType) for f in kind}, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _schema(kind.valueType)}
    names = {T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number", T.BooleanType: "boolean"}
    return {"type": names.get(type(kind), "string")}


def parameter_schema(tool: Tool) -> dict:
    """The JSON Schema of a tool's parameters."""
    out = _schema(T._parse_datatype_string(tool.parameters) if tool.parameters else T.StructType())
    return out | ({"required": list(tool.required)} if tool.required else {})


def table(spark: SparkSession) -> DataFrame:
    rows = [(x.id, x.group, x.least, x.most, list(x.formats), x.tier, json.dumps(parameter_schema(x), sort_keys=True)) for x in TOOLS]
    return spark.createDataFrame(rows, "id string, group string, least int, most int, formats array<string>, tier string, schema string")
