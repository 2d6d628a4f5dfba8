"""Draft recipes from instructions in plain words."""

from __future__ import annotations

import re

# Patterns of intents and the tools they name.
INTENTS = (
    (r"\bmerge|combine|join\b", "merge", {}), (r"\brotate\b.*?(-?\d+)", "rotate", {"angle": int}), (r"\bsplit\b.*?every\s+(\d+)", "split", {"every": int}),
    (r"\b(?:delete|remove)\b.*?\bpages?\s+([\d,\s-]+)", "delete_pages", {"pages": str}), (r"\bextract\b.*?\bpages?\s+([\d,\s-]+)", "extract_pages", {"pages": str}),
    (r"\bredact\b.*?\b(email|phone|card|iban)s?\b", "redact", {"preset": str}), (r"\bnumber\b.*?\bpages\b|\bpage numbers\b", "page_numbers", {}),
    (r"\b(?:summar(?:y|ise|ize))\b", "summarize", {}), (r"\bbates\b", "bates", {}), (r"\bconvert\b.*?\bto\s+(\w+)", "convert", {"to": str}),
)


def draft(instruction: str) -> dict:
    """Steps in the order in which the instruction names them; an instruction that names none is an error."""
    found = []
    for pattern, tool, names in INTENTS:
        for m in re.finditer(pattern, instruction, re.IGNORECASE):
            params = {n: kind(m[i].strip(" ,").replace(" ", "") if kind is str else m[i]) for i, (n, kind) in enumerate(names.items(), 1)}
            found.append((m.start(), {"tool": tool, "params": params}))
    if not found:
        raise ValueError("the instruction names no tool")
    return {"version": "1", "steps": [step for _, step in sorted(found, key=lambda x: x[0])]}
