"""What is asked of a model and what is taken from its replies."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HINT_LIMIT = 600
_FENCED = re.compile(r"```[^\n]*\n(.*?)```", re.S)
_STRINGS_AND_BRACES = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)


def schema(name: str, fields: dict, optional: tuple = ()) -> dict:
    """A JSON schema of an object; the types of fields are string, boolean or strings."""
    kinds = {"strings": {"type": "array", "items": {"type": "string"}}}
    return {"title": name, "type": "object", "properties": {k: kinds.get(t, {"type": t}) for k, t in fields.items()}, "required": [k for k in fields if k not in optional]}


SELECTION = schema("Selection", {"reason": "string", "ref": "string"})
READING = schema("Reading", {"sufficient": "boolean", "response": "string", "absent": "boolean", "quote": "string"}, optional=("absent", "quote"))
TERMS = schema("QueryTerms", {"terms": "strings"})


def strict(node):
    """The schema with every object closed and all of its fields required, at every depth; the input stays as it is."""
    if isinstance(node, list):
        return [strict(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: strict(v) for k, v in node.items()}
    if out.get("type") == "object" or "properties" in out:
        out.setdefault("additionalProperties", False)
        if isinstance(out.get("properties"), dict) and out["properties"]:
            out["required"] = list(out["properties"])
    return out


def extract_json(text: str) -> str | None:
    """One object from a reply: all of it, else a fenced block, else the first balanced braces outside strings."""
    text = (text or "").strip()
    if text.startswith("{") and text.endswith("}"):
        return text
    for fence in _FENCED.finditer(text):
        if fence[1].strip().startswith("{"):
            return fence[1].strip()
    depth, start = 0, 0
    for m in _STRINGS_AND_BRACES.finditer(text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def _fits(value, kind: dict) -> bool:
    if kind["type"] == "array":
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, {"string": str, "boolean": bool}[kind["type"]])


def parse(text: str, kind: dict) -> dict | None:
    """The reply's object if it has the required fields with the right types; missing optional ones are filled."""
    try:
        got = json.loads(extract_json(text) or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, dict):
        return None
    empty = {"boolean": False, "string": "", "array": []}
    full = {k: got.get(k, None if k in kind["required"] else empty[t["type"]]) for k, t in kind["properties"].items()}
    return full if all(_fits(full[k], t) for k, t in kind["properties"].items()) else None


def clip_titles(titles: Column, limit: int = HINT_LIMIT) -> Column:
    """Titles as a list of lines up to a limit of characters, then how many more there are."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("used"), none.alias("lines"), F.lit(False).alias("cut"))

    def step(s, title):
        line = F.concat(F.lit("- "), title)
        over = s["cut"] | (s["used"] + F.length(line) > limit)
        return F.struct(F.when(over, s["used"]).otherwise(s["used"] + F.length(line) + 1).alias("used"), F.when(over, s["lines"]).otherwise(F.concat(s["lines"], F.array(line))).alias("lines"), over.alias("cut"))

    def finish(s):
        more = F.concat(F.lit("- … ("), (F.size(titles) - F.size(s["lines"])).cast("string"), F.lit(" more)"))
        return F.array_join(F.when(s["cut"], F.concat(s["lines"], F.array(more))).otherwise(s["lines"]), "\n")

    return F.when(F.size(titles) > 0, F.aggregate(titles, start, step, finish)).otherwise("(no headings)")
