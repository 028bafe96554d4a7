"""Answer schemas: compiles a JSON schema into one expression that gives the path of each violation.

Known words: type (one or a list), enum (of strings), required, properties, additionalProperties (false), items, minimum, maximum, minLength, maxLength, minItems, maxItems, pattern. Any
other word is an error, as it would be silently ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.expr import whole_json

KNOWN = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern"}
#: Schemas of variants by JSON type; an integer may be written with a zero fraction.
KINDS = {"string": r"STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "null": "VOID", "array": "(?s)ARRAY.*", "object": "(?s)OBJECT.*"}

ANSWER = {"type": ["array", "null"], "items": {"type": "object", "required": ["severity", "title", "path"], "properties": {"severity": {"enum": ["low", "medium", "high"]}, "category": {"type": "string"}, "title": {"type": "string", "minLength": 1}, "message": {"type": "string"}, "suggestion": {"type": "string"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "path": {"type": "string"}, "startLine": {"type": "integer", "minimum": 0}, "endLine": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}}}


def when(bad: Column, path: Column, why: str) -> Column:
    """The violation in an array, or an empty one."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(f": {why}")))).otherwise(F.array().cast("array<string>"))


def is_kind(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(rf"\A(?:{KINDS[kind]})\z")


def judge(schema: dict, path: Column):
    """of_value() of a schema, as a function of the value alone."""
    return lambda value: of_value(value, schema, path)


def of_value(value: Column, schema: dict, path: Column) -> Column:
    """Violations of a variant that is there (it may be the JSON null)."""
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"unknown words in the schema: {', '.join(sorted(unknown))}")
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        any_kind = is_kind(value, kinds[0])
        for k in kinds[1:]:
            any_kind = any_kind | is_kind(value, k)
        out.append(when(~any_kind, path, f"is not of type {' or '.join(kinds)}"))
    text, number = (F.when(is_kind(value, k), F.try_variant_get(value, "$", t)) for k, t in (("string", "string"), ("number", "double")))
    if "enum" in schema:
        out.append(when(~F.coalesce(text.isin(*schema["enum"]), F.lit(False)), path, f"is not one of {', '.join(schema['enum'])}"))
    if "pattern" in schema:
        out.append(when(~text.rlike(schema["pattern"]), path, f"does not match {schema['pattern']}"))
    for word, bad, why in (("minimum", lambda n: number < n, "is less than"), ("maximum", lambda n: number > n, "is more than"), ("minLength", lambda n: F.char_length(text) < n, "has fewer characters than"), ("maxLength", lambda n: F.char_length(text) > n, "has more characters than")):
        if word in schema:
            out.append(when(bad(schema[word]), path, f"{why} {schema[word]}"))
    parts = F.when(is_kind(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
    for word, bad, why in (("minItems", lambda n: F.size(parts) < n, "has fewer elements than"), ("maxItems", lambda n: F.size(parts) > n, "has more elements than")):
        if word in schema:
            out.append(when(parts.isNotNull() & bad(schema[word]), path, f"{why} {schema[word]}"))
    if "items" in schema:
        each = F.transform(parts, lambda x, i: of_value(F.coalesce(x, F.parse_json(F.lit("null"))), schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    fields = F.when(is_kind(value, "object"), F.try_variant_get(value, "$", "map<string,variant>"))
    here = lambda name: path if name is None else F.concat(path, F.lit(f".{name}"))
    for name in schema.get("required", []):
        out.append(when(fields.isNotNull() & ~F.map_contains_key(fields, name), here(name), "is missing"))
    for name, own in schema.get("properties", {}).items():
        there = F.when(F.map_contains_key(fields, name), F.coalesce(fields[name], F.parse_json(F.lit("null"))))
        found = F.flatten(F.transform(F.filter(F.array(there), lambda x: x.isNotNull()), judge(own, here(name))))
        out.append(F.coalesce(found, F.array().cast("array<string>")))
    if schema.get("additionalProperties") is False:
        names = F.filter(F.map_keys(fields), lambda k: ~k.isin(*schema.get("properties", {})))
        out.append(F.coalesce(F.transform(F.array_sort(names), lambda k: F.concat(path, F.lit("."), k, F.lit(": is not known"))), F.array().cast("array<string>")))
    return F.concat(*out) if out else F.array().cast("array<string>")


def violations(text: Column, schema: dict | str) -> Column:
    """Paths of what breaks the schema in a JSON text, each with the reason, in the schema's order; empty for a valid one."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    found = F.transform(F.array(whole_json(text)), lambda v: F.when(v.isNotNull(), of_value(v, schema, F.lit("$"))))
    return F.coalesce(F.get(found, 0), F.array(F.lit("$: is not JSON")))
