"""Structured output in JSON: checks against a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of a schema as those of a parsed value begin.
_TYPES = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "null": ["VOID"]}


def core_schema(schema: dict) -> dict:
    """The schema itself, taken out of what services wrap it in."""
    if "schema" in schema:
        return schema["schema"]
    return (schema.get("json_schema") or {}).get("schema", schema)


def schema_fault(text: Column, schema: dict) -> Column:
    """The first thing by which a JSON text differs from a schema, as ``path: fault``; '' if it doesn't, 'no JSON' for other texts.

    Looked at are types (one or several), required and listed properties, constants and enumerations of texts, at any depth of
    objects; the items of arrays aren't. Null texts give null.
    """
    parsed = F.try_parse_json(text)
    faults: list[Column] = []

    def visit(path: str, part: dict) -> None:
        value = F.try_variant_get(parsed, path, "variant")
        kind = F.schema_of_variant(value)
        there = value.isNotNull()
        wanted = part.get("type")
        wanted = [wanted] if isinstance(wanted, str) else wanted or []
        if wanted:
            good = F.lit(False)
            for t in wanted:
                for name in _TYPES[t]:
                    good = good | kind.startswith(name)
            faults.append(F.when(there & ~good, f"{path}: not {' or '.join(wanted)}"))
        options = [part["const"]] if "const" in part else part.get("enum")
        if options and all(isinstance(x, str) for x in options):
            faults.append(F.when(there & ~F.coalesce(F.try_variant_get(parsed, path, "string").isin(options), F.lit(False)), f"{path}: not listed"))
        for name in part.get("required", []):
            below = F.try_variant_get(parsed, f"{path}.{name}", "variant")
            faults.append(F.when(there & kind.startswith("OBJECT") & below.isNull(), f"{path}.{name}: missing"))
        for name, below in part.get("properties", {}).items():
            visit(f"{path}.{name}", below)

    visit("$", core_schema(schema))
    return F.when(text.isNull(), None).when(parsed.isNull(), "no JSON").otherwise(F.coalesce(*faults, F.lit("")))
