"""JSON Schema compiled to column expressions: what a document breaks is computed by Spark, without Python.

A schema is walked once, on the driver, and gives one expression over a VARIANT: objects are read as maps,
arrays as arrays, and each part has the path at which it stands. References within the schema are
put in place of themselves; one that leads back to itself is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Callable[[Column, Column], Column]
FOUND = "array<struct<path:string,rule:string>>"
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": NUMBERS, "integer": NUMBERS}
#: Keywords that say nothing about a document.
SILENT = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
KNOWN = {"$ref", "type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "minLength", "pattern", "format", "minimum", "maximum"}
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


class SchemaError(ValueError):
    """The schema itself is wrong, or uses what is not supported."""


def kind_of(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An array that ``use`` makes of a value which is computed once."""
    return F.flatten(F.transform(F.array(value), use))


def _target(reference: str, root: dict) -> dict:
    if not isinstance(reference, str) or not reference.startswith("#/"):
        raise SchemaError(f"reference {reference!r} is not within the schema")
    at = root
    for key in reference[2:].split("/"):
        if not isinstance(at, dict) or key not in at:
            raise SchemaError(f"reference {reference} leads nowhere")
        at = at[key]
    if not isinstance(at, dict):
        raise SchemaError(f"reference {reference} is no schema")
    return at


def _same(value: Column, kind: Column, wanted: object) -> Column:
    """Whether a value is a stated one."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(kind.isin(*NUMBERS) & (F.try_variant_get(value, "$", "double") == float(wanted)), F.lit(False))
    return F.coalesce(F.to_json(value), F.lit("null")) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def compiled(schema: dict, root: dict | None = None, above: tuple[str, ...] = ()) -> Rules:
    """An expression of (VARIANT, its path) that lists what the value breaks, as (path, rule)."""
    root = schema if root is None else root
    if not isinstance(schema, dict):
        raise SchemaError("a schema must be an object")
    if "$ref" in schema:
        reference = schema["$ref"]
        if reference in above:
            raise SchemaError(f"reference {reference} leads back to itself")
        return compiled(_target(reference, root), root, (*above, reference))
    if unknown := set(schema) - KNOWN - SILENT:
        raise SchemaError(f"unsupported keywords: {', '.join(sorted(unknown))}")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if wrong := set(kinds) - set(KINDS):
        raise SchemaError(f"unknown types: {', '.join(sorted(wrong))}")
    inside = {k: compiled(v, root, above) for k, v in schema.get("properties", {}).items()}
    others = schema.get("additionalProperties", True)
    other_rules = compiled(others, root, above) if isinstance(others, dict) else None
    items = compiled(schema["items"], root, above) if isinstance(schema.get("items"), dict) else None

    def rules(value: Column, path: Column) -> Column:
        kind = kind_of(value)
        tests: list[tuple[str, Column]] = []
        if "const" in schema:
            tests.append(("const", ~_same(value, kind, schema["const"])))
        if "enum" in schema:
            hit = F.lit(False)
            for x in schema["enum"]:
                hit = hit | _same(value, kind, x)
            tests.append(("enum", ~hit))
        text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(kind.isin(*NUMBERS), F.try_variant_get(value, "$", "double"))
        if "minLength" in schema:
            tests.append(("minLength", F.length(text) < schema["minLength"]))
        if "pattern" in schema:
            tests.append(("pattern", ~text.rlike(schema["pattern"])))
        if schema.get("format") == "date-time":
            tests.append(("date-time", text.isNotNull() & ~(text.rlike(DATE_TIME) & F.try_to_timestamp(text).isNotNull())))
        if "minimum" in schema:
            tests.append(("minimum", number < float(schema["minimum"])))
        if "maximum" in schema:
            tests.append(("maximum", number > float(schema["maximum"])))
        say = lambda at, rule: F.struct(at.alias("path"), F.lit(rule).alias("rule"))
        parts = [F.array_compact(F.array(*[F.when(broken, say(path, rule)) for rule, broken in tests]))] if tests else []
        if schema.get("required") or inside or others is not True:
            parts.append(F.when(kind == "OBJECT", _let(value.try_cast("map<string,variant>"), lambda m: of_object(m, path))))
        if items is not None or "minItems" in schema:
            parts.append(F.when(kind == "ARRAY", _let(value.try_cast("array<variant>"), lambda a: of_array(a, path))))
        empty = F.array().cast(FOUND)
        found = F.concat(*[F.coalesce(p.cast(FOUND), empty) for p in parts]) if parts else empty
        if not kinds:
            return found
        fits = F.lit(False)
        for k in kinds:
            whole = F.coalesce(number == F.floor(number), F.lit(False)) if k == "integer" else F.lit(True)
            fits = fits | (kind.isin(*KINDS[k]) & whole)
        return F.when(fits, found).otherwise(F.array(say(path, "type")).cast(FOUND))

    def of_object(held: Column, path: Column) -> Column:
        say = lambda at, rule: F.struct(at.alias("path"), F.lit(rule).alias("rule"))
        at = lambda key: F.concat(path, F.lit("."), key if isinstance(key, Column) else F.lit(key))
        has = lambda key: F.map_contains_key(held, key)
        parts = [F.array_compact(F.array(*[F.when(~has(k), say(at(k), "required")) for k in schema["required"]]))] if schema.get("required") else []
        under = lambda sub, key: lambda x: sub(x, at(key))
        parts += [F.when(has(k), _let(F.try_element_at(held, F.lit(k)), under(sub, k))) for k, sub in inside.items()]
        rest = (lambda key: ~key.isin(*inside)) if inside else (lambda key: F.lit(True))
        if others is False:
            parts.append(F.transform(F.filter(F.map_keys(held), rest), lambda k: say(at(k), "additionalProperties")))
        elif other_rules is not None:
            parts.append(F.flatten(F.transform(F.filter(F.map_entries(held), lambda e: rest(e["key"])), lambda e: other_rules(e["value"], at(e["key"])))))
        empty = F.array().cast(FOUND)
        return F.concat(*[F.coalesce(p.cast(FOUND), empty) for p in parts]) if parts else empty

    def of_array(held: Column, path: Column) -> Column:
        parts = []
        if "minItems" in schema:
            parts.append(F.when(F.size(held) < schema["minItems"], F.array(F.struct(path.alias("path"), F.lit("minItems").alias("rule")))))
        if items is not None:
            parts.append(F.flatten(F.transform(held, lambda x, k: items(x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))))
        return F.concat(*[F.coalesce(p.cast(FOUND), F.array().cast(FOUND)) for p in parts])

    return rules


def document_violations(rows: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """(key, path, rule) of what each JSON document breaks.

    Text that is no JSON, or names a key of an object twice, breaks ``json``; a null document breaks nothing.
    """
    rules, value = compiled(schema), F.try_parse_json(F.col(document))
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(FOUND)
    found = F.when(F.col("_v").isNull(), bad).otherwise(rules(F.col("_v"), F.lit("$")))
    return rows.where(F.col(document).isNotNull()).select(key, value.alias("_v")).select(key, F.explode(found).alias("v")).select(key, "v.path", "v.rule")
