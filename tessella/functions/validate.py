"""Parameters of tool calls against a JSON Schema: maps of text with plain properties, and nested JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.scalar import coerce_param

#: What the text of a value of each type looks like.
LOOKS = {"integer": r"^\s*[+-]?\d+\s*$", "number": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "boolean": r"^(true|false)$"}


def coerced(params: Column, schema: dict) -> Column:
    """A map of text parameters with the values of declared ones as text of their types."""
    out = params
    for name, p in schema.get("properties", {}).items():
        value = F.try_element_at(params, F.lit(name))
        out = F.when(value.isNotNull(), F.map_concat(F.map_filter(out, lambda k, _: k != name), F.create_map(F.lit(name), coerce_param(value, F.lit(p.get("type", "string")))))).otherwise(out)
    return out


def errors(params: Column, schema: dict) -> Column:
    """What is wrong with a map of (coerced) text parameters, in the order of the schema; empty if nothing is."""
    found = []
    for name in schema.get("required", []):
        found.append(F.when(F.try_element_at(params, F.lit(name)).isNull(), F.lit(f"{name}: required")))
    for name, p in schema.get("properties", {}).items():
        value = F.try_element_at(params, F.lit(name))
        if (kind := p.get("type", "string")) in LOOKS:
            found.append(F.when(~value.rlike(LOOKS[kind]), F.lit(f"{name}: not of type {kind}")))
        if "enum" in p:
            found.append(F.when(~value.isin([str(x) for x in p["enum"]]), F.lit(f"{name}: not in enum")))
    if schema.get("additionalProperties") is False:
        extra = F.filter(F.map_keys(params), lambda k: ~k.isin(list(schema.get("properties", {}))))
        found.append(F.when(F.size(extra) > 0, F.concat(F.array_join(F.array_sort(extra), ","), F.lit(": unknown"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


#: What the type of a VARIANT looks like for each type of JSON Schema; whole numbers may be written as decimals.
TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "integer": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"}
NOTHING = "array<string>"


def json_errors(text: Column, schema: dict) -> Column:
    """What is wrong with a JSON document, as `path: problem` in the order of the schema; empty if nothing is, and `$: not JSON` for other text or null.

    Nested objects and lists are checked to the end. Known: type (one or several), required, properties, additionalProperties (false, or
    a schema), items, minItems, maxItems, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength and
    pattern. Numbers of an enum count as equal if they are written alike. All is built-in functions over VARIANT."""
    doc = F.try_parse_json(text)
    return F.when(doc.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_errors_of(doc, schema, F.lit("$")))


def _path(name: str) -> str:
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def _typed(v: Column, kind: str) -> Column:
    own = F.schema_of_variant(v).rlike(TYPES[kind])
    return own & (F.try_variant_get(v, "$", "double") % 1 == 0) if kind == "integer" else own


def _errors_of(v: Column, schema: dict, at: Column) -> Column:
    """Errors of a VARIANT that is there; each keyword says nothing about values of types that it isn't for."""
    none = F.array().cast(NOTHING)
    found = []

    def wrong(when: Column, problem: str) -> None:
        found.append(F.when(when, F.array(F.concat(at, F.lit(f": {problem}")))).otherwise(none))

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = F.lit(False)
        for k in kinds:
            fits = fits | F.coalesce(_typed(v, k), F.lit(False))
        wrong(~fits, f"not of type {' or '.join(kinds)}")
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        texts = [json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in allowed]
        wrong(~F.to_json(v).isin(texts), "not in enum" if "enum" in schema else "not the constant")
    number = F.when(_typed(v, "number"), F.try_variant_get(v, "$", "double"))
    for name, bad, word in (("minimum", number.__lt__, "below"), ("maximum", number.__gt__, "above"), ("exclusiveMinimum", number.__le__, "not above"), ("exclusiveMaximum", number.__ge__, "not below")):
        if name in schema:
            wrong(bad(F.lit(float(schema[name]))), f"{word} {schema[name]}")
    string = F.when(_typed(v, "string"), F.try_variant_get(v, "$", "string"))
    if "minLength" in schema:
        wrong(F.length(string) < schema["minLength"], f"shorter than {schema['minLength']}")
    if "maxLength" in schema:
        wrong(F.length(string) > schema["maxLength"], f"longer than {schema['maxLength']}")
    if "pattern" in schema:
        wrong(~string.rlike(schema["pattern"]), "doesn't match the pattern")

    is_object = _typed(v, "object")
    for name in schema.get("required", []):
        missing = F.try_variant_get(v, _path(name), "variant").isNull()
        found.append(F.when(is_object & missing, F.array(F.concat(at, F.lit(f".{name}: required")))).otherwise(none))
    known = schema.get("properties", {})
    for name, own in known.items():
        child = F.try_variant_get(v, _path(name), "variant")
        found.append(F.when(is_object & child.isNotNull(), _errors_of(child, own, F.concat(at, F.lit(f".{name}")))).otherwise(none))
    more = schema.get("additionalProperties", True)
    if more is not True:
        fields = F.when(is_object, v.try_cast("map<string,variant>"))
        others = F.filter(F.array_sort(F.map_keys(fields)), lambda k: ~k.isin(list(known))) if known else F.array_sort(F.map_keys(fields))
        each = (lambda k: F.array(F.concat(at, F.lit("."), k, F.lit(": unknown")))) if more is False else (lambda k: _errors_of(F.try_element_at(fields, k), more, F.concat(at, F.lit("."), k)))
        found.append(F.coalesce(F.flatten(F.transform(others, each)), none))

    elements = F.when(_typed(v, "array"), v.try_cast("array<variant>"))
    if "minItems" in schema:
        wrong(F.size(elements) < schema["minItems"], f"fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        wrong(F.size(elements) > schema["maxItems"], f"more than {schema['maxItems']} items")
    if "items" in schema:
        own = F.transform(elements, lambda x, i: _errors_of(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(own), none))
    return F.concat(*found) if found else none
