"""JSON texts against a JSON Schema, compiled to one column: an array of errors, each with the path of what is wrong.

Read are type, const, enum, minimum, minLength, maxLength, minItems, maxItems, properties, required, additionalProperties
(false), items, anyOf, allOf and references inside the schema; a schema that refers to itself can't be compiled. Paths
are like units[0].name, and $ for the whole. A null text has no errors and no answer (null); a text that is no JSON has one.
Whole numbers are integers of any size; 1.0 is a number.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.shapes import let

#: How Spark names the kinds of variants.
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _is(kind: Column, name: str) -> Column:
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    if name == "integer":
        return whole
    return whole | kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") if name == "number" else kind.startswith(KINDS[name])


def _said(kind: Column) -> Column:
    """The kind of a value in the schema's words."""
    return reduce(lambda acc, n: acc.when(_is(kind, n), n), [*list(KINDS)[1:], "integer", "number"], F.when(_is(kind, "object"), "object"))


def _error(path: Column, text: str, *more: Column) -> Column:
    return F.array(F.concat(F.when(path == "", "$").otherwise(path), F.lit(f": {text}"), *more))


def _each(when: Column, error: Column) -> Column:
    return F.when(when, error).otherwise(_none())


def _inner(path: Column, key: str | Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _check(v: Column, s: dict, path: Column, root: dict, refs: tuple[str, ...]) -> Column:
    if "$ref" in s:
        ref = s["$ref"]
        if ref in refs:
            raise ValueError(f"the schema refers to itself: {ref}")
        target: Any = root
        for part in ref.lstrip("#/").split("/"):
            target = target[part]
        return _check(v, target, path, root, (*refs, ref))
    if "allOf" in s:
        return F.concat(*(_check(v, x, path, root, refs) for x in s["allOf"]))
    if "anyOf" in s:
        tried = F.array(*(F.struct(F.size(e).alias("n"), F.lit(i).alias("i"), e.alias("e")) for i, e in enumerate(_check(v, x, path, root, refs) for x in s["anyOf"])))
        return let(F.array_min(tried), lambda best: F.when(best["n"] <= 3, best["e"]).otherwise(_error(path, "matches none of the allowed forms")))
    kind, text = F.schema_of_variant(v), F.to_json(v)
    plain = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    steps: list[tuple[Column, Column]] = []
    if "const" in s:
        steps.append((text != plain(s["const"]), _error(path, f"must be {plain(s['const'])}")))
    if "enum" in s:
        steps.append((~text.isin([plain(x) for x in s["enum"]]), _error(path, f"must be one of {plain(s['enum'])}")))
    if "type" in s:
        types = s["type"] if isinstance(s["type"], list) else [s["type"]]
        steps.append((~reduce(Column.__or__, (_is(kind, t) for t in types)), _error(path, f"expected {' or '.join(types)}, got ", _said(kind))))
    found: list[Column] = []
    if "minimum" in s:
        found.append(_each(_is(kind, "number") & (F.try_variant_get(v, "$", "double") < float(s["minimum"])), _error(path, f"must be {s['minimum']} or more")))
    length = F.char_length(F.try_variant_get(v, "$", "string"))
    if s.get("minLength"):
        found.append(_each(_is(kind, "string") & (length < s["minLength"]), _error(path, "too short")))
    if "maxLength" in s:
        found.append(_each(_is(kind, "string") & (length > s["maxLength"]), _error(path, f"longer than {s['maxLength']} characters")))
    if s.get("required") or s.get("properties") or s.get("additionalProperties") is False:
        found.append(_each(_is(kind, "object"), let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: _fields(m, s, path, root, refs))))
    if "items" in s or s.get("minItems") or "maxItems" in s:
        found.append(_each(_is(kind, "array"), let(F.try_variant_get(v, "$", "array<variant>"), lambda xs: _items(xs, s, path, root, refs))))
    made = F.concat(*found) if found else _none()
    return reduce(lambda rest, step: F.when(step[0], step[1]).otherwise(rest), reversed(steps), made)


def _fields(m: Column, s: dict, path: Column, root: dict, refs: tuple[str, ...]) -> Column:
    known = s.get("properties", {})
    found = [_each(~F.map_contains_key(m, F.lit(k)), F.array(F.concat(_inner(path, k), F.lit(": required")))) for k in s.get("required", [])]

    def field(k: str, sub: dict) -> Column:
        return let(F.struct(F.try_element_at(m, F.lit(k)).alias("v")), lambda x: _check(x["v"], sub, _inner(path, k), root, refs))

    found += [_each(F.map_contains_key(m, F.lit(k)), field(k, sub)) for k, sub in known.items()]
    if s.get("additionalProperties") is False:
        found.append(F.transform(F.filter(F.map_keys(m), lambda k: ~k.isin(list(known))), lambda k: F.concat(_inner(path, k), F.lit(": unexpected field"))))
    return F.concat(*found) if found else _none()


def _items(xs: Column, s: dict, path: Column, root: dict, refs: tuple[str, ...]) -> Column:
    found = []
    if s.get("minItems"):
        found.append(_each(F.size(xs) < s["minItems"], _error(path, f"needs at least {s['minItems']} items")))
    if "maxItems" in s:
        found.append(_each(F.size(xs) > s["maxItems"], _error(path, f"more than {s['maxItems']} items")))
    if "items" in s:
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        found.append(F.flatten(F.transform(xs, lambda x, i: _check(x, s["items"], at(i), root, refs))))
    return F.concat(*found)


def errors(text: Column, schema: dict) -> Column:
    """What is wrong with a JSON text, in the order of the schema; empty if nothing is."""
    parsed = let(F.struct(F.try_parse_json(text).alias("v")), lambda x: F.when(x["v"].isNull(), F.array(F.lit("$: no JSON"))).otherwise(_check(x["v"], schema, F.lit(""), schema, ())))
    return F.when(text.isNotNull(), parsed)
