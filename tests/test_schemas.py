"""A compiled schema against a plain walker over random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions import schemas

SCHEMA = {
    "type": "object", "required": ["id", "units"], "additionalProperties": False,
    "definitions": {"value": {"type": "object", "required": ["value", "page"], "properties": {"value": {"type": ["string", "number", "null"], "maxLength": 6}, "page": {"type": "integer", "minimum": 1}, "kind": {"enum": ["read", "made", 3, None]}}}},
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 5}, "version": {"const": 2}, "flag": {"type": "boolean"}, "odd.name": {"type": "number", "minimum": -1.5},
        "units": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/definitions/value"}},
        "place": {"anyOf": [{"type": "null"}, {"type": "array", "items": {"type": "number"}, "minItems": 2}, {"$ref": "#/definitions/value"}]},
        "both": {"allOf": [{"type": "string"}, {"minLength": 3}]},
    },
}


def walked(x, s, path=""):
    at = path or "$"
    kind = lambda y: "null" if y is None else "boolean" if isinstance(y, bool) else "integer" if isinstance(y, int) else "number" if isinstance(y, float) else {str: "string", list: "array", dict: "object"}[type(y)]
    if "$ref" in s:
        return walked(x, SCHEMA["definitions"][s["$ref"].rpartition("/")[2]], path)
    if "allOf" in s:
        return [e for sub in s["allOf"] for e in walked(x, sub, path)]
    if "anyOf" in s:
        best = min((walked(x, sub, path) for sub in s["anyOf"]), key=len)
        return best if len(best) <= 3 else [f"{at}: matches none of the allowed forms"]
    short = lambda y: json.dumps(y, ensure_ascii=False, separators=(",", ":"))
    if "const" in s and short(x) != short(s["const"]):
        return [f"{at}: must be {short(s['const'])}"]
    if "enum" in s and short(x) not in [short(y) for y in s["enum"]]:
        return [f"{at}: must be one of {short(s['enum'])}"]
    if "type" in s:
        types = s["type"] if isinstance(s["type"], list) else [s["type"]]
        if not any(kind(x) == t or t == "number" and kind(x) == "integer" for t in types):
            return [f"{at}: expected {' or '.join(types)}, got {kind(x)}"]
    out = []
    if kind(x) in ("integer", "number") and x < s.get("minimum", x):
        out.append(f"{at}: must be {s['minimum']} or more")
    if isinstance(x, str):
        out += [f"{at}: too short"] * (len(x) < s.get("minLength", 0)) + [f"{at}: longer than {s.get('maxLength')} characters"] * (len(x) > s.get("maxLength", len(x)))
    if isinstance(x, dict):
        inner = lambda k: f"{path}.{k}" if path else k
        out += [f"{inner(k)}: required" for k in s.get("required", []) if k not in x]
        out += [e for k, sub in s.get("properties", {}).items() if k in x for e in walked(x[k], sub, inner(k))]
        out += [f"{inner(k)}: unexpected field" for k in sorted(x) if k not in s.get("properties", {})] if s.get("additionalProperties") is False else []
    if isinstance(x, list):
        out += [f"{at}: needs at least {s.get('minItems')} items"] * (len(x) < s.get("minItems", 0)) + [f"{at}: more than {s.get('maxItems')} items"] * (len(x) > s.get("maxItems", len(x)))
        out += [e for i, y in enumerate(x) if "items" in s for e in walked(y, s["items"], f"{path}[{i}]")]
    return out


def drawn(r, depth=0):
    value = lambda: {k: v for k, v in (("value", r.choice(["text", "longer text", 1, 1.5, None, True, []])), ("page", r.choice([1, 2, 0, -3, "1", 1.5, None])), ("kind", r.choice(["read", "other", 3, None, 3.5])), ("more", 1)) if r.random() < 0.7}
    made = {"id": r.choice(["ab", "a", "abcdef", 5, None]), "version": r.choice([2, 3, "2"]), "flag": r.choice([True, 0]), "odd.name": r.choice([-2, 0.5, 12345678901234567890]), "units": r.choice([[], [value()], [value() for _ in range(4)], "none", [1]]), "place": r.choice([None, [1, 2.5], [1], value(), "x", ["a", "b", "c", "d"]]), "both": r.choice(["abc", "a", 7])}
    return {k: v for k, v in made.items() if r.random() < 0.8} | ({"other": 1} if r.random() < 0.2 else {})


def test_errors_are_those_of_a_walk(spark):
    r = random.Random(2)
    docs = [drawn(r) for _ in range(150)] + [[], "text", 5, None, {}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(1000, None), (1001, "{broken"), (1002, "")]
    got = {x.i: x.e for x in spark.createDataFrame(rows, "i int, j string").select("i", schemas.errors(F.col("j"), SCHEMA).alias("e")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == walked(d, SCHEMA), rows[i][1]
    assert len({e.split(": ")[1].split(",")[0] for i in range(150) for e in got[i]}) > 9
    assert (got[1000], got[1001], got[1002]) == (None, ["$: no JSON"], ["$: no JSON"])


def test_schemas_that_refer_to_themselves_are_refused():
    with pytest.raises(ValueError, match="refers to itself"):
        schemas.errors(F.lit("1"), {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"})
