"""JSON Schema (a 2020-12 subset): compiled once, checked for every record, all failures reported."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import machine
from ..functions.tokens import accepted, kind_name, with_variant
from .core import _ID, _arrow

TYPES = ("null", "boolean", "object", "array", "number", "string", "integer")
UNSUPPORTED = ("pattern", "patternProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "format", "multipleOf", "uniqueItems", "contains", "prefixItems", "dependentSchemas", "propertyNames")


class SchemaError(ValueError):
    pass


class Schema:
    """``Schema(text)``; ``check(bytes)`` gives (offset, message) of each failure; ``unsupported`` lists keywords that are not checked."""

    def __init__(self, source: str | dict | bool):
        try:
            self.root = json.loads(source) if isinstance(source, str) else source
        except ValueError as e:
            raise SchemaError(f"the schema is not valid JSON: {e}") from None
        self.unsupported = sorted({k for s in self._walk(self.root, set()) if isinstance(s, dict) for k in s if k in UNSUPPORTED})

    def _walk(self, s, seen: set):
        if not isinstance(s, dict | bool):
            raise SchemaError("a schema must be an object, or true/false")
        yield s
        if isinstance(s, bool) or id(s) in seen:
            return
        seen.add(id(s))
        t = s.get("type", [])
        if not isinstance(t, str | list) or not all(isinstance(x, str) for x in t):
            raise SchemaError("`type` must be a string or an array of strings")
        for x in [t] if isinstance(t, str) else t:
            if x not in TYPES:
                raise SchemaError(f"unknown type `{x}`")
        if not isinstance(s.get("enum", []), list):
            raise SchemaError("`enum` must be an array")
        if any(isinstance(x, dict | list) for x in [*s.get("enum", []), s.get("const")]):
            raise SchemaError("`const` and `enum` support scalar values only")
        for k in ("properties", "$defs", "definitions"):
            if not isinstance(s.get(k, {}), dict):
                raise SchemaError(f"`{k}` must be an object")
        required = s.get("required", [])
        if not isinstance(required, list) or not all(isinstance(x, str) for x in required):
            raise SchemaError("`required` must be an array of strings")
        for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            if k in s and (isinstance(s[k], bool) or not isinstance(s[k], int | float)):
                raise SchemaError(f"`{k}` must be a number")
        for k in ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
            if k in s and (isinstance(s[k], bool) or not isinstance(s[k], int | float) or s[k] < 0 or s[k] != int(s[k])):
                raise SchemaError(f"`{k}` must be a whole number")
        if "$ref" in s:
            if not isinstance(s["$ref"], str):
                raise SchemaError("`$ref` must be a string")
            self._target(s["$ref"])
        for k in ("properties", "$defs", "definitions"):
            for x in s.get(k, {}).values():
                yield from self._walk(x, seen)
        for k in ("items", "additionalProperties"):
            if k in s:
                yield from self._walk(s[k], seen)

    def _target(self, ref: str):
        if not ref.startswith("#"):
            raise SchemaError(f"`{ref}` is remote; nothing is fetched over the network")
        if ref == "#":
            return self.root
        name = ref.rpartition("/")[2]
        for k in ("$defs", "definitions"):
            if name in self.root.get(k, {}):
                return self.root[k][name]
        raise SchemaError(f"`$ref` target not found: {ref}")

    def check(self, b: bytes) -> list[tuple[int, str]]:
        try:
            node = machine.read_document(b)
        except machine.JsonError as e:
            return [(0, "no JSON value to check against the schema")] if str(e) == machine.MESSAGES["empty"] else []
        out: list[tuple[int, str]] = []
        todo = [(self.root, node)]
        while todo:
            s, n = todo.pop()
            if isinstance(s, dict) and "$ref" in s:
                s = self._target(s["$ref"])
            if s is True:
                continue
            if s is False:
                out.append((n.start, "nothing is allowed here"))
                continue
            self._one(s, n, b, out)
            if n.kind == "object":
                known, extra = s.get("properties", {}), s.get("additionalProperties", True)
                for key, at, child in n.items:
                    if key in known:
                        todo.append((known[key], child))
                    elif extra is False:
                        out.append((at, f"property `{key}` is not allowed here"))
                    elif extra is not True:
                        todo.append((extra, child))
            elif n.kind == "array" and "items" in s:
                todo += [(s["items"], x) for x in n.items]
        return sorted(out)

    def _one(self, s: dict, n, b: bytes, out: list) -> None:
        raw = b[n.start : n.end].decode()
        say = lambda m: out.append((n.start, m))
        kind, value = machine.scalar(b, n)
        name = {"text": "string", "bool": "boolean", "container": n.kind}.get(kind, kind)
        types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
        if types and name not in types and not (name == "number" and "integer" in types):
            say(f"expected {' or '.join(types)}, found {name}")
            return
        if name == "number":
            if "integer" in types and "number" not in types and not float(value).is_integer():
                say(f"expected an integer, found {raw}")
            for k, bad, text in (("minimum", lambda m: value < m, "is less than the minimum"), ("maximum", lambda m: value > m, "is more than the maximum"), ("exclusiveMinimum", lambda m: value <= m, "must be greater than"), ("exclusiveMaximum", lambda m: value >= m, "must be less than")):
                if k in s and bad(s[k]):
                    say(f"{raw} {text} {s[k]}")
        if name == "string":
            if len(value) < s.get("minLength", 0):
                say(f"shorter than the minimum length {s['minLength']}")
            if len(value) > s.get("maxLength", 1 << 60):
                say(f"longer than the maximum length {s['maxLength']}")
        domain = lambda x: "null" if x is None else "bool" if isinstance(x, bool) else "text" if isinstance(x, str) else "number"
        same = lambda x: domain(x) == kind and x == value
        if "const" in s and not same(s["const"]):
            say("not the value that `const` asks for")
        if "enum" in s and not any(same(x) for x in s["enum"]):
            say("not one of the values in `enum`")
        if n.kind == "object":
            keys = {k for k, _, _ in n.items}
            for r in s.get("required", []):
                if r not in keys:
                    say(f"missing required property `{r}`")
        for low, high, what, kind_ in (("minProperties", "maxProperties", "properties", "object"), ("minItems", "maxItems", "items", "array")):
            if n.kind == kind_:
                if len(n.items) < s.get(low, 0):
                    say(f"fewer than {s[low]} {what}")
                if len(n.items) > s.get(high, 1 << 60):
                    say(f"more than {s[high]} {what}")


class _NotNative(Exception):
    """A schema that the native check does not express."""


def conforms(v: Column, s, schema: Schema, open_refs: tuple = ()) -> Column:
    """Whether a variant satisfies a schema, as an expression without Python. It may refuse what is right, never the other way."""
    if "$ref" in s if isinstance(s, dict) else False:
        if s["$ref"] in open_refs:
            raise _NotNative
        return conforms(v, schema._target(s["$ref"]), schema, (*open_refs, s["$ref"]))
    if isinstance(s, bool):
        return F.lit(s)
    bound = F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("s")))  # read once, however often it is used
    return F.transform(bound, lambda x: _conforms(x["v"], kind_name(x["s"]), s, schema, open_refs))[0]


def _conforms(v: Column, kind: Column, s: dict, schema: Schema, open_refs: tuple) -> Column:
    number, string = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    tests: list[Column] = []
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
    if types:
        of = [kind == t for t in types if t != "integer"]
        if "integer" in types:
            of.append((kind == "number") & (number == F.floor(number).cast("double")))
        tests.append(_any(of))
    num = [t for k, t in (("minimum", lambda m: number >= m), ("maximum", lambda m: number <= m), ("exclusiveMinimum", lambda m: number > m), ("exclusiveMaximum", lambda m: number < m)) if k in s for t in [t(float(s[k]))]]
    num and tests.append((kind != "number") | _all(num))
    size = F.char_length(string)
    text = [t(int(s[k])) for k, t in (("minLength", lambda m: size >= m), ("maxLength", lambda m: size <= m)) if k in s]
    text and tests.append((kind != "string") | _all(text))

    def same(x) -> Column:
        if x is None:
            return kind == "null"
        if isinstance(x, bool):
            return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == x)
        return (kind == "string") & (string == x) if isinstance(x, str) else (kind == "number") & (number == float(x))

    if "const" in s:
        tests.append(same(s["const"]))
    if "enum" in s:
        tests.append(_any([same(x) for x in s["enum"]]))
    members = F.try_variant_get(v, "$", "map<string,variant>")
    inside: list[Column] = []

    def absent_or(c: Column, x) -> Column:
        return F.transform(F.array(c), lambda one: one.isNull() | conforms(one, x, schema, open_refs))[0]

    child = lambda name: F.try_variant_get(v, _path(name), "variant")
    inside += [child(r).isNotNull() for r in s.get("required", [])]
    inside += [absent_or(child(k), x) for k, x in s.get("properties", {}).items() if x is not True]
    extra = s.get("additionalProperties", True)
    if extra is not True:
        known = [F.lit(k) for k in s.get("properties", {})]
        other = F.map_filter(members, lambda k, _: ~k.isin(known)) if known else members
        inside.append(F.size(other) == 0 if extra is False else F.forall(F.map_values(other), lambda x: conforms(x, extra, schema, open_refs)))
    inside += [t(int(s[k])) for k, t in (("minProperties", lambda m: F.size(members) >= m), ("maxProperties", lambda m: F.size(members) <= m)) if k in s]
    inside and tests.append((kind != "object") | _all(inside))
    elements = F.try_variant_get(v, "$", "array<variant>")
    rows = [t(int(s[k])) for k, t in (("minItems", lambda m: F.size(elements) >= m), ("maxItems", lambda m: F.size(elements) <= m)) if k in s]
    if "items" in s and s["items"] is not True:
        rows.append(F.forall(elements, lambda x: conforms(x, s["items"], schema, open_refs)))
    rows and tests.append((kind != "array") | _all(rows))
    return F.coalesce(_all(tests), F.lit(False))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _path(name: str) -> str:
    if "'" in name or "\\" in name:
        raise _NotNative
    return f"$['{name}']"


def check_schema(records: DataFrame, schema: Schema | str | dict) -> DataFrame:
    """source, rec, offset, message of each failure; malformed records are left to validate.

    Records that conform by the native expression are done; the others are walked for their messages.
    """
    compiled = schema if isinstance(schema, Schema) else Schema(schema)

    def rows(s, r, b, base, line):
        for at, message in compiled.check(b):
            yield s, r, base + at, message

    text = F.col("text")
    try:
        fine = with_variant(text, lambda v: accepted(v, text) & F.coalesce(conforms(F.try_variant_get(v, "$[0]", "variant"), compiled.root, compiled), F.lit(False)))
        records = records.where(~F.coalesce(fine, F.lit(False)))
    except _NotNative:
        pass
    return _arrow(records, f"{_ID}, offset bigint, message string", rows)
