"""The record filter language: JSONPath-style conditions, compiled to a Column or matched in Python.

``or`` binds weakest, then ``and``, then ``!``. ``@`` and ``$`` are the record. A
missing path is nothing, which differs from null: only ``!=`` is true for it.
Ordering needs equal kinds; containers are never comparable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import accepted, kind_name, with_variant

_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
_NUM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_NAME = re.compile(r"[\w-]+")
_FUNCTIONS = ("length", "count", "match", "search")


class FilterError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (at character {at + 1})")
        self.at = at


@dataclass(frozen=True)
class Exists:
    path: tuple


@dataclass(frozen=True)
class Compare:
    path: tuple
    op: str
    kind: str  # null, bool, number, text
    value: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    parts: tuple


class _Parser:
    def __init__(self, s: str):
        self.s, self.i = s, 0

    def space(self):
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def take(self, token: str) -> bool:
        self.space()
        if self.s.startswith(token, self.i):
            self.i += len(token)
            return True
        return False

    def fail(self, message: str):
        raise FilterError(message, self.i)

    def whole(self):
        self.space()
        m = re.match(r"\$\[\?", self.s[self.i :])
        if m:
            self.i += m.end()
            e = self.either()
            if not self.take("]"):
                self.fail("expected `]`")
        else:
            e = self.either()
        self.space()
        if self.i < len(self.s):
            self.fail("unexpected text after the expression")
        return e

    def chain(self, op: str, tokens: tuple, part):
        parts = [part()]
        while any(self.take(t) for t in tokens):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Both(op, tuple(parts))

    def either(self):
        return self.chain("or", ("||", "or "), self.every)

    def every(self):
        return self.chain("and", ("&&", "and "), self.unary)

    def unary(self):
        self.space()
        if self.s.startswith("!=", self.i):
            self.fail("expected a path, a literal or `(`")
        return Not(self.unary()) if self.take("!") else self.primary()

    def primary(self):
        if self.take("("):
            e = self.either()
            if not self.take(")"):
                self.fail("expected `)`")
            return e
        self.space()
        if self.i < len(self.s) and self.s[self.i] in "@$":
            path = self.path()
            op = self.op()
            return Compare(path, op, *self.literal()) if op else Exists(path)
        kind, value = self.literal()
        op = self.op()
        if not op:
            self.fail("expected a comparison")
        self.space()
        if self.i >= len(self.s) or self.s[self.i] not in "@$":
            self.fail("expected a path")
        return Compare(self.path(), _FLIP[op], kind, value)

    def op(self):
        return next((o for o in ("==", "!=", "<=", ">=", "<", ">") if self.take(o)), None)

    def path(self) -> tuple:
        self.i += 1
        steps: list = []
        while self.i < len(self.s):
            if self.s.startswith("..", self.i):
                self.fail("descendants (`..`) are not supported")
            if self.s[self.i] == ".":
                self.i += 1
                if self.s[self.i : self.i + 1] == "*":
                    self.fail("wildcards are not supported")
                m = _NAME.match(self.s, self.i)
                if not m:
                    self.fail("expected a name")
                if self.s.startswith("(", m.end()):
                    self.fail("functions are not supported")
                steps.append(m[0])
                self.i = m.end()
            elif self.s[self.i] == "[":
                self.i += 1
                self.space()
                c = self.s[self.i : self.i + 1]
                if c == "*":
                    self.fail("wildcards are not supported")
                if c == "?":
                    self.fail("nested filters are not supported")
                if c and c in "'\"":
                    steps.append(self.string())
                else:
                    m = re.compile(r"[0-9]+").match(self.s, self.i)
                    if not m:
                        self.fail("expected an index or a quoted name")
                    if len(m[0]) > 1 and m[0][0] == "0" or int(m[0]) >= 1 << 31:
                        self.fail("not an index")
                    steps.append(int(m[0]))
                    self.i = m.end()
                    self.space()
                    if self.s.startswith(":", self.i):
                        self.fail("slices are not supported")
                if not self.take("]"):
                    self.fail("expected `]`")
            else:
                break
        return tuple(steps)

    def string(self) -> str:
        quote = self.s[self.i]
        self.i += 1
        out = []
        while self.i < len(self.s) and self.s[self.i] != quote:
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
                if self.i >= len(self.s):
                    break
                c = {"n": "\n", "t": "\t"}.get(self.s[self.i], self.s[self.i])
            out.append(c)
            self.i += 1
        if self.i >= len(self.s):
            self.fail("a string without its end")
        self.i += 1
        return "".join(out)

    def literal(self):
        self.space()
        c = self.s[self.i : self.i + 1]
        if c and c in "'\"":
            return "text", self.string()
        if c and c in "@$":
            self.fail("a path can only be compared with a literal")
        for word, kind, value in (("true", "bool", True), ("false", "bool", False), ("null", "null", None)):
            if re.compile(rf"{word}(?![\w(])").match(self.s, self.i):
                self.i += len(word)
                return kind, value
        if any(self.s.startswith(f"{f}(", self.i) for f in _FUNCTIONS):
            self.fail("functions are not supported")
        m = _NUM.match(self.s, self.i)
        if not m or self.s[m.end() : m.end() + 1].isalnum() or self.s[m.end() : m.end() + 1] == ".":
            self.fail("expected a literal")
        self.i = m.end()
        return "number", float(m[0])


def parse(source: str):
    return _Parser(source).whole()


def paths(e) -> list[tuple]:
    """The distinct paths of an expression, in order."""
    if isinstance(e, Exists | Compare):
        return [e.path]
    inner = [e.inner] if isinstance(e, Not) else e.parts
    return list(dict.fromkeys(p for x in inner for p in paths(x)))


def variant_path(steps: tuple, root: str = "$") -> str:
    out = root
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else f"['{s}']"
    return out


def simple(e) -> bool:
    """Whether every name can be written in a variant path."""
    return all(isinstance(s, int) or not re.search(r"['\\\]]", s) for p in paths(e) for s in p)


def to_column(e, read: dict[tuple, Column]) -> Column:
    """A predicate over what is read at each path (``v``: a variant, ``s``: its schema) that is never NULL."""
    if isinstance(e, Not):
        return ~to_column(e.inner, read)
    if isinstance(e, Both):
        out = None
        for x in e.parts:
            c = to_column(x, read)
            out = c if out is None else (out & c if e.op == "and" else out | c)
        return out
    x = read[e.path]["v"]
    if isinstance(e, Exists):
        return x.isNotNull()
    kind = kind_name(read[e.path]["s"])
    if e.kind == "null":
        same, eq, less = kind == "null", F.lit(True), F.lit(False)
    else:
        want, spark = {"number": ("number", "double"), "text": ("string", "string"), "bool": ("boolean", "boolean")}[e.kind]
        got = F.try_variant_get(x, "$", spark)
        same, eq, less = kind == want, got == F.lit(e.value), got < F.lit(e.value)
    same, eq, less = (F.coalesce(c, F.lit(False)) for c in (same, eq, less))
    return {"==": same & eq, "!=": ~(same & eq), "<": same & less, "<=": same & (less | eq), ">": same & ~less & ~eq, ">=": same & ~less}[e.op]


def predicate(e, text: Column) -> tuple[Column, Column]:
    """(whether the native parser accepts the record, whether it then matches)."""
    both = checked(e, text)
    return both["ok"], both["hit"]


def checked(e, text: Column, root: str = "$[0]") -> Column:
    """ok and hit, with one parse of the record and one reading of each path."""
    where = list(dict.fromkeys(paths(e)))

    def within(v: Column) -> Column:
        got = [F.try_variant_get(v, variant_path(p, root), "variant") for p in where]
        read = F.struct(*[F.struct(x.alias("v"), F.schema_of_variant(x).alias("s")).alias(f"p{i}") for i, x in enumerate(got)])
        return F.transform(F.array(read), lambda r: F.struct(accepted(v, text).alias("ok"), to_column(e, {p: r[f"p{i}"] for i, p in enumerate(where)}).alias("hit")))[0]

    return with_variant(text, within)


def _find(b: bytes, node, path: tuple):
    for s in path:
        if isinstance(s, int):
            if node.kind != "array" or s >= len(node.items):
                return None
            node = node.items[s]
        else:
            if node.kind != "object":
                return None
            node = next((n for k, _, n in node.items if k == s), None)  # the first of equal keys
            if node is None:
                return None
    return node


def matches(e, b: bytes, root) -> bool:
    """The same condition over a parsed record."""
    from .machine import scalar

    if isinstance(e, Not):
        return not matches(e.inner, b, root)
    if isinstance(e, Both):
        return (all if e.op == "and" else any)(matches(x, b, root) for x in e.parts)
    node = _find(b, root, e.path)
    if isinstance(e, Exists):
        return node is not None
    kind, value = scalar(b, node) if node is not None else (None, None)
    same = kind == e.kind
    eq = same and value == e.value
    if e.op in ("==", "!="):
        return eq == (e.op == "==")
    if not same:
        return False
    if kind == "null":
        return e.op in ("<=", ">=")
    if kind == "text":
        value, want = value.encode(), e.value.encode()
    else:
        want = e.value
    return {"<": value < want, "<=": value <= want, ">": value > want, ">=": value >= want}[e.op]
