"""A strict, iterative JSON reader over bytes: exact spans, exact error positions, any depth up to a limit.

It is the authority for records that the native check rejects. No Spark here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_DEPTH = 1_000_000
# The messages that users of such a validator know.
MESSAGES = {
    "start": "{0} cannot start a JSON value",
    "zero": "numbers may not have leading zeros",
    "number": "{0} is not valid inside a number",
    "literal": "expected `{1}`, found {0}",
    "control": "unescaped control character {0} in string (write it as \\u{1})",
    "escape": "{0} is not a valid escape after a backslash",
    "hex": "{0} is not a hexadecimal digit in a \\u escape",
    "utf8": "{0} is not valid UTF-8 here",
    "eof": "input ended inside a {0}",
    "unexpected": "expected {1}, found {0}",
    "mismatched": "{0} closes an {2}, but an {1} is open",
    "trailing": "a second top-level value; this input was read as a single document",
    "deep": "nesting deeper than the limit of {0}",
    "unclosed": "input ended with {0} container(s) unclosed, innermost an {1}",
    "incomplete": "input ended where {0} was expected",
    "empty": "no JSON value: the document is empty",
}
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
_SPACE = re.compile(rb"[ \t\r\n]*")
_WORDS = {0x74: (b"true", "true"), 0x66: (b"false", "false"), 0x6E: (b"null", "null")}
_MARKS = {0x7B: "`{{`", 0x7D: "`}}`", 0x5B: "`[`", 0x5D: "`]`", 0x2C: "`,`", 0x3A: "`:`"}


class JsonError(ValueError):
    def __init__(self, offset: int, kind: str, *args):
        super().__init__(MESSAGES[kind].format(*args).replace("{{", "{").replace("}}", "}"))
        self.offset = offset


@dataclass(slots=True)
class Node:
    """A value: kind, span [start, end), and for containers its members (key, key_start, Node) or elements."""

    kind: str
    start: int
    end: int = -1
    items: list = field(default_factory=list)


def byte_name(b: int) -> str:
    return f"`{chr(b)}`" if 0x21 <= b < 0x7F else f"byte 0x{b:02x}"


def _string_end(b: bytes, at: int) -> int:
    """End (after the quote) of the string that opens at ``at``."""
    i = at + 1
    while True:
        i = _PLAIN.match(b, i).end()
        if i >= len(b):
            raise JsonError(len(b), "eof", "string")
        c = b[i]
        if c == 0x22:
            break
        if c < 0x20:
            raise JsonError(i, "control", byte_name(c), f"{c:04x}")
        if i + 1 >= len(b):
            raise JsonError(len(b), "eof", "string")
        e = b[i + 1]
        if e == 0x75:
            for k in range(i + 2, i + 6):
                if k >= len(b):
                    raise JsonError(len(b), "eof", "string")
                if b[k] not in b"0123456789abcdefABCDEF":
                    raise JsonError(k, "hex", byte_name(b[k]))
            i += 6
        elif e in b'"\\/bfnrt':
            i += 2
        else:
            raise JsonError(i + 1, "escape", byte_name(e))
    try:
        b[at : i + 1].decode("utf-8")
    except UnicodeDecodeError as err:
        raise JsonError(at + err.start, "utf8", byte_name(b[at + err.start])) from None
    return i + 1


def _number_end(b: bytes, at: int) -> int:
    m = _NUMBER.match(b, at)
    end = m.end() if m else at + (b[at] == 0x2D)
    if m and b[end - 1] == 0x30 and (end - at == 1 or end - at == 2 and b[at] == 0x2D) and end < len(b) and 0x30 <= b[end] <= 0x39:
        raise JsonError(end, "zero")
    if not m or end < len(b) and b[end] in b"0123456789.eE+-":
        at_bad = end
        if m and end < len(b) and b[end] in b".eE":
            at_bad = end + 1
            if at_bad < len(b) and b[end] in b"eE" and b[at_bad] in b"+-":
                at_bad += 1
        if at_bad >= len(b):
            raise JsonError(len(b), "eof", "number")
        raise JsonError(at_bad, "number", byte_name(b[at_bad]))
    if end < len(b) and b[end] not in b" \t\r\n,]}:":
        raise JsonError(end, "number", byte_name(b[end]))
    return end


def _what(b: bytes, at: int) -> str:
    c = b[at]
    return _MARKS.get(c, "a string" if c == 0x22 else "a number" if c == 0x2D or 0x30 <= c <= 0x39 else "a literal" if c in _WORDS else byte_name(c))


def read_value(b: bytes, at: int = 0, depth_limit: int = MAX_DEPTH) -> tuple[Node, int]:
    """The value that starts at or after ``at``, and its end."""
    stack: list[Node] = []
    state, pending = "value", None  # value, first (value or end), key, first_key, colon, after
    while True:
        at = _SPACE.match(b, at).end()
        if at >= len(b):
            if stack:
                if state in ("after", "first", "first_key"):
                    raise JsonError(len(b), "unclosed", len(stack), stack[-1].kind)
                raise JsonError(len(b), "incomplete", {"colon": "`:`", "key": "a property name"}.get(state, "a value"))
            raise JsonError(len(b), "incomplete", "a value")
        c = b[at]
        if c in (0x7D, 0x5D):
            if not stack or state not in ("after", "first", "first_key"):
                raise JsonError(at, "unexpected", _what(b, at), {"colon": "`:`", "key": "a property name"}.get(state, "a value"))
            if (c == 0x7D) != (stack[-1].kind == "object"):
                raise JsonError(at, "mismatched", _what(b, at), stack[-1].kind, "object" if c == 0x7D else "array")
            at += 1
            node = stack.pop()
            node.end = at
        elif state == "after":
            if c != 0x2C:
                raise JsonError(at, "unexpected", _what(b, at), "`,` or the end of the container")
            at, state = at + 1, "key" if stack[-1].kind == "object" else "value"
            continue
        elif state in ("key", "first_key"):
            if c != 0x22:
                raise JsonError(at, "unexpected", _what(b, at), "a property name")
            end = _string_end(b, at)
            pending, at, state = (at, end), end, "colon"
            continue
        elif state == "colon":
            if c != 0x3A:
                raise JsonError(at, "unexpected", _what(b, at), "`:`")
            at, state = at + 1, "value"
            continue
        else:
            if c in (0x7B, 0x5B):
                node = Node("object" if c == 0x7B else "array", at)
                _add(stack, node, pending, b)
                stack.append(node)
                if len(stack) > depth_limit:
                    raise JsonError(at, "deep", depth_limit)
                at, state = at + 1, "first_key" if c == 0x7B else "first"
                continue
            if c == 0x22:
                node = Node("string", at, _string_end(b, at))
            elif c == 0x2D or 0x30 <= c <= 0x39:
                node = Node("number", at, _number_end(b, at))
            elif c in _WORDS:
                word, kind = _WORDS[c]
                for k, w in enumerate(word):
                    if at + k >= len(b):
                        raise JsonError(len(b), "eof", "literal")
                    if b[at + k] != w:
                        raise JsonError(at + k, "literal", byte_name(b[at + k]), word.decode())
                node = Node(kind, at, at + len(word))
            elif c in _MARKS:
                raise JsonError(at, "unexpected", _what(b, at), "a value")
            else:
                raise JsonError(at, "start", byte_name(c))
            at = node.end
            _add(stack, node, pending, b)
        if not stack:
            return node, at
        state = "after"


def _add(stack: list, node: Node, pending, b: bytes) -> None:
    if stack:
        top = stack[-1]
        top.items.append((unescape(b[pending[0] : pending[1]]), pending[0], node) if top.kind == "object" else node)


def read_document(b: bytes) -> Node:
    """One value and nothing else (a byte order mark may stand before it)."""
    at = 3 if b.startswith(b"\xef\xbb\xbf") else 0
    if _SPACE.match(b, at).end() == len(b):
        raise JsonError(0, "empty")
    node, end = read_value(b, at)
    end = _SPACE.match(b, end).end()
    if end < len(b):
        if b[end] in _MARKS and b[end] not in b"{[":
            raise JsonError(end, "unexpected", _what(b, end), "the end of the input")
        raise JsonError(end, "trailing")
    return node


_ESC = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(["\\/bfnrt]))')
_SHORT = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescape(token: bytes) -> str:
    """A string token's text; lone surrogates become U+FFFD."""
    s = token[1:-1].decode("utf-8", "replace")
    if "\\" not in s:
        return s
    s = _ESC.sub(lambda m: chr(int(m[1], 16)) if m[1] else _SHORT[m[2]], s)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def scalar(b: bytes, node: Node):
    """(kind, value) of the query domain: null, bool, number, text, container."""
    k = node.kind
    if k == "string":
        return "text", unescape(b[node.start : node.end])
    if k == "number":
        return "number", float(b[node.start : node.end])
    if k in ("true", "false"):
        return "bool", k == "true"
    return ("null", None) if k == "null" else ("container", None)


def minify(b: bytes, node: Node) -> str:
    """The value's own tokens without the space between them (iterative)."""
    from .tokens import minify_text

    return minify_text(b[node.start : node.end].decode("utf-8"))


PREVIEW, FIELD = 120, 24  # characters of a row's preview, and of one text in it


def _short(s: str, most: int) -> str:
    return s if len(s) <= most else s[:most] + "…"


def preview(b: bytes, node: Node) -> tuple[str, bool]:
    """(``id: 0, tags: […]``, whether more was left out): the first members or elements, or a scalar's text."""
    if node.kind not in ("object", "array"):
        s = unescape(b[node.start : node.end]) if node.kind == "string" else b[node.start : node.end].decode()
        return s[:PREVIEW], len(s) > PREVIEW
    out, size = [], 0
    for it in node.items:
        if size >= PREVIEW:
            return ", ".join(out), True
        key, child = (it[0], it[2]) if node.kind == "object" else (None, it)
        if child.kind in ("object", "array"):
            s = "{…}" if child.kind == "object" else "[…]"
        elif child.kind == "string":
            s = f'"{_short(unescape(b[child.start : child.end]), FIELD)}"'
        else:
            s = b[child.start : child.end].decode()
        out.append(s if key is None else f"{_short(key, FIELD)}: {s}")
        size += len(out[-1]) + (2 if len(out) > 1 else 0)
    return ", ".join(out), False


def begins_value(b: bytes) -> bool:
    """Whether a value begins before the text goes wrong: a container opens, or a scalar is complete."""
    at = _SPACE.match(b, 3 if b.startswith(b"\xef\xbb\xbf") else 0).end()
    if b[at : at + 1] in (b"{", b"["):
        return True
    try:
        read_value(b, at)
    except JsonError:
        return False
    return True


def pretty(b: bytes, node: Node, indent: int = 2) -> str:
    out: list[str] = []
    todo: list = [(node, 0)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        n, depth = x
        if n.kind not in ("object", "array") or not n.items:
            out.append({"object": "{}", "array": "[]"}.get(n.kind) or b[n.start : n.end].decode())
            continue
        pad = "\n" + " " * (indent * (depth + 1))
        out.append("{" if n.kind == "object" else "[")
        rest: list = []
        for i, it in enumerate(n.items):
            rest.append(("," if i else "") + pad)
            if n.kind == "object":
                end = _string_end(b, it[1])
                rest += [b[it[1] : end].decode() + ": ", (it[2], depth + 1)]
            else:
                rest.append((it, depth + 1))
        rest.append("\n" + " " * (indent * depth) + ("}" if n.kind == "object" else "]"))
        todo += reversed(rest)
    return "".join(out)
