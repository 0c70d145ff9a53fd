"""Chat formatting with a proven round trip.

Template of a turn:   ``### Role: text</turn>`` and a line feed, where Role is the
role as given (``### System: ``, ``### User: ``, ``### Assistant: `` for the usual
ones). Inside texts and roles a backslash becomes two, and a control string
(``###``, ``</turn>``, or ``: `` in a role) gets a backslash before it. The parser is a
deterministic automaton over the rendered text. After rendering, each turn
is parsed again and compared with its source; while they differ, more is escaped
(every ``#`` and ``<`` next), until they are identical.

Rows are turns; they stream sorted by conversation and turn, so a task holds one
turn and a few hash states, whatever the length of a conversation. Null texts are
empty, a null role is the empty role, rows with equal turn go by role and text,
a null conv_id is a conversation of its own, other columns are ignored and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LONG, STR, schema

OPEN, CLOSE, SEP, LF = "### ", "</turn>", ": ", "\n"
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _NAMES.items()}
_TEXT = [re.compile(r"\\|(?=###|</turn>)"), re.compile(r"\\|(?=[#<])"), re.compile(r"(?=[\s\S])")]
_ROLE = re.compile(r"\\|(?=[#<: \n])")


def _escape(s: str, how: re.Pattern) -> str:
    return how.sub(lambda m: "\\\\" if m[0] else "\\", s)


def _role_name(role: str) -> str:
    if role in _NAMES:
        return _NAMES[role]
    return ("\\" if role in _ROLES else "") + _escape(role, _ROLE)


class GrammarError(ValueError):
    pass


#: an escaped character, the end, or what may not stand there
_ROLE_END = re.compile(r"\\([\s\S])|(: )")
_TEXT_END = re.compile(r"\\([\s\S])|(</turn>)|(###)")


def _until(s: str, at: int, marks: re.Pattern) -> tuple[str, int]:
    """Unescaped text from ``at`` to the next end of ``marks``, and the place after it: one pass, whatever is escaped."""
    out = []
    for m in marks.finditer(s, at):
        out.append(s[at : m.start()])
        at = m.end()
        if m.lastindex == 2:
            return "".join(out), at
        if m.lastindex == 3:
            raise GrammarError(f"{m[3]!r} inside")
        out.append(m[1])
    raise GrammarError("a part without its end")


def parse(s: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    at = 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        begin = at + len(OPEN)
        role, at = _until(s, begin, _ROLE_END)
        raw = s[begin : at - len(SEP)]
        role = _ROLES.get(raw, role)
        text, at = _until(s, at, _TEXT_END)
        if not s.startswith(LF, at):
            raise GrammarError(f"no line feed at {at}")
        at += len(LF)
        yield role, text


def render_turn(role: str, text: str) -> str:
    """One turn, escaped until its parse is identical to it."""
    for how in _TEXT:
        out = f"{OPEN}{_role_name(role)}{SEP}{_escape(text, how)}{CLOSE}{LF}"
        try:
            if list(parse(out)) == [(role, text)]:
                return out
        except GrammarError:
            pass
    raise GrammarError("no escape brings this turn back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, seq-sorted rows with the rendered turn and whether its text bears loss (the assistant's)."""

    def run(batches):
        for rb in batches:
            role = [x or "" for x in rb.column("role").to_pylist()]
            text = [x or "" for x in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("conv_id"), rb.column("turn"), pa.array([render_turn(r, t) for r, t in zip(role, text, strict=True)], pa.string())], ["conv_id", "turn", "formatted"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, schema(conv_id=LONG, turn=LONG, formatted=STR))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns of each conversation, parsed from the rendered turns (in their order within partitions)."""

    def run(batches):
        key, state, some = None, None, False

        def done():
            turns, sha, chars, loss, total = state
            return {"conv_id": key, "n_turns": turns, "turns_sha256": sha.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for rb in batches:
            out = []
            for conv, line in zip(rb.column("conv_id").to_pylist(), rb.column("formatted").to_pylist(), strict=True):
                if not some or conv != key:
                    if some:
                        out.append(done())
                    some, key, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(line)
                for role, text in parse(line):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
            if out:
                yield batch(out)
        if some:
            yield batch([done()])

    return formatted.mapInArrow(run, schema(conv_id=LONG, n_turns=LONG, turns_sha256=STR, loss_chars=LONG, loss_sha256=STR, formatted_chars=LONG))
