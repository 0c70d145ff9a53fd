"""Format detection on a prefix, and display helpers. Pure Python."""

from __future__ import annotations

import re

PREFIX = 64 * 1024
_VALUE = re.compile(rb'(?:[{\["]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s,\]}]|$)|(?:true|false|null)(?=[\s,\]}]|$))')


def starts_value(line: bytes) -> bool:
    """Whether the line's first token is a JSON value's first token (``2026-07-27 INFO`` is none)."""
    return bool(_VALUE.match(line.lstrip(b" \t\r")))


def sniff(prefix: bytes) -> str:
    """document, ndjson, empty or unknown."""
    b = prefix[:PREFIX].removeprefix(b"\xef\xbb\xbf")
    if not b.strip(b" \t\r\n"):
        return "empty"
    lines = [x for x in b.split(b"\n") if x.strip(b" \t\r")]
    if not starts_value(lines[0]):
        return "unknown"
    if lines[0].strip() in (b"[", b"{"):
        return "document"
    flush = [x for x in lines if x[:1] not in (b" ", b"\t") and starts_value(x)]
    return "ndjson" if len(flush) >= 2 else "document"


def human_bytes(n: int) -> str:
    x, units = float(n), ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    while x >= 1024 and len(units) > 1:
        x, units = x / 1024, units[1:]
    return f"{int(x)} B" if units[0] == "B" else f"{x:.1f} {units[0]}"


def parse_size(s: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgtp]?)i?b?\s*", s, re.I)
    if not m:
        raise ValueError(f"not a size: {s!r}")
    return int(float(m[1]) * 1024 ** " kmgtp".index(m[2].lower() or " "))


def grouped(n: int) -> str:
    return f"{n:,}"


def count_of(n: int, exact: bool = True) -> str:
    return "empty" if exact and not n else f"{grouped(n)}{'' if exact else '+'} item{'' if n == 1 and exact else 's'}"


def summary_of(kind: str, fields: str, more: bool) -> str:
    """A row's one line: containers in their brackets."""
    a, z = {"object": ("{ ", " }"), "array": ("[ ", " ]")}.get(kind, ("", ""))
    return f"{a}{fields}{', …' if more and fields else ''}{z}" if a and fields else (a + z).replace("  ", "") if a else fields + ("…" if more else "")


def share_of(part: int, whole: int) -> str:
    return "–" if not whole else f"{100 * part / whole:.1f} %"


def rate(n_bytes: int, seconds: float) -> str:
    return "–" if seconds <= 0 else f"{human_bytes(int(n_bytes / seconds))}/s"


def human_duration(seconds: float) -> str:
    for unit, size in (("ns", 1e-6), ("µs", 1e-3), ("ms", 1.0)):
        if seconds * 1000 < size * 1000:
            return f"{seconds * 1000 / size:.0f} {unit}"
    return f"{seconds:.2f} s" if seconds < 60 else f"{int(seconds // 60)} min {int(seconds % 60)} s"


def find_status(matches: int, rows: int, current: int | None, limited: bool, literal: bool) -> str:
    """What a search says of itself; only a literal search that stopped at its limit has a plus."""
    if not matches:
        return "no matches"
    more = "+" if limited and literal else ""
    place = f"{grouped(current + 1)} of " if current is not None else ""
    what = "match" if matches == 1 and not more else "matches"
    return f"{place}{grouped(matches)}{more} {what}" + (f" in {grouped(rows)} row{'' if rows == 1 else 's'}" if literal and rows != matches else "")
