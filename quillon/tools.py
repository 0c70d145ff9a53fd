"""Command-line units: ``python -m quillon.tools sniff|fixture|conformance|cts|roundtrip|fuzz ...``. No Spark here."""

from __future__ import annotations

import json
import random
import sys
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from .functions import filterlang, machine, sniff
from .functions.tokens import TOKEN, minify_text

KINDS = ("ndjson", "array", "nested", "deep", "wide", "bigstring", "dupkeys", "badutf8", "truncated")
_COLOURS, _PLACES = ("red", "green", "blue", "white"), ("north", "south", "east", "west", "centre")


def record(r: random.Random, n: int) -> str:
    """A reading of an imagined sensor: scalars of each kind, an array and an object."""
    return (
        f'{{"n":{n},"at":"2031-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{r.randint(0, 59):02}","sensor":"s{r.randint(0, 999):03}","colour":"{r.choice(_COLOURS)}",'
        f'"level":{r.randint(0, 99)},"value":{r.randint(-500, 500)}.{r.randint(0, 999):03},"valid":{"true" if r.random() < 0.9 else "false"},"note":{"null" if r.random() < 0.5 else json.dumps("seen " + r.choice(_PLACES))},'
        f'"near":["{r.choice(_PLACES)}","{r.choice(_PLACES)}"],"unit":{{"name":"mV","digits":{r.randint(1, 6)},"serial":"{r.getrandbits(64):016x}"}}}}'
    )


def fixture(kind: str, size: int = 100_000, seed: int = 1) -> Iterator[bytes]:
    """Deterministic input of about ``size`` bytes (for deep: levels), in pieces."""
    r = random.Random(seed)
    if kind in ("ndjson", "truncated", "dupkeys", "badutf8"):
        bad = (b"\x80", b"\xe2\x28", b"\xff\xfe")
        n = written = 0
        while written < size:
            if kind == "dupkeys":
                line = ("{" + f'"n":{n},' + ",".join(f'"same":{r.randint(0, 9)},"k{i}":{i}' for i in range(6)) + "}\n").encode()
            elif kind == "badutf8":
                line = f'{{"n":{n},"text":"good '.encode() + r.choice(bad) + b' end"}\n'
            else:
                line = (record(r, n) + "\n").encode()
            yield line
            n, written = n + 1, written + len(line)
        if kind == "truncated":
            last = record(r, n).encode()
            yield last[: len(last) * 2 // 3]
    elif kind == "array":
        yield b"["
        n = written = 0
        while written < size:
            piece = (("," if n else "") + "\n  " + record(r, n)).encode()
            yield piece
            n, written = n + 1, written + len(piece)
        yield b"\n]\n"
    elif kind == "nested":
        yield b'{"trees":['
        n = written = 0
        while written < size:
            depth = r.randint(3, 20)
            piece = ("," if n else "") + "".join(f'{{"depth":{d},"below":' for d in range(depth)) + record(r, n) + "}" * depth
            yield piece.encode()
            n, written = n + 1, written + len(piece)
        yield b"]}\n"
    elif kind == "deep":
        yield b'{"d":[' * size
        yield b"null" + b"]}" * size + b"\n"
    elif kind == "wide":
        yield b"[" + str(r.randint(0, 10**6)).encode()
        for _ in range(size // 6):
            yield b"," + str(r.randint(0, 10**6)).encode()
        yield b"]\n"
    elif kind == "bigstring":
        yield b'{"text":"' + b"0123456789" * (size // 10) + b'"}\n'
    else:
        raise ValueError(f"no such kind: {kind}")


def accepts(b: bytes) -> bool:
    try:
        machine.read_document(b)
    except machine.JsonError:
        return False
    return True


def conformance(folder: str) -> dict[str, list[str]]:
    """A folder of y_*, n_* and i_* files: which answers differ from what the name asks for, and what was chosen for i_."""
    out: dict[str, list[str]] = {"right": [], "wrong": [], "accepted": [], "refused": []}
    for f in sorted(Path(folder).glob("[yni]_*.json")):
        got = accepts(f.read_bytes())
        out[("accepted" if got else "refused") if f.name[0] == "i" else "right" if got == (f.name[0] == "y") else "wrong"].append(f.name)
    return out


def cts(file: str) -> dict[str, list[str]]:
    """A file of JSONPath test cases: filters over the root's children; other selectors are out of scope, invalid ones must be refused."""
    out: dict[str, list[str]] = {"right": [], "wrong": [], "out_of_scope": []}
    for case in json.loads(Path(file).read_text())["tests"]:
        name, selector = case["name"], case["selector"]
        try:
            e = filterlang.parse(selector)
        except filterlang.FilterError:
            out["right" if case.get("invalid_selector") else "out_of_scope"].append(name)
            continue
        if case.get("invalid_selector") or not selector.startswith("$[?"):
            out["wrong" if case.get("invalid_selector") else "out_of_scope"].append(name)
            continue
        document = case["document"]
        kids = list(document.values()) if isinstance(document, dict) else document if isinstance(document, list) else []
        got = []
        for x in kids:
            b = json.dumps(x).encode()
            if filterlang.matches(e, b, machine.read_document(b)):
                got.append(x)
        out["right" if got in case.get("results", [case.get("result")]) else "wrong"].append(name)
    return out


def tokens(text: str) -> list[str]:
    import re

    return re.findall(TOKEN, text, re.S)


def roundtrip(b: bytes) -> bool:
    """Minified and pretty text have the very tokens of the source, in order."""
    node = machine.read_document(b)
    want = tokens(b.decode().lstrip("﻿"))
    return tokens(machine.minify(b, node)) == want == tokens(machine.pretty(b, node)) and minify_text(machine.pretty(b, node)) == machine.minify(b, node)


def fuzz(seconds: float = 1.0, seed: int = 1) -> tuple[int, list[bytes]]:
    """(cases, those on which the reader and Python's differ): three in four are mutations of records, the others random."""
    r, cases, wrong, end = random.Random(seed), 0, [], time.monotonic() + seconds
    alphabet = b'{}[],:"0123456789.eE+-truefalsn \\\n\t\x00\xff\xc3'

    def plain(b: bytes) -> bool:
        try:
            json.loads(b.decode(), parse_constant=lambda c: 1 / 0)
        except (ValueError, RecursionError, ZeroDivisionError):
            return False
        return True

    while time.monotonic() < end:
        if r.random() < 0.75:
            b = bytearray(record(r, cases).encode())
            for _ in range(r.randint(1, 4)):
                b[r.randrange(len(b))] = r.choice(alphabet)
        else:
            b = bytearray(r.choices(alphabet, k=r.randint(0, 24)))
        cases += 1
        if accepts(bytes(b)) != plain(bytes(b)):
            wrong.append(bytes(b))
    return cases, wrong


def main(args: list[str]) -> int:
    def summary(x: dict[str, list[str]]) -> int:
        print(json.dumps({k: len(v) for k, v in x.items()} | {"wrong": x["wrong"]}))
        return 1 if x["wrong"] else 0

    def write(kind: str, path: str, size: str = "100000", seed: str = "1") -> int:
        with open(path, "wb") as f:
            f.writelines(fixture(kind, sniff.parse_size(size), int(seed)))
        return 0

    def each(*files: str) -> int:
        bad = [f for f in files if not roundtrip(Path(f).read_bytes())]
        print(json.dumps({"files": len(files), "wrong": bad}))
        return 1 if bad else 0

    def fuzzed(seconds: str = "10") -> int:
        n, bad = fuzz(float(seconds))
        print(json.dumps({"cases": n, "wrong": [repr(x) for x in bad]}))
        return 1 if bad else 0

    def sniffed(path: str) -> int:
        with open(path, "rb") as f:
            print(sniff.sniff(f.read(sniff.PREFIX)))
        return 0

    units: dict[str, Callable[..., int]] = {"sniff": sniffed, "fixture": write, "conformance": lambda p: summary(conformance(p)), "cts": lambda p: summary(cts(p)), "roundtrip": each, "fuzz": fuzzed}
    if not args or args[0] not in units:
        print(__doc__)
        return 2
    return units[args[0]](*args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
