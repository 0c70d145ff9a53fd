"""Records: (source, rec, line, start, stop, raw, text), from a column, from NDJSON files, from documents, or from a text.

``start``/``stop`` are byte offsets in the file; ``rec`` counts non-blank lines from 0,
``line`` all lines from 1. Files are cut into byte ranges that are read in
parallel, block by block; ordinals are prefix sums of the ranges' counts (one small row a range),
which are the index: a slice reads only the ranges that hold it. The children of a document's root are its
records; a member's ``key`` is told, ``start`` is where its value begins and ``row_start`` where its key does.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import machine
from ..functions.sniff import PREFIX, sniff

SCHEMA = "source string, part int, seq bigint, lines bigint, start bigint, stop bigint, raw binary"
CHILD = "source string, rec bigint, line bigint, start bigint, stop bigint, row_start bigint, key string, raw binary"
SUFFIXES = (".json", ".ndjson", ".jsonl")
BLOCK, MOST_RANGES = 4 << 20, 100_000
_BLANK, _BOM = b" \t\r\n", b"\xef\xbb\xbf"


def from_column(df: DataFrame, text: str, key: str | Column, source: str = "") -> DataFrame:
    """Records of a table's JSON column; ``key`` is the record number. Null texts are no records."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(source).alias("source"), key.cast("long").alias("rec"), F.col(text).cast("string").alias("text")).where("text is not null")


def from_texts(spark: SparkSession, texts: list[str], source: str = "") -> DataFrame:
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source string, rec bigint, text string")


# ---------------------------------------------------------------- paths
def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def expand(path: str | list[str]) -> list[str]:
    """The files of a path: itself, a folder's .json, .ndjson and .jsonl by name, a pattern's (in the last part), or each of a list."""
    from pyarrow import fs

    if isinstance(path, list):
        return [f for p in path for f in expand(p)]
    head, _, last = path.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    store, at = _store(head if pattern else path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    given = head if pattern else path.rstrip("/")
    found = [x for x in store.get_file_info(fs.FileSelector(at, recursive=False)) if x.type == fs.FileType.File]
    return sorted(f"{given}/{x.base_name}" for x in found if (fnmatch.fnmatchcase(x.base_name, pattern) if pattern else x.base_name.endswith(SUFFIXES)))


def sniff_path(path: str | list[str]) -> str:
    """The format of the first file that is not empty, from its first 64 KiB."""
    for file in expand(path):
        store, at = _store(file)
        with store.open_input_file(at) as f:
            kind = sniff(f.read(PREFIX))
        if kind != "empty":
            return kind
    return "empty"


# ---------------------------------------------------------------- lines
class _Range(InputPartition):
    def __init__(self, path: str, part: int, a: int, b: int):
        self.path, self.part, self.a, self.b = path, part, a, b


def _blocks(f, a: int, b: int) -> Iterator[tuple[int, list[bytes]]]:
    """The lines that begin in [a, b), a block at a time: the first one's offset, and the lines without their line feeds."""
    at, held, skip = max(0, a - 1), [], a > 0
    f.seek(at)
    while block := f.read(BLOCK):
        if skip:  # the line that runs into this range is the one before's
            k = block.find(b"\n")
            if k < 0:
                at += len(block)
                continue
            block, at, skip = block[k + 1 :], at + k + 1, False
            if at >= b:
                return
        k = block.rfind(b"\n")
        if k < 0:
            held.append(block)
            continue
        body = b"".join([*held, block[:k]])
        held = [block[k + 1 :]]
        yield at, body.split(b"\n")
        at += len(body) + 1
        if at >= b:
            return
    last = b"".join(held)
    if last and not skip:
        yield at, [last]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = json.loads(options["paths"]) if "paths" in options else options["path"]
        self.size = int(options.get("rangebytes", 32 << 20))
        self.parts = set(json.loads(options["parts"])) if "parts" in options else None
        self.totals = options.get("totals") == "true"

    def partitions(self):
        files = [(f, store.get_file_info(at).size or 0) for f in expand(self.path) for store, at in [_store(f)]]
        size = max(self.size, -(-sum(n for _, n in files) // MOST_RANGES))
        out: list[_Range] = []
        for f, n in files:
            out += [_Range(f, len(out) + i, a, min(n, a + size)) for i, a in enumerate(range(0, max(1, n), size))]
        return [r for r in out if self.parts is None or r.part in self.parts] or [_Range("", 0, 0, 0)]

    def read(self, r: _Range) -> Iterator[pa.RecordBatch]:
        if r.b <= r.a:
            return
        store, at = _store(r.path)
        seq = lines = 0
        with store.open_input_file(at) as f:
            for at, block in _blocks(f, r.a, r.b):
                numbers, starts, raws = [], [], []
                for raw in block:
                    if at >= r.b:
                        break
                    begin, at, lines = at, at + len(raw) + 1, lines + 1
                    if begin == 0 and raw.startswith(_BOM):
                        raw, begin = raw[3:], 3
                    body = raw.strip(_BLANK)
                    if body:
                        numbers.append(lines)
                        starts.append(begin if raw[0] not in _BLANK else begin + len(raw) - len(raw.lstrip(_BLANK)))
                        raws.append(body)
                n = len(raws)
                if n and not self.totals:
                    start = np.array(starts, np.int64)
                    stop = start + np.fromiter(map(len, raws), np.int64, n)
                    yield self.batch(r, seq + np.arange(n), np.array(numbers, np.int64), start, stop, pa.array(raws, pa.binary()))
                seq += n
        one = np.ones(1, np.int64)
        yield self.batch(r, -one, lines * one, seq * one, 0 * one, pa.nulls(1, pa.binary()))  # the range's totals

    @staticmethod
    def batch(r: _Range, seq, lines, start, stop, raw) -> pa.RecordBatch:
        n = len(seq)
        cols = [pa.array([r.path] * n, pa.string()), pa.array(np.full(n, r.part, np.int32)), *(pa.array(x.astype(np.int64)) for x in (seq, lines, start, stop)), raw]
        return pa.RecordBatch.from_arrays(cols, ["source", "part", "seq", "lines", "start", "stop", "raw"])


class NdjsonSource(DataSource):
    """``spark.read.format("quillon_ndjson").load(path)``: lines with exact byte spans."""

    @classmethod
    def name(cls) -> str:
        return "quillon_ndjson"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Index:
    """Where each byte range's records begin: (part, first record, first line, records)."""

    paths: list[str]
    range_bytes: int
    parts: list[tuple[int, int, int, int]]

    @property
    def records(self) -> int:
        """Records of all files (ordinals begin anew with each)."""
        return sum(p[3] for p in self.parts)


def _read(spark: SparkSession, paths: list[str], range_bytes: int, **options: str) -> DataFrame:
    spark.dataSource.register(NdjsonSource)
    return spark.read.format("quillon_ndjson").options(paths=json.dumps(paths), rangeBytes=str(range_bytes), **options).load()


def index(spark: SparkSession, path: str | list[str], range_bytes: int = 32 << 20) -> Index:
    """Count the files' lines and records, one pass that keeps no record."""
    paths = expand(path)
    rec, line, last, parts = 0, 0, None, []
    rows = _read(spark, paths, range_bytes, totals="true").where("seq = -1") if paths else None
    for r in rows.select("source", "part", "lines", F.col("start").alias("n")).orderBy("part").collect() if paths else []:  # one row a range
        if r.source != last:
            rec, line, last = 0, 0, r.source
        parts.append((r.part, rec, line, r.n))
        rec, line = rec + r.n, line + r.lines
    return Index(paths, range_bytes, parts)


def from_ndjson(spark: SparkSession, path: str | list[str] | Index, range_bytes: int = 32 << 20, start: int = 0, count: int | None = None) -> DataFrame:
    """Records of NDJSON files; with ``count``, of each file those from ``start`` on, from the ranges that hold them."""
    at = path if isinstance(path, Index) else index(spark, path, range_bytes)
    parts = [p for p in at.parts if count is None or p[1] < start + count and start < p[1] + p[3]]
    empty = "source string, rec bigint, line bigint, start bigint, stop bigint, raw binary, text string"
    if not parts:
        return spark.createDataFrame([], empty)
    rows = _read(spark, at.paths, at.range_bytes, **({} if count is None else {"parts": json.dumps([p[0] for p in parts])}))
    firsts = spark.createDataFrame([p[:3] for p in parts], "part int, rec0 bigint, line0 bigint")
    out = rows.where("seq >= 0").join(F.broadcast(firsts), "part")  # MOST_RANGES rows at most
    text = F.col("raw").cast("string")
    out = out.select("source", (F.col("rec0") + F.col("seq")).alias("rec"), (F.col("line0") + F.col("lines")).alias("line"), "start", "stop", "raw", F.when(F.is_valid_utf8(text), text).alias("text"))
    return out if count is None else out.where((F.col("rec") >= start) & (F.col("rec") < start + count))


# ---------------------------------------------------------------- documents
def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One record a file: the whole document."""
    rows = spark.read.format("binaryFile").load(expand(path))
    raw = F.col("content")
    skip = F.when(F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF")), 3).otherwise(0)
    body = F.expr("substring(content, (CASE WHEN substring(content, 1, 3) = X'EFBBBF' THEN 3 ELSE 0 END) + 1)")
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    return rows.select(F.col("path").alias("source"), F.lit(0).cast("long").alias("rec"), F.lit(1).cast("long").alias("line"), skip.cast("long").alias("start"), F.col("length").alias("stop"), body.alias("raw"), text.alias("text"))


_MARK = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{},:]', re.S)


def _no(name: str):
    raise ValueError(name)


def children(b: bytes) -> list[tuple[str | None, int, int, int]] | None:
    """(key, where the row begins, where the value does, its end) of the root's members or elements; None: no container, or not well-formed."""
    body = b.strip(_BLANK)
    if body[:1] not in (b"[", b"{"):
        return None
    try:
        json.loads(body, parse_constant=_no)
    except (ValueError, RecursionError):  # what this check refuses may still be legal
        try:
            root = machine.read_document(b)
        except machine.JsonError:
            return None
        return [(it[0], it[1], it[2].start, it[2].end) if root.kind == "object" else (None, it.start, it.start, it.end) for it in root.items]
    out: list[tuple[str | None, int, int, int]] = []
    depth, at, colon = 0, 0, -1

    def child(end: int) -> None:
        piece = b[at:end]
        if not piece.strip(_BLANK):
            return
        stop = at + len(piece.rstrip(_BLANK))
        row = at + len(piece) - len(piece.lstrip(_BLANK))
        if colon < 0:
            out.append((None, row, row, stop))
        else:
            value = b[colon + 1 : stop]
            out.append((machine.unescape(b[row:colon].rstrip(_BLANK)), row, colon + 1 + len(value) - len(value.lstrip(_BLANK)), stop))

    for m in _MARK.finditer(b):
        c = b[m.start()]
        if c in b"[{":
            depth += 1
            if depth == 1:
                at = m.end()
        elif c in b"]}":
            if depth == 1:
                child(m.start())
                break
            depth -= 1
        elif depth == 1 and c == 0x2C:
            child(m.start())
            at, colon = m.end(), -1
        elif depth == 1 and c == 0x3A:
            colon = m.start()
    return out


def split_documents(whole: DataFrame) -> DataFrame:
    """The children of each document's root; a document without any (a scalar, or not well-formed) is one record."""

    def run(batches):
        for rb in batches:
            for source, base, b in zip(rb.column("source").to_pylist(), rb.column("start").to_pylist(), rb.column("raw"), strict=True):
                b = b.as_py()
                got = children(b)
                if got is None:
                    got = [(None, 0, 0, len(b))] if b.strip(_BLANK) else []
                line, seen = 1, 0
                for at in range(0, len(got), 20_000):
                    part, lines = got[at : at + 20_000], []
                    for _, row, _, _ in part:
                        line, seen = line + b.count(b"\n", seen, row), row
                        lines.append(line)
                    cols = [pa.array([source] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(lines, pa.int64())]
                    cols += [pa.array([base + x[k] for x in part], pa.int64()) for k in (2, 3, 1)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in part], pa.string()), pa.array([b[x[2] : x[3]] for x in part], pa.binary())], [f.split()[0] for f in CHILD.split(", ")])

    rows = whole.select("source", "start", "raw").mapInArrow(run, CHILD)
    text = F.col("raw").cast("string")
    return rows.withColumn("text", F.when(F.is_valid_utf8(text), text))


def from_document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return split_documents(documents(spark, path))


def from_text(spark: SparkSession, text: str, source: str = "") -> tuple[str, DataFrame]:
    """(format, whole records or lines) of a text that was pasted."""
    raw = text.encode("utf-8", "surrogatepass")
    kind = sniff(raw)
    columns = "source string, rec bigint, line bigint, start bigint, stop bigint, raw binary"
    skip = 3 if raw.startswith(_BOM) else 0
    if kind == "document":
        rows = [(source, 0, 1, skip, len(raw), raw[skip:])]
    else:
        rows, at = [], 0
        for n, line in enumerate(raw.split(b"\n"), 1):
            body, lead = line[skip:] if n == 1 else line, skip if n == 1 else 0
            cut = body.strip(_BLANK)
            if cut:
                begin = at + lead + len(body) - len(body.lstrip(_BLANK))
                rows.append((source, len(rows), n, begin, begin + len(cut), cut))
            at += len(line) + 1
    t = F.col("raw").cast("string")
    return kind, spark.createDataFrame(rows, columns).withColumn("text", F.when(F.is_valid_utf8(t), t))
