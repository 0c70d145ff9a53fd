"""Export, token for token: NDJSON, JSON, pretty JSON and CSV. Records that do not parse are kept as they are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import machine
from ..functions.tokens import is_json, minify
from .core import _ID, _arrow, raw_bytes


def _flagged(records: DataFrame, value: Column) -> DataFrame:
    """source, rec, out, salvaged from bytes that begin with 1 where a record was kept as it is."""
    rows = records.select("source", "rec", value.alias("v"))
    return rows.select("source", "rec", F.expr("CAST(substring(v, 2) AS STRING)").alias("out"), (F.substring("v", 1, 1) == F.lit(b"1")).alias("salvaged"))


def ndjson(records: DataFrame) -> DataFrame:
    """source, rec, out, salvaged: one minified value a record; one that does not parse byte for byte, without blanks around it."""
    t = F.col("text")
    ok = F.coalesce(is_json(t), F.lit(False))

    @F.arrow_udf("binary")
    def exact(raw: pa.Array) -> pa.Array:  # what the native check refuses may still be legal
        out = []
        for b in raw.to_pylist():
            try:
                out.append(None if b is None else b"0" + machine.minify(b, machine.read_document(b)).encode("utf-8", "surrogatepass"))
            except machine.JsonError:
                out.append(b"1" + b.strip(b" \t\r\n"))
        return pa.array(out, pa.binary())

    refused = exact(F.when(~ok, raw_bytes(records)))
    return _flagged(records, F.when(ok, F.concat(F.lit("0"), minify(t)).cast("binary")).otherwise(refused))


def pretty(records: DataFrame, indent: int = 2) -> DataFrame:
    """source, rec, out, salvaged: indented values."""

    @F.arrow_udf("binary")
    def exact(raw: pa.Array) -> pa.Array:
        out = []
        for b in raw.to_pylist():
            try:
                out.append(b"0" + machine.pretty(b, machine.read_document(b), indent).encode("utf-8", "surrogatepass"))
            except machine.JsonError:
                out.append(b"1" + b.strip(b" \t\r\n"))
        return pa.array(out, pa.binary())

    return _flagged(records, exact(raw_bytes(records)))


def _leaves(b: bytes):
    try:
        root = machine.read_document(b)
    except machine.JsonError:
        return
    todo = [("", root)]
    while todo:
        path, n = todo.pop()
        if n.kind == "object":
            todo += [(f"{path}.{k}" if path else k, c) for k, _, c in reversed(n.items)]
        elif n.kind == "array":
            yield path, machine.minify(b, n)
        else:
            yield path, machine.unescape(b[n.start : n.end]) if n.kind == "string" else b[n.start : n.end].decode()


def flatten(records: DataFrame) -> DataFrame:
    """source, rec, seq, path, cell: dotted leaf paths; arrays are one cell; the first of equal paths."""

    def rows(s, r, b, base, line):
        seen = set()
        for i, (p, c) in enumerate(_leaves(b)):
            if p not in seen:
                seen.add(p)
                yield s, r, i, p, c

    return _arrow(records, f"{_ID}, seq bigint, path string, cell string", rows)


def _first_seen(records: DataFrame) -> DataFrame:
    return flatten(records).groupBy("path").agg(F.min(F.struct("source", "rec", "seq")).alias("f"))


def csv_columns(records: DataFrame) -> DataFrame:
    """path and its place: columns by first appearance over all records."""
    return _first_seen(records).select("path", F.col("f.rec").alias("first_rec"), F.col("f.seq").alias("first_seq"))


def csv_cell(c: str | None) -> str:
    """RFC 4180; an empty string is quoted, an absent cell is not."""
    if c is None:
        return ""
    return '"' + c.replace('"', '""') + '"' if c == "" or any(x in c for x in ',"\r\n') else c


def csv(records: DataFrame, columns: list[str] | None = None) -> tuple[str, DataFrame]:
    """(header, rows source, rec, out). The header is one row a distinct column, which is what a CSV's width is bound by."""
    columns = columns if columns is not None else [r.path for r in _first_seen(records).orderBy("f").collect()]

    def rows(s, r, b, base, line):
        got: dict = {}
        for p, c in _leaves(b):
            got.setdefault(p, c)
        yield s, r, ",".join(csv_cell(got.get(k)) for k in columns)

    return ",".join(csv_cell(k) for k in columns), _arrow(records, f"{_ID}, out string", rows)


def write(records: DataFrame, path: str, kind: str = "ndjson", indent: int = 2, wrap: bool = True) -> None:
    """Write a folder of text files in record order: ndjson, json (an array over the files), json-pretty or csv.

    Without ``wrap`` the values of json and json-pretty stand by themselves, one a line.
    """
    if kind not in ("ndjson", "json", "json-pretty", "csv"):
        raise ValueError(f"no such format: {kind}")
    wrap = wrap and kind.startswith("json")
    head, out = csv(records) if kind == "csv" else (None, pretty(records, indent) if kind == "json-pretty" else ndjson(records))
    if wrap and kind == "json-pretty":
        out = out.withColumn("out", F.concat(F.lit(" " * indent), F.regexp_replace("out", "\n", "\n" + " " * indent)))
    end = out.agg(F.max(F.struct("source", "rec")).alias("m"), F.min(F.struct("source", "rec")).alias("f")).first()
    if end.m is None:
        lines = records.sparkSession.createDataFrame([(head + "\r" if head is not None else "[]" if wrap else "",)], "value string")
        lines.where("value <> ''").coalesce(1).write.text(path)
        return
    at = lambda r: F.col("source").eqNullSafe(F.lit(r.source)) & (F.col("rec") == r.rec)
    # numbers said twice are told apart at both ends, so that there is one first row and one last
    ends = at(end.f) | at(end.m)
    turn = F.row_number().over(W.partitionBy("source", "rec").orderBy("out"))
    last = F.count("*").over(W.partitionBy("source", "rec"))
    few = out.where(ends).select("source", "rec", "out", turn.alias("turn"), last.alias("of"))
    out = out.where(~ends).select("source", "rec", "out", F.lit(1).alias("turn"), F.lit(1).cast("long").alias("of")).unionAll(few)
    first, final = at(end.f) & (F.col("turn") == 1), at(end.m) & (F.col("turn") == F.col("of"))
    out = out.repartitionByRange("source", "rec", "turn").sortWithinPartitions("source", "rec", "turn")
    line = F.col("out")
    if kind == "csv":
        line = F.concat(F.when(first, F.lit(head + "\r\n")).otherwise(""), line, F.lit("\r"))
    elif wrap:
        feed = "\n" if kind == "json-pretty" else ""
        line = F.concat(F.when(first, F.lit("[" + feed)).otherwise(""), line, F.when(final, F.lit(feed + "]")).otherwise(","))
    out.select(line.alias("value")).write.text(path)
