"""The ten verbs over records: DataFrame in, DataFrame out.

Well-formed records stay in native expressions; an Arrow stage runs for those that the native
check refuses, and where a verb needs spans inside a record.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..functions import filterlang, machine
from ..functions.tokens import is_json, kind_of, minify, with_variant

LIST_CAP, FIND_CAP, PROBLEM_CAP = 10_000, 10_000, 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ID = "source string, rec bigint"


def _raw(rb) -> list[bytes]:
    """The records' bytes: ``raw`` where there is one (it may not be UTF-8), else the text's."""
    names = rb.schema.names
    text = [None if x is None else x.encode("utf-8", "surrogatepass") for x in rb.column("text").to_pylist()]
    return [r if r is not None else (t or b"") for r, t in zip(rb.column("raw").to_pylist(), text, strict=True)] if "raw" in names else [t or b"" for t in text]


def _arrow(records: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(source, rec, bytes, base offset, line)`` yields tuples of ``schema`` for one record."""
    cols = [c for c in ("source", "rec", "line", "start", "raw", "text") if c in records.columns]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            start = rb.column("start").to_pylist() if "start" in cols else [0] * n
            line = rb.column("line").to_pylist() if "line" in cols else [1] * n
            out = []
            for s, r, b, a, k in zip(rb.column("source").to_pylist(), rb.column("rec").to_pylist(), _raw(rb), start, line, strict=True):
                out += rows(s, r, b, a, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return records.select(*cols).mapInArrow(run, schema)


def raw_bytes(records: DataFrame) -> Column:
    """The records' bytes: ``raw`` where there is one (it may not be UTF-8), else the text's."""
    text = F.col("text").cast("binary")
    return F.coalesce(F.col("raw"), text) if "raw" in records.columns else text


# ---------------------------------------------------------------- filter
def filter_records(records: DataFrame, expression: str) -> DataFrame:
    """Records that are well-formed and satisfy the expression; one scan, and only what the native check refuses has bytes for the exact one."""
    e = filterlang.parse(expression)
    text = F.col("text")
    none = F.struct(F.lit(False).alias("ok"), F.lit(False).alias("hit"))
    @F.arrow_udf("boolean")
    def exact(raw: pa.Array) -> pa.Array:
        out = []
        for b in raw.to_pylist():
            try:
                out.append(b is not None and filterlang.matches(e, b, machine.read_document(b)))
            except machine.JsonError:
                out.append(False)
        return pa.array(out, pa.bool_())

    native = F.when(text.isNotNull(), filterlang.checked(e, text)) if filterlang.simple(e) else none
    checked = records.withColumn("_b", F.coalesce(native, none))
    exact = exact.asNondeterministic()  # it stays in a projection of its own, below the filter
    checked = checked.withColumn("_x", exact(F.when(~F.col("_b.ok"), raw_bytes(records))))
    return checked.where(F.when(F.col("_b.ok"), F.col("_b.hit")).otherwise(F.col("_x"))).select(records.columns)


def filter_pass(records: DataFrame, expression: str, cap: int = LIST_CAP) -> tuple[DataFrame, DataFrame]:
    """(listing of at most ``cap`` records in order, exact count)."""
    hit = filter_records(records, expression)
    return hit.orderBy("source", "rec").limit(cap), hit.agg(F.count("*").alias("total"))


# ---------------------------------------------------------------- find
def _fold(c: Column, sensitive: bool) -> Column:
    return c if sensitive else F.translate(c, _UPPER, _LOWER)


def _folded(b: bytes, sensitive: bool) -> bytes:
    return b if sensitive else b.translate(_FOLD)


_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def find_counts(records: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Records that hold the needle, with matches (leftmost, not overlapping); bytes that are no UTF-8 are searched as they are."""
    if not needle:
        return records.withColumn("matches", F.lit(0).cast("long")).where("false")
    n = F.lit(needle) if case_sensitive else F.translate(F.lit(needle), _UPPER, _LOWER)
    t = _fold(F.col("text"), case_sensitive)
    count = ((F.octet_length(t) - F.octet_length(F.replace(t, n, F.lit("")))) / len(needle.encode())).cast("long")
    if "raw" in records.columns:
        sought = _folded(needle.encode(), case_sensitive)

        @F.arrow_udf("bigint")
        def exact(raw: pa.Array) -> pa.Array:
            return pa.array([0 if b is None else _folded(b, case_sensitive).count(sought) for b in raw.to_pylist()], pa.int64())

        exact = exact.asNondeterministic()  # as in filter_records
        count = F.when(F.col("text").isNull(), exact(F.when(F.col("text").isNull(), F.col("raw")))).otherwise(count)
    return records.withColumn("matches", count).where("matches > 0")


def find_summary(records: DataFrame, needle: str, case_sensitive: bool = False, cap: int = FIND_CAP) -> DataFrame:
    """matches (all of them), records that hold one, and whether a listing of ``cap`` would leave some out."""
    n = F.coalesce(F.sum("matches"), F.lit(0)).cast("long")
    return find_counts(records, needle, case_sensitive).agg(n.alias("matches"), F.count("*").alias("records"), (n > cap).alias("limited"))


def find_offsets(records: DataFrame, needle: str, case_sensitive: bool = False, cap: int | None = None, start: int = 0) -> DataFrame:
    """source, rec, offset (bytes from the record's start, plus ``start`` where there is one) of each match that begins at ``start`` or later."""
    hit = find_counts(records, needle, case_sensitive)
    sought = _folded(needle.encode(), case_sensitive)

    @F.arrow_udf("array<bigint>")
    def places(raw: pa.Array) -> pa.Array:
        out = []
        for b in raw.to_pylist():
            b, at, got = _folded(b, case_sensitive), -len(sought), []
            while (at := b.find(sought, at + len(sought) if at >= 0 else 0)) >= 0:
                got.append(at)
            out.append(got)
        return pa.array(out, pa.list_(pa.int64()))

    base = F.col("start") if "start" in records.columns else F.lit(0)
    out = hit.select("source", "rec", F.explode(places(raw_bytes(records))).alias("o"), base.alias("base")).select("source", "rec", (F.col("base") + F.col("o")).cast("long").alias("offset"))
    out = out.where(F.col("offset") >= start) if start else out
    return out if cap is None else out.orderBy("source", "offset").limit(cap)


def find_next(records: DataFrame, needle: str, offset: int, case_sensitive: bool = False, back: bool = False) -> DataFrame:
    """source, rec, offset, wrapped: the first match after ``offset`` (the last before it, with ``back``), going round at the end. One partial aggregate, no sort."""
    found = find_offsets(records, needle, case_sensitive).select(F.struct("offset", "source", "rec").alias("m"))
    pick, beyond = (F.max, F.col("m.offset") < offset) if back else (F.min, F.col("m.offset") > offset)
    got = found.agg(pick(F.when(beyond, F.col("m"))).alias("near"), pick("m").alias("any")).where("any is not null")
    m = F.coalesce("near", "any")
    return got.select(m["source"].alias("source"), m["rec"].alias("rec"), m["offset"].alias("offset"), F.col("near").isNull().alias("wrapped"))


def position(view: DataFrame, rec: int) -> DataFrame:
    """position (from 0), shown: where a record stands among those of a filtered view, or would."""
    return view.agg(F.count_if(F.col("rec") < rec).alias("position"), F.coalesce(F.bool_or(F.col("rec") == rec), F.lit(False)).alias("shown"))


def locate(records: DataFrame, offsets: DataFrame, bucket_bytes: int = 64 << 20) -> DataFrame:
    """As-of join: for each (source, offset) the record with the greatest start not after it; earlier offsets drop out.

    One sort by (source, bucket of offsets, offset) for both sides, no range join; a bucket goes on from the last record of the buckets before it.
    """
    at = F.col("row_start" if "row_start" in records.columns else "start")
    both = records.select("source", at.alias("at"), F.lit(0).alias("side"), "rec").unionAll(offsets.select("source", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("rec")))
    both = both.withColumn("bucket", F.floor(F.col("at") / bucket_bytes))
    tops = both.groupBy("source", "bucket").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "rec"))).alias("top"))
    before = F.last("top", ignorenulls=True).over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = tops.select("source", "bucket", before["rec"].alias("carried"))
    w = W.partitionBy("source", "bucket").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("here", F.last("rec", ignorenulls=True).over(w)).where("side = 1").join(carried, ["source", "bucket"])
    return out.select("source", F.col("at").alias("offset"), F.coalesce("here", "carried").alias("rec")).where("rec is not null")


# ---------------------------------------------------------------- validate
def validate(records: DataFrame) -> DataFrame:
    """source, rec, offset, line, column, message of each record that is not well-formed."""
    bad = records.where(F.col("text").isNull() | ~is_json(F.col("text")))

    def rows(s, r, b, base, line):
        try:
            machine.read_document(b)
        except machine.JsonError as e:
            head = b[: e.offset]
            k = head.count(b"\n")
            yield s, r, base + e.offset, line + k, e.offset - (head.rfind(b"\n") + 1) + 1, str(e)

    return _arrow(bad, f"{_ID}, offset bigint, line bigint, column bigint, message string", rows)


def validate_summary(records: DataFrame) -> DataFrame:
    """checked (bytes), records, invalid, values (records in which a value begins), is_valid."""

    @F.arrow_udf("int")
    def state(raw: pa.Array) -> pa.Array:  # 0 well-formed, 1 not, 2 not but a value begins
        out = []
        for b in raw.to_pylist():
            try:
                if b is not None:
                    machine.read_document(b)
                out.append(0)
            except machine.JsonError:
                out.append(2 if machine.begins_value(b) else 1)
        return pa.array(out, pa.int32())

    size = F.octet_length("raw") if "raw" in records.columns else F.octet_length("text")
    bad = F.col("text").isNull() | ~is_json(F.col("text"))
    rows = records.select(size.alias("size"), state(F.when(bad, raw_bytes(records))).alias("state"))
    out = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("checked"), F.count("*").alias("records"), F.count_if(F.col("state") > 0).alias("invalid"), F.count_if(F.col("state") != 1).alias("values"))
    return out.withColumn("is_valid", F.col("invalid") == 0)


def capped(problems: DataFrame, cap: int = PROBLEM_CAP) -> tuple[DataFrame, DataFrame]:
    """(the first ``cap`` of some problems or duplicates in order, their exact number)."""
    order = [c for c in ("source", "rec", "offset", "first_rec", "second_rec", "first", "second") if c in problems.columns]
    return problems.orderBy(*order).limit(cap), problems.agg(F.count("*").alias("total"))


# ---------------------------------------------------------------- dedup
def duplicate_records(records: DataFrame) -> DataFrame:
    """source, first_rec, second_rec for each repeat of a record (white space apart), paired with the first."""
    value = minify(F.trim(F.col("text")))
    if "raw" in records.columns:  # bytes that are no UTF-8 are equal as they are
        value = F.coalesce(value, F.col("raw").cast("string"))
    rows = records.select("source", "rec", value.alias("value"))
    first = rows.groupBy("source", "value").agg(F.min("rec").alias("first_rec"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["source", "value"]).where("rec > first_rec").select("source", "first_rec", F.col("rec").alias("second_rec"), F.substring("value", 1, 48).alias("what"))


def duplicate_keys(records: DataFrame, elements: bool = False) -> DataFrame:
    """source, rec, kind, first, second, what: repeated keys of an object, and with ``elements`` repeated array members, at any depth."""

    def rows(s, r, b, base, line):
        try:
            root = machine.read_document(b)
        except machine.JsonError:
            return
        todo = [root]
        while todo:
            n = todo.pop()
            seen: dict = {}
            for it in n.items:
                child = it[2] if n.kind == "object" else it
                if child.items:
                    todo.append(child)
                if n.kind == "object":
                    key, at = it[0], it[1]
                elif elements:
                    key, at = machine.minify(b, it), it.start
                else:
                    continue
                if key in seen:
                    yield s, r, "key" if n.kind == "object" else "element", base + seen[key], base + at, key[:48] + ("…" if len(key) > 48 else "")
                else:
                    seen[key] = at

    # the native check refuses every record with a repeated key, at any depth: only what it refuses is walked, and for elements what holds an array
    some = F.col("text").isNull() | ~is_json(F.col("text"))
    if elements:
        some = some | F.col("text").contains("[")
    return _arrow(records.where(some), f"{_ID}, kind string, first bigint, second bigint, what string", rows)


def dedup_counters(records: DataFrame, elements: bool = False) -> DataFrame:
    """keys_checked, elements_checked, total."""

    def rows(s, r, b, base, line):
        try:
            todo = [machine.read_document(b)]
        except machine.JsonError:
            return
        keys = elems = 0
        while todo:
            n = todo.pop()
            keys, elems = keys + len(n.items) * (n.kind == "object"), elems + len(n.items) * (n.kind == "array")
            todo += [(it[2] if n.kind == "object" else it) for it in n.items]
        yield s, r, keys, elems

    text = F.col("text")
    ok = F.coalesce(is_json(text), F.lit(False))
    t = F.regexp_replace(minify(text), F.lit('(?s)"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"'), F.lit("s"))  # strings are one letter
    of = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / len(c)
    full = lambda a, z: of(a) - of(a + z)  # noqa: E731  containers that hold something
    native = records.where(ok).select(of(":").cast("long").alias("k"), (of(",") - of(":") + full("{", "}") + full("[", "]")).cast("long").alias("e"))
    counted = native.unionAll(_arrow(records.where(~ok), f"{_ID}, k bigint, e bigint", rows).select("k", "e")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("keys_checked"), F.coalesce(F.sum("e"), F.lit(0)).alias("elements_checked"))
    total = duplicate_keys(records, elements).agg(F.count("*").alias("total"))
    return counted.withColumn("j", F.lit(1)).join(total.withColumn("j", F.lit(1)), "j").drop("j")


# ---------------------------------------------------------------- rows and navigation
@F.arrow_udf(StringType())
def _fields(raw: pa.Array) -> pa.Array:
    out = []
    for b in raw.to_pylist():
        try:
            text, more = machine.preview(b, machine.read_document(b)) if b is not None else ("", False)
            out.append(("1" if more else "0") + text)
        except machine.JsonError:
            out.append("1")
    return pa.array(out, pa.string())


def rows(records: DataFrame, start: int = 0, count: int = 50, preview: int = 120) -> DataFrame:
    """rec, kind, children, preview (the text's start), fields (``id: 0, tags: […]``), more of a slice; what does not parse is a row of kind invalid."""
    part = records.where((F.col("rec") >= start) & (F.col("rec") < start + count))
    t = F.col("text")
    s = with_variant(t, lambda v: F.struct(kind_of(F.try_variant_get(v, "$[0]", "variant")).alias("kind")))
    ok = F.coalesce(is_json(t), F.lit(False))
    small = minify(F.trim(t))
    kids = F.when(F.col("kind") == "object", F.size(F.json_object_keys(t))).when(F.col("kind") == "array", F.json_array_length(t))
    return part.withColumn("kind", F.when(ok, s["kind"]).otherwise("invalid")).withColumn("children", kids.cast("long")).select("source", "rec", "kind", "children", F.substring(small, 1, preview).alias("preview"), (F.length(small) > preview).alias("truncated"), _fields(raw_bytes(records)).alias("_f")).select(
        "source", "rec", "kind", "children", "preview", "truncated", F.substring("_f", 2, 1 << 20).alias("fields"), (F.substring("_f", 1, 1) == "1").alias("more")
    )


def expand(records: DataFrame, path: str = "$") -> DataFrame:
    """rec, pos, key, kind, value of the children of the container at ``path`` in each record, in document order."""
    steps = parse_path(path)

    def run(s, r, b, base, line):
        try:
            node = filterlang._find(b, machine.read_document(b), tuple(steps))
        except machine.JsonError:
            return
        for i, it in enumerate(node.items if node is not None else []):
            key, child = (it[0], it[2]) if node.kind == "object" else (None, it)
            yield s, r, i, key, {"true": "boolean", "false": "boolean"}.get(child.kind, child.kind), base + (it[1] if key is not None else child.start), machine.minify(b, child)

    return _arrow(records, f"{_ID}, pos bigint, key string, kind string, start bigint, value string", run)


def goto(records: DataFrame, path: str) -> DataFrame:
    """source, rec, value at a path (JSON text, tokens as written); records without it are left out."""
    steps = tuple(parse_path(path))

    def run(s, r, b, base, line):
        try:
            node = filterlang._find(b, machine.read_document(b), steps)
        except machine.JsonError:
            return
        if node is not None:
            yield s, r, base + node.start, machine.minify(b, node)

    return _arrow(records, f"{_ID}, start bigint, value string", run)


def goto_offset(records: DataFrame, offset: int) -> DataFrame:
    """The record that holds a byte offset: the one with the greatest start not after it; none before the first. One partial maximum, no sort."""
    best = records.where(F.col("start") <= offset).agg(F.max(F.struct("start", F.struct(*records.columns))).alias("m")).where("m is not null")
    return best.select("m.col2.*")


def text_range(records: DataFrame, start: int, end: int, limit: int = 1 << 20) -> DataFrame:
    """source, rec, text, truncated: the bytes [start, end) of each record, decoded, at most ``limit`` bytes; a cut character reads as U+FFFD."""
    raw = F.col("raw") if "raw" in records.columns else F.col("text").cast("binary")
    size = max(0, min(end - start, limit))
    piece = F.substring(raw, start + 1, size)
    cut = F.least(F.coalesce(F.octet_length(raw), F.lit(0)), F.lit(end)) - start > size
    return records.select("source", "rec", F.make_valid_utf8(piece.cast("string")).alias("text"), cut.alias("truncated"))


def parse_path(text: str) -> list:
    """``$.a[0]["odd key"]``, ``a.b``: names and indices."""
    text = text.strip()
    if not text.startswith(("$", "@")):
        text = "$" + ("" if text.startswith(("[", ".")) else ".") + text if text else "$"
    p = filterlang._Parser(text)
    steps = p.path()
    if p.i < len(text):
        raise filterlang.FilterError("a damaged path", p.i)
    return list(steps)


def path_text(steps: list) -> str:
    import json
    import re

    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" if re.fullmatch(r"[A-Za-z_]\w*", s) else f"[{json.dumps(s)}]" for s in steps)
