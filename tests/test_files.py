"""Files and documents, raw bytes, caps and navigation, native passes against the exact ones, the command-line units."""

import json
import random
import threading

import pytest

from quillon import tools
from quillon.functions import machine, sniff
from quillon.operators import core, export, schema
from quillon.plans.dataset import JsonDataset
from quillon.sources import records as source
from quillon.streaming import passes


def written(path):
    return "".join(p.read_text() + "" for p in sorted(path.glob("part-*")))


def test_children_of_a_document():
    for text in ('[1, "a,]", [2, {"x": 3}], {} ]', ' {"a" : 1 , "b\\u0063":[1,2], "c":{"d":","}} ', "[]", "{}", '[\n {"a":1},\n {"a":2}\n]', "[" * 3000 + "]" * 3000, '{"a":1,"a":2}'):
        b = text.encode()
        root = machine.read_document(b)
        want = [(it[0], it[1], it[2].start, it[2].end) if root.kind == "object" else (None, it.start, it.start, it.end) for it in root.items]
        assert source.children(b) == want, text[:60]
    assert all(source.children(b) is None for b in (b"1", b'"x"', b"[1,", b"[NaN]", b'{"a":1}}', b""))


def test_documents_as_records(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf[\n  {"a": 1, "t": "x"},\n  {"a": 2.50},\n  7\n]\n')
    (tmp_path / "o.json").write_text('{"one": {"a": 1}, "two": {"a": 3}, "three": [1, 2]}')
    ds = JsonDataset.open(spark, str(tmp_path / "a.json"))
    assert ds.kind == "document" and [(r.rec, r.line, r.text) for r in ds.records.orderBy("rec").collect()] == [(0, 2, '{"a": 1, "t": "x"}'), (1, 3, '{"a": 2.50}'), (2, 4, "7")]
    body = (tmp_path / "a.json").read_bytes()
    assert all(body[r.start : r.stop] == bytes(r.raw) for r in ds.records.collect())
    assert [r.rec for r in ds.filter("@.a == 2.5").records.collect()] == [1]
    assert [r.rec for r in ds.goto_offset(body.index(b"2.50")).collect()] == [1]
    for kind, want in (("json", '[{"a":1,"t":"x"},{"a":2.50},7]\n'), ("ndjson", '{"a":1,"t":"x"}\n{"a":2.50}\n7\n'), ("csv", 'a,t,""\r\n1,x,\r\n2.50,,\r\n,,7\r\n')):
        ds.export(str(tmp_path / f"out-{kind}"), kind)
        got = "".join(p.read_bytes().decode() for p in sorted((tmp_path / f"out-{kind}").glob("part-*")))
        assert got == want, kind
    one = JsonDataset.open(spark, str(tmp_path / "o.json"))
    assert [(r.rec, r.key) for r in one.filter("@.a >= 1").records.orderBy("rec").collect()] == [(0, "one"), (1, "two")]
    at = spark.createDataFrame([(one.records.first().source, 3), (one.records.first().source, 20)], "source string, offset bigint")
    assert [(r.offset, r.rec) for r in one.locate(at).orderBy("offset").collect()] == [(3, 0), (20, 1)]  # a key belongs to its member
    one.export(str(tmp_path / "whole"), "json")
    assert written(tmp_path / "whole") == '{"one":{"a":1},"two":{"a":3},"three":[1,2]}\n'
    one.export(str(tmp_path / "pretty"), "json-pretty", indent=4)
    assert written(tmp_path / "pretty") == json.dumps(json.loads((tmp_path / "o.json").read_text()), indent=4) + "\n"
    one.filter("@.a >= 1").export(str(tmp_path / "few"), "json")
    assert json.loads(written(tmp_path / "few")) == [{"a": 1}, {"a": 3}]
    (tmp_path / "bad.json").write_text('{\n "a": [1,\n 2}\n')
    bad = JsonDataset.open(spark, str(tmp_path / "bad.json")).validate().collect()
    assert [(r.line, r.column, r.offset) for r in bad] == [(3, 3, 14)] and bad[0].message == "`}` closes an object, but an array is open"


def test_folders_patterns_lists_and_empty_inputs(spark, tmp_path):
    for name, text in (("b.ndjson", '{"b":1,"c":2}\n'), ("a.jsonl", '{"a":1}\n\t\r\n{"b":2}\n'), ("c.txt", "no\n"), ("empty.json", "")):
        (tmp_path / name).write_text(text)
    ds = JsonDataset.open(spark, str(tmp_path))
    assert ds.count() == 3 and ds.kind == "ndjson"
    assert export.csv(ds.records)[0] == "a,b,c"  # by file, record and place
    assert JsonDataset.open(spark, f"{tmp_path}/*.txt").count() == 1 and JsonDataset.open(spark, [str(tmp_path / "b.ndjson"), f"{tmp_path}/a.*"]).count() == 3
    none = JsonDataset.open(spark, str(tmp_path / "empty.json"))
    assert none.kind == "empty" and none.count() == 0 and [(r.offset, r.line, r.column, r.message) for r in none.validate().collect()] == [(0, 1, 1, "no JSON value: the document is empty")]
    with pytest.raises(FileNotFoundError):
        JsonDataset.open(spark, str(tmp_path / "none.json"))


def test_a_slice_reads_only_its_ranges(spark, tmp_path):
    lines = [f'{{"n":{i}}}' + " " * (i % 5) for i in range(2000)]
    (tmp_path / "x.ndjson").write_text("\n\n".join(lines))
    at = source.index(spark, str(tmp_path / "x.ndjson"), 1000)
    assert len(at.parts) > 10 and at.records == 2000
    part = source.from_ndjson(spark, at, start=700, count=40)
    assert sorted((r.rec, r.line, r.text) for r in part.collect()) == [(i, 2 * i + 1, f'{{"n":{i}}}') for i in range(700, 740)]
    assert source.from_ndjson(spark, at, start=5000, count=10).count() == 0
    ds = JsonDataset(source.from_ndjson(spark, at), "ndjson", index=at)
    assert [r.fields for r in ds.rows(1999, 5).collect()] == ["n: 1999"] and ds.goto_row(3).first().text == '{"n":3}'


def test_pasted_texts(spark):
    ds = JsonDataset.from_text(spark, '﻿{"a":1}\n\n{"a":2} \r\n')
    assert [(r.rec, r.line, r.start, r.text) for r in ds.records.orderBy("rec").collect()] == [(0, 1, 3, '{"a":1}'), (1, 3, 12, '{"a":2}')]
    assert JsonDataset.from_text(spark, '[{"a":1},\n {"a":2}]').filter("@.a == 2").count() == 1


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.ndjson").write_bytes(b'{"a":"one"}\n{"a":"\xffone ONE"} \n{"a":"\xffone ONE"}\nnope\n')
    ds = JsonDataset.open(spark, str(tmp_path / "x.ndjson"))
    assert sorted((r.rec, r.matches) for r in core.find_counts(ds.records, "one").collect()) == [(0, 1), (1, 2), (2, 2)]
    body = (tmp_path / "x.ndjson").read_bytes()
    assert sorted(r.offset for r in ds.find_offsets("One").collect()) == [i for i in range(len(body)) if body[i : i + 3].lower() == b"one"]
    assert sorted(r.offset for r in ds.find_offsets("one", True, start=10).collect()) == [i for i in range(10, len(body)) if body[i : i + 3] == b"one"]
    assert [tuple(r)[1:3] for r in ds.duplicate_records().collect()] == [(1, 2)]
    ds.export(str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == b'{"a":"one"}\n{"a":"\xffone ONE"}\n{"a":"\xffone ONE"}\nnope\n'
    assert tuple(ds.summary().first()) == (len(b'{"a":"one"}') + 2 * len(b'{"a":"\xffone ONE"}') + 4, 4, 3, 3, False)


def test_going_through_matches_and_caps(spark):
    r = spark.createDataFrame([("f", i, 10 * i, '{"k":"x"}' if i % 3 else '{"k":1}') for i in range(9)], "source string, rec long, start long, text string")
    places = [10 * i + 6 for i in range(9) if i % 3]
    step = lambda at, **k: core.find_next(r, "x", at, **k).first()
    assert [step(places[i]).offset for i in range(6)] == [*places[1:], places[0]] and step(places[-1]).wrapped and not step(0).wrapped
    assert [step(places[i], back=True).offset for i in range(6)] == [places[-1], *places[:-1]]
    assert core.find_next(r, "absent", 0).count() == 0
    view = core.filter_records(r, "@.k == 'x'")
    assert tuple(core.position(view, 4).first()) == (2, True) and tuple(core.position(view, 3).first()) == (2, False)
    some, n = core.capped(core.validate(r.withColumn("text", r.text.substr(1, 4))), 5)
    assert [x.rec for x in some.collect()] == [0, 1, 2, 3, 4] and n.first().total == 9


def test_locate_goes_on_over_buckets(spark):
    starts = [5, 70, 75, 400, 401]
    r = spark.createDataFrame([("f", i, s) for i, s in enumerate(starts)], "source string, rec long, start long")
    o = spark.createDataFrame([("f", x) for x in range(0, 600, 3)] + [("g", 1)], "source string, offset long")
    want = {x: sum(s <= x for s in starts) - 1 for x in range(0, 600, 3) if x >= 5}
    for size in (7, 64, 1 << 20):
        assert {x.offset: x.rec for x in core.locate(r, o, size).collect()} == want


RECORDS = ['{"id": 1, "t": ["a", "a"], "o": {"x": 1, "x": 2}}', "[]", "{}", "[1, [1, 1], 1]", '{"a": "q\\"u:o,t{e["}', "3", '"s"', "nope", '{"a": {"b": [{"c": 1}, {"c": 1}]}}', '{"id": 1.5, "t": "long text"}', '{"id": -1e400, "t": []}', '{"id": null, "z": true}', '{"id":"\\ud800"}', '{"t":["abc",1,null]}']
SCHEMAS = [
    {"type": "object", "required": ["id"], "properties": {"id": {"type": ["integer", "null"], "minimum": 0}}},
    {"properties": {"t": {"type": "array", "items": {"type": "string", "minLength": 2}, "maxItems": 2}}, "additionalProperties": {"type": ["number", "null", "string"]}},
    {"$defs": {"n": {"enum": [1, "s", None, True]}}, "properties": {"id": {"$ref": "#/$defs/n"}, "z": {"const": True}}, "additionalProperties": False},
    {"minProperties": 1, "maxProperties": 2, "minItems": 1, "maxLength": 0, "exclusiveMaximum": 3},
    {"$defs": {"tree": {"properties": {"a": {"$ref": "#/$defs/tree"}, "c": False}}}, "$ref": "#/$defs/tree"},
    {"properties": {"it's": {"type": "string"}}, "required": ["it's"]},
    True,
    False,
]


def test_native_passes_agree_with_the_exact_ones(spark):
    r = source.from_texts(spark, RECORDS)
    for s in SCHEMAS:
        c = schema.Schema(s)
        want = sorted((i, at, m) for i, t in enumerate(RECORDS) for at, m in c.check(t.encode()))
        assert sorted(tuple(x)[1:] for x in schema.check_schema(r, c).collect()) == want, s
    keys = elements = 0
    for t in RECORDS:
        try:
            todo = [machine.read_document(t.encode())]
        except machine.JsonError:
            continue
        while todo:
            n = todo.pop()
            keys, elements = keys + len(n.items) * (n.kind == "object"), elements + len(n.items) * (n.kind == "array")
            todo += [it[2] if n.kind == "object" else it for it in n.items]
    got = core.dedup_counters(r, True).first()
    assert (got.keys_checked, got.elements_checked, got.total) == (keys, elements, 5)


@pytest.mark.parametrize("bad", [{"properties": [1]}, {"minimum": "x"}, {"required": "id"}, {"required": [1]}, {"maxItems": -1}, {"minLength": 1.5}, {"$ref": 1}, {"$defs": 3}, {"maximum": True}])
def test_schemas_of_wrong_types_are_refused(bad):
    with pytest.raises(schema.SchemaError):
        schema.Schema(bad)


def test_field_previews(spark):
    long = "é" * 30
    cases = {
        '{"id": 0, "level": "info", "o": {"x": 1}, "a": [1]}': ('id: 0, level: "info", o: {…}, a: […]', False),
        json.dumps([long, None, 1.5]): ('"' + json.loads(f'"{long}"')[:24] + '…", null, 1.5', False),
        json.dumps({f"k{i}": i for i in range(60)}): (", ".join(f"k{i}: {i}" for i in range(16)), True),
        '"' + "t" * 130 + '"': ("t" * 120, True),
        "{}": ("", False),
        "{bad": ("", True),
    }
    got = {x.rec: (x.fields, x.more) for x in core.rows(source.from_texts(spark, list(cases)), 0, 100).collect()}
    assert got == dict(enumerate(cases.values()))
    assert sniff.summary_of("object", "id: 0", False) == "{ id: 0 }" and sniff.summary_of("array", "", False) == "[]" and sniff.summary_of("object", "a: 1", True) == "{ a: 1, … }"


def test_what_is_said(spark):
    assert [sniff.find_status(*a) for a in ((0, 0, None, False, True), (1, 1, 0, False, True), (12000, 900, 4, True, True), (3, 3, None, True, False))] == ["no matches", "1 of 1 match", "5 of 12,000+ matches in 900 rows", "3 matches"]
    assert [sniff.human_duration(s) for s in (2e-7, 5e-5, 0.02, 3.5, 125)] == ["200 ns", "50 µs", "20 ms", "3.50 s", "2 min 5 s"]
    assert sniff.rate(1 << 20, 0.5) == "2.0 MiB/s" and sniff.share_of(1, 8) == "12.5 %" and sniff.share_of(1, 0) == "–"


def test_progress_and_cancelling(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"n":1}\n\t\n \r\n{"n":2}\n')
    q = passes.write(passes.validate_stream(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 0  # lines of blanks are no records
    p = passes.progress(q)
    assert p["batches"] >= 1 and p["rows"] >= 2 and not p["running"]
    ended = []

    def slow():
        with passes.tagged(spark, "old-search"):
            try:
                spark.range(4, numPartitions=4).selectExpr("id").foreachPartition(lambda _: __import__("time").sleep(60))
            except Exception as e:
                ended.append(e)

    t = threading.Thread(target=slow)
    t.start()
    for _ in range(100):
        if passes.tasks(spark)[1]:
            break
        t.join(0.1)
    passes.cancel(spark, "old-search")
    t.join(30)
    assert ended and not t.is_alive()


def test_expansions_are_kept_and_let_go(spark):
    ds = JsonDataset(source.from_texts(spark, ['{"a":[1,2]}']))
    assert ds.expand("$.a") is ds.expand("$.a") and ds.expand("$.a").count() == 2 and ds.memory()["memory"] >= 0
    for i in range(20):
        ds.expand(f"$.a[{i}]")
    assert len(ds._expanded) == 16
    ds.close()


def test_units(spark, tmp_path):
    for kind in tools.KINDS:
        body = b"".join(tools.fixture(kind, 3000))
        assert body == b"".join(tools.fixture(kind, 3000)) and len(body) >= 3000
        good = kind not in ("ndjson", "truncated", "dupkeys", "badutf8")
        for b in [body] if good else [x for x in body.split(b"\n") if x]:
            assert tools.accepts(b) == (kind not in ("badutf8", "truncated") or kind == "truncated" and b.endswith(b"}}"))
            if tools.accepts(b):
                assert tools.roundtrip(b)
    for name, text in (("y_a", "[1]"), ("n_a", "[1,]"), ("i_a", '["\\ud800"]'), ("n_wrong", "[]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = tools.conformance(str(tmp_path))
    assert got == {"right": ["n_a.json", "y_a.json"], "wrong": ["n_wrong.json"], "accepted": ["i_a.json"], "refused": []}
    cases = [{"name": "eq", "selector": "$[?@.a=='b']", "document": [{"a": "b"}, {"a": 1}], "result": [{"a": "b"}]}, {"name": "wild", "selector": "$.*", "document": [], "result": []}, {"name": "bad", "selector": "$[?@.a==]", "invalid_selector": True}]
    (tmp_path / "cts.json").write_text(json.dumps({"tests": cases}))
    assert tools.cts(str(tmp_path / "cts.json")) == {"right": ["eq", "bad"], "wrong": [], "out_of_scope": ["wild"]}
    n, wrong = tools.fuzz(1.0)
    assert n > 100 and not wrong
    assert tools.main(["fixture", "ndjson", str(tmp_path / "f"), "2k"]) == 0 and tools.main(["sniff", str(tmp_path / "f")]) == 0 and tools.main([]) == 2


def test_repeated_record_numbers_have_one_pair_of_brackets(spark, tmp_path):
    r = spark.createDataFrame([("", 0, "1"), ("", 0, "1"), ("", 1, "2"), ("", 1, "2"), ("", 1, "3")], "source string, rec long, text string")
    for kind in ("json", "json-pretty"):
        export.write(r, str(tmp_path / kind), kind)
        assert json.loads(written(tmp_path / kind)) == [1, 1, 2, 2, 3]
    export.write(r.limit(0), str(tmp_path / "none"), "json")
    assert written(tmp_path / "none") == "[]\n"


def test_messages_do_not_depend_on_where_a_record_stands(spark):
    r = random.Random(3)
    texts = [tools.record(r, i) for i in range(20)]
    cut = [t[: r.randrange(1, len(t))] for t in texts]
    got = {x.rec: x.message for x in core.validate(source.from_texts(spark, cut)).collect()}
    for i, t in enumerate(cut):
        with pytest.raises(machine.JsonError) as e:
            machine.read_document(t.encode())
        assert got[i] == str(e.value)
