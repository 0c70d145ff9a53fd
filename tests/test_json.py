"""The JSON verbs: language, validator, schema, dedup, export, sources, streaming."""

import json
import random

import pytest

from quillon.functions import filterlang, machine, sniff
from quillon.operators import core, export, schema
from quillon.plans.dataset import JsonDataset
from quillon.sources.records import from_ndjson, from_texts
from quillon.streaming import passes

RECORD = '{"valid":true,"speed":2.25,"near":["north","east"],"code":31,"unit":{"name":"mV","digits":0},"n":12,"two words":5,"gap":null}'
CASES = [
    ("@.code == 31", True), ("@.code == '31'", False), ("@.code != '31'", True), ("@.none != 1", True), ("@.none == null", False), ("@.gap == null", True), ("@.gap", True), ("!@.none", True),
    ("@.valid == true && @.speed > 2", True), ("@.valid == false || @.unit.digits <= 0", True), ("2 < @.speed", True), ("@.near[1] == 'east'", True), ("@.near[2]", False), ("@.unit != 1", True),
    ("@.unit == 1", False), ("@['two words'] == 5", True), ("$[?@.n >= 12]", True), ("!(@.n == 12 && @.valid == true)", False), ("@.gap <= null", True), ("@.valid > false", True), ("@.near[0] < 'o' and @.n == 12", True),
]


def test_filter_language_native_and_exact_agree(spark):
    records = from_texts(spark, [RECORD])
    node = machine.read_document(RECORD.encode())
    for expression, want in CASES:
        assert filterlang.matches(filterlang.parse(expression), RECORD.encode(), node) is want, expression
    from pyspark.sql import functions as F

    hits = records.select(*[filterlang.predicate(filterlang.parse(e), F.col("text"))[1].alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).first()
    assert list(hits) == [w for _, w in CASES]


@pytest.mark.parametrize("bad", ["@..a", "@.*", "@[*]", "@[-1]", "@[0:1]", "length(@.a) == 1", "@.a == @.b", "@.a == 01", "@.a == 1.", "!=@.a", "@[01]", "@.a ==", "@.a == 'x", "(@.a", "@.a b", ""])
def test_filter_refuses(bad):
    with pytest.raises(filterlang.FilterError):
        filterlang.parse(bad)


def test_duplicate_keys_first_wins_and_malformed_never_match(spark):
    r = from_texts(spark, ['{"a":1,"a":2}', '{"a":1', "nope", '{"a":1} x', '﻿{"a":1}'])
    assert sorted(x.rec for x in core.filter_records(r, "@.a == 1").collect()) == [0, 4]
    assert sorted(x.rec for x in core.filter_records(r, "@.a != 5").collect()) == [0, 4]


GOOD = ["0", "-0", "1e400", '"\\ud800"', "[]", "{}", ' {"a":[1,{"b":null}]} ', '"é"', "[" * 3000 + "]" * 3000, "true"]
BAD = [("01", 1), ("1.", 2), ("-", 1), ("[1,]", 3), ('{"a" 1}', 5), ('{"a":1,}', 7), ('"\x01"', 1), ('"\\x"', 2), ('"\\u12g4"', 5), ("tru", 3), ("[1 2]", 3), ("1 2", 2), ("[1}", 2), ("", 0), ("[", 1), ("+1", 0), ("nul1", 3)]


def test_validator():
    for g in GOOD:
        machine.read_document(g.encode("utf-8", "surrogatepass"))
    for b, at in BAD:
        with pytest.raises(machine.JsonError) as e:
            machine.read_document(b.encode())
        assert e.value.offset == at, (b, e.value.offset, str(e.value))
    with pytest.raises(machine.JsonError):
        machine.read_document(b'"\xff"')


def test_validator_agrees_with_json_on_mutations():
    r = random.Random(5)
    seeds = [RECORD, "[1,2,[3,{}],\"a\\n\"]", '{"x":{"y":[true,false,null,-1.5e3]}}']
    for _ in range(3000):
        s = list(r.choice(seeds))
        for _ in range(r.randint(1, 3)):
            s[r.randrange(len(s))] = r.choice('{}[],:"0123tfnx -.e\\')
        t = "".join(s)
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            want = True
        except (ValueError, ZeroDivisionError):
            want = False
        try:
            machine.read_document(t.encode())
            got = True
        except machine.JsonError:
            got = False
        assert got == want, t


def test_schema():
    s = schema.Schema({"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 0}, "level": {"enum": ["a", None, True, 1]}, "tags": {"items": {"type": "string"}, "maxItems": 2}}, "additionalProperties": False, "pattern": "x"})
    assert s.unsupported == ["pattern"]
    assert s.check(b'{"id":1.0,"level":null,"tags":["a"]}') == []
    assert [m for _, m in s.check(b'{"id":-1,"level":"b","tags":[1,"a","b"],"z":0}')] == ["-1 is less than the minimum 0", "not one of the values in `enum`", "more than 2 items", "expected string, found number", "property `z` is not allowed here"]
    assert s.check(b'{"level":false}')[0][1] == "missing required property `id`"
    for bad in ("{", {"type": "x"}, {"enum": [[1]]}, {"$ref": "http://x"}, {"$ref": "#/$defs/no"}):
        with pytest.raises(schema.SchemaError):
            schema.Schema(bad)


def test_repeated_keys_elements_and_records(spark):
    rows = ["{" + ",".join(f'"k{i}":{n},"same":{i}' for i in range(5)) + "}" for n in range(150)]
    r = from_texts(spark, rows)
    assert core.duplicate_keys(r).count() == 150 * 4
    assert core.dedup_counters(r).first().keys_checked == 150 * 10
    d = core.duplicate_keys(from_texts(spark, ['{"x":[],"y":"b","x":7,"x":8}', '{"near":[{"d":[3, 3]},2,{"d":[3,3]}],"\\u006eear":0}']), True).orderBy("rec", "first", "second").collect()
    assert [(x.rec, x.kind, x.first, x.second) for x in d] == [(0, "key", 1, 16), (0, "key", 1, 22), (1, "key", 1, 37), (1, "element", 9, 24), (1, "element", 15, 18), (1, "element", 30, 32)]
    assert core.duplicate_records(from_texts(spark, ["[1, 2]", "[ 1,2 ]", "[1,2.0]", "[2,1]"])).collect()[0][1:3] == (0, 1)


def test_export(spark):
    r = from_texts(spark, ['{"a": 1.0, "s":"x, y"}', '{"a":2,"b":[1, 2]}', '{"c":{"d":""}}', "{bad "])
    out = {x.rec: (x.out, x.salvaged) for x in export.ndjson(r).collect()}
    assert out == {0: ('{"a":1.0,"s":"x, y"}', False), 1: ('{"a":2,"b":[1,2]}', False), 2: ('{"c":{"d":""}}', False), 3: ("{bad", True)}
    head, rows = export.csv(r.where("rec < 3"))
    assert head == "a,s,b,c.d"
    assert {x.rec: x.out for x in rows.collect()} == {0: '1.0,"x, y",,', 1: '2,,"[1,2]",', 2: ',,,""'}
    for x in export.pretty(r.where("rec < 3")).collect():
        assert json.loads(x.out) == json.loads(out[x.rec][0])


def test_sniff():
    assert [sniff.sniff(x) for x in (b"", b" \n", b'{"a":1}\n{"a":2}\n', b"[\n1,\n2\n]", b"2026-07-27 INFO", b'{\n "a":1}', b"\xef\xbb\xbf1\n2")] == ["empty", "empty", "ndjson", "document", "unknown", "document", "ndjson"]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ndjson_source_is_the_same_at_any_range(spark, tmp_path, size):
    body = b'\xef\xbb\xbf{"a":1}\r\n\n  {"a":22}\n{"b":"\xc3\xa9"}\nbroken\n{"a":"\xff"}\n   \n{"z":0}'
    f = tmp_path / "x.ndjson"
    f.write_bytes(body)
    rows = sorted(from_ndjson(spark, str(f), size).collect(), key=lambda r: r.rec)
    assert [(r.rec, r.line, bytes(r.raw)) for r in rows] == [(0, 1, b'{"a":1}'), (1, 3, b'{"a":22}'), (2, 4, b'{"b":"\xc3\xa9"}'), (3, 5, b"broken"), (4, 6, b'{"a":"\xff"}'), (5, 8, b'{"z":0}')]
    assert all(body[r.start : r.stop] == bytes(r.raw) for r in rows)


def test_dataset_and_stream(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.ndjson").write_text("".join(f'{{"n":{i},"t":"w{i}"}}\n' for i in range(50)) + "oops\n")
    ds = JsonDataset.open(spark, str(d / "a.ndjson"))
    assert ds.count() == 51 and ds.search("@.n >= 40").count() == 10 and ds.search("W1").count() == 11
    v = ds.validate().collect()
    assert [(r.rec, r.line, r.column) for r in v] == [(50, 51, 1)]
    assert ds.goto("$.t").where("rec = 3").first().value == '"w3"' and [r.key for r in ds.expand("$").where("rec = 0").orderBy("pos").collect()] == ["n", "t"]
    offs = ds.find_offsets("w7")
    assert ds.locate(offs.select("source", "offset")).first().rec == 7
    ds.export(str(tmp_path / "out"), "json")
    assert len(json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).replace("oops", "0"))) == 51
    passes.write(passes.filter_stream(spark, str(d), "@.n < 5"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5


def test_text_goto_and_find_summary(spark):
    r = spark.createDataFrame([("f", 0, 0, "é[1]"), ("f", 1, 10, "[2, 2]"), ("f", 2, 30, None)], "source string, rec long, start long, text string")
    d = JsonDataset(r)
    assert [(x.text, x.truncated) for x in d.text(1, 4).orderBy("rec").collect()] == [("\ufffd[1", False), ("2, ", False), (None, False)]
    assert [x.truncated for x in d.text(0, 9, 3).orderBy("rec").collect()] == [True, True, False]
    assert [x.rec for x in d.goto_offset(29).collect()] == [1] and d.goto_offset(-1).count() == 0 and [x.rec for x in d.goto_row(2).collect()] == [2]
    assert tuple(d.find_summary("2").first()) == (2, 1, False) and tuple(d.find_summary("").first()) == (0, 0, False)
