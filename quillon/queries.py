"""The driver's queries of the JSON verbs, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import core, export, schema
from .plans.dataset import JsonDataset
from .sources.records import from_column


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d):
    return from_column(_t(spark, d, "events"), "props", "event_id")


def _orders(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    doc = F.to_json(F.struct("o_orderkey", F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")).alias("customer"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("order")))
    return from_column(j.select("o_orderkey", doc.alias("j")), "j", "o_orderkey")


def _parts(spark, d):
    doc = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.array("p_type", "p_brand").alias("tags"), (F.col("p_size") > 25).alias("big")))
    return from_column(_t(spark, d, "part").select("p_partkey", doc.alias("j")), "j", "p_partkey")


def _nulls(spark, d):
    """k is null, absent, a string or a number by event."""
    m = F.col("event_id") % 4
    doc = F.when(m == 0, '{"k":null}').when(m == 1, "{}").when(m == 2, '{"k":"60"}').otherwise('{"k":60}')
    return from_column(_t(spark, d, "events").select("event_id", doc.alias("j")), "j", "event_id")


def _broken(spark, d):
    m = F.col("event_id") % 6
    p = F.col("props")
    doc = F.when(m == 0, F.concat(p, F.lit("}"))).when(m == 1, F.expr("substring(props, 1, length(props) - 1)")).when(m == 2, F.concat(p, F.lit(" "), p)).when(m == 3, '{"a":01}').otherwise(p)
    return from_column(_t(spark, d, "events").select("event_id", doc.alias("j")), "j", "event_id")


_BROKEN = "CASE event_id % 6 WHEN 0 THEN props || '}' WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN props || ' ' || props WHEN 3 THEN '{\"a\":01}' ELSE props END"
_K = "json_extract(props, '$.k')::DOUBLE"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("rec")


def _filter(records, expression):
    return lambda s, d: _ids(core.filter_records(records(s, d), expression))


def _schema(records, text):
    return lambda s, d: schema.check_schema(records(s, d), text).select("rec", "message")


def _lineitem_arrays(spark, d):
    a = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    return from_column(a.select("l_orderkey", F.to_json(F.col("x.q")).alias("j")), "j", "l_orderkey")


def _repeat_keys(spark, d):
    p = _t(spark, d, "part")
    doc = F.concat(F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"size":'), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(',"id":0')).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit(',"id":1,"size":2')).otherwise(""), F.lit("}"))
    return from_column(p.select("p_partkey", doc.alias("j")), "j", "p_partkey")


def _conversations(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return from_column(c.select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("j")), "j", "conv_id")


def _find_docs(s, d):
    r = from_column(_t(s, d, "documents"), "text", "doc_id")
    return core.find_counts(r, "er ", True).select("rec", "matches")


def _find_pages(s, d):
    r = from_column(_t(s, d, "pages"), "html", "page_id")
    return core.find_counts(r, "<P").select("rec", "matches")


def _find_offsets(s, d):
    r = from_column(_t(s, d, "events"), "props", "event_id")
    return core.find_offsets(r, "7", True).select("rec", "offset")


def _locate(s, d):
    e = _t(s, d, "events").select(F.col("event_id"), (F.col("event_id") * 20).alias("start"))
    r = e.select(F.lit("").alias("source"), F.col("event_id").alias("rec"), "start")
    o = e.select(F.lit("").alias("source"), (F.col("start") + F.col("event_id") % 25 - 3).alias("offset"))
    return core.locate(r, o).select("offset", "rec")


def _dups(s, d):
    e = _t(s, d, "events")
    doc = F.concat(F.lit("{ \"t\":"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(""), F.to_json(F.struct("event_type")), F.lit(',"u":'), (F.col("user_id") % 50).cast("string"), F.lit("}"))
    return core.duplicate_records(from_column(e.select("event_id", doc.alias("j")), "j", "event_id")).select("first_rec", "second_rec")


def _csv(s, d):
    head, rows = export.csv(_parts(s, d))
    return rows.select("rec", "out", F.lit(head).alias("header"))


def _folder(spark, name: str) -> str:
    """A new folder below the one that all executors share; only a local session may have none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/json/{name}-{uuid.uuid4().hex}"


def _file(df: DataFrame, key: str, text: str, name: str) -> str:
    """The texts as one file in the order of the key; its pattern."""
    path = _folder(df.sparkSession, name)
    df.select(key, text).repartition(1).sortWithinPartitions(key).select(text).write.text(path)
    return f"{path}/part-*"


def _ndjson(s, d) -> JsonDataset:
    return JsonDataset.open(s, _file(_t(s, d, "events"), "event_id", "props", "events"), "ndjson")


def _joined(records: DataFrame, value: str, a: str, z: str, name: str) -> str:
    one = records.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec", F.expr(value).alias("v")))), lambda x: x["v"]), ",\n  ").alias("v"))
    path = _folder(records.sparkSession, name)
    one.select(F.concat(F.lit(a), "v", F.lit(z))).repartition(1).write.text(path)
    return f"{path}/part-*"


def _array_document(s, d) -> JsonDataset:
    return JsonDataset.open(s, _joined(_parts(s, d), "text", "[\n  ", "\n]", "array"))


def _object_document(s, d) -> JsonDataset:
    return JsonDataset.open(s, _joined(_parts(s, d), """concat('"', rec, '": ', text)""", "{\n  ", "\n}", "object"))


def _document_export(s, d):
    path = _folder(s, "whole")
    _object_document(s, d).export(path, "json")
    return s.read.text(path)


def _json_lines(s, d):
    path = _folder(s, "lines")
    export.write(_parts(s, d), path, "json")
    return s.read.text(path)


def _spaced_events(s, d):
    return _events(s, d).withColumn("start", F.col("rec") * 20)


QUERIES = {
    "filter_num_gt": _filter(_events, "@.k > 50"),
    "filter_and_or_not": _filter(_events, "(@.k >= 10 && @.k < 30) || !(@.k != 77)"),
    "filter_literal_left": _filter(_events, "90 <= @.k"),
    "filter_missing_ne": _filter(_events, "@.none != 1"),
    "filter_exists": _filter(_nulls, "@.k"),
    "filter_not_exists": _filter(_nulls, "!$.k"),
    "filter_type_mismatch": _filter(_nulls, "@.k == '60'"),
    "filter_null": _filter(_nulls, "@.k == null"),
    "filter_ne_kinds": _filter(_nulls, "@['k'] != 60"),
    "filter_bool": _filter(_parts, "@.big == true"),
    "filter_text_order": _filter(_parts, '@.brand >= "Brand#3"'),
    "filter_nested_orders": _filter(_orders, "$[?@.customer.segment == 'BUILDING' && @.order['status'] == 'F']"),
    "filter_array_index": _filter(_parts, "@.tags[1] == 'Brand#11' || @.tags[7]"),
    "filter_malformed": _filter(_broken, "@.k != 1"),
    "filter_count": lambda s, d: core.filter_pass(_events(s, d), "@.k > 50")[1],
    "filter_list": lambda s, d: _ids(core.filter_pass(_events(s, d), "@.k > 50")[0]),
    "conversation_docs": _filter(_conversations, "@.turns[0].role == 'system'"),
    "find_count_documents": _find_docs,
    "find_casefold_pages": _find_pages,
    "find_offsets": _find_offsets,
    "locate_offset_row": _locate,
    "validate_records": lambda s, d: core.validate(_broken(s, d)).select("rec"),
    "validate_positions": lambda s, d: core.validate(_broken(s, d)).select("rec", "offset", "line", "column"),
    "validate_summary": lambda s, d: core.validate_summary(_broken(s, d)).select("checked", "records", "invalid", "is_valid"),
    "validate_values": lambda s, d: core.validate_summary(_broken(s, d)).select("values"),
    "validate_messages": lambda s, d: core.validate(_broken(s, d)).select("rec", "message"),
    "validate_listed": lambda s, d: core.capped(core.validate(_broken(s, d)))[0].select("rec", "offset"),
    "validate_total": lambda s, d: core.capped(core.validate(_broken(s, d)))[1],
    "rows_fields": lambda s, d: core.rows(_parts(s, d), 100, 50).select("rec", "fields", "more"),
    "find_from_offset": lambda s, d: core.find_offsets(_spaced_events(s, d), "7", True, None, 5000).select("rec", "offset"),
    "find_next": lambda s, d: core.find_next(_spaced_events(s, d), "7", 5000, True).select("rec", "offset", "wrapped"),
    "find_previous": lambda s, d: core.find_next(_spaced_events(s, d), "7", 0, True, back=True).select("rec", "offset", "wrapped"),
    "position_in_view": lambda s, d: core.position(core.filter_records(_events(s, d), "@.k > 50"), 500),
    "ndjson_spans": lambda s, d: _ndjson(s, d).records.select("rec", "line", "start", "stop", "text"),
    "ndjson_filter": lambda s, d: _ids(_ndjson(s, d).filter("@.k > 50").records),
    "ndjson_rows": lambda s, d: _ndjson(s, d).rows(200, 100).select("rec", "kind", "children", "fields"),
    "document_filter": lambda s, d: _array_document(s, d).filter("@.size <= 10 && @.tags[1] >= 'Brand#2'").records.select("rec", "line"),
    "document_members": lambda s, d: _object_document(s, d).filter("@.big == true").records.select("rec", "key"),
    "document_export": _document_export,
    "export_json_array": _json_lines,
    "schema_type": _schema(_nulls, {"properties": {"k": {"type": ["integer", "null"]}}}),
    "schema_required": _schema(_nulls, {"required": ["k"]}),
    "schema_enum": _schema(_parts, {"properties": {"brand": {"enum": ["Brand#11", "Brand#12"]}}}),
    "schema_bounds": _schema(_parts, {"properties": {"size": {"minimum": 10, "exclusiveMaximum": 40}}}),
    "schema_items_ref": _schema(_parts, {"$defs": {"short": {"maxLength": 7}}, "properties": {"tags": {"items": {"$ref": "#/$defs/short"}, "maxItems": 2}}}),
    "schema_additional": _schema(_parts, {"properties": {"id": True, "brand": True, "size": True, "tags": True}, "additionalProperties": False}),
    "dedup_records": _dups,
    "dedup_keys": lambda s, d: core.duplicate_keys(_repeat_keys(s, d)).select("rec", "what", "first"),
    "dedup_elements": lambda s, d: core.duplicate_keys(_lineitem_arrays(s, d), True).select("rec", "what"),
    "dedup_counters": lambda s, d: core.dedup_counters(_lineitem_arrays(s, d), True),
    "export_ndjson_min": lambda s, d: export.ndjson(_events(s, d)).select("rec", "out", "salvaged"),
    "export_salvage": lambda s, d: export.ndjson(_broken(s, d)).select("rec", "out", "salvaged"),
    "export_pretty": lambda s, d: export.pretty(_events(s, d)).select("rec", "out"),
    "export_csv_rows": _csv,
    "csv_columns": lambda s, d: export.csv_columns(_parts(s, d)),
    "rows_slice": lambda s, d: core.rows(_parts(s, d), 100, 50).select("rec", "kind", "children", "preview"),
    "rows_kind_count": lambda s, d: core.rows(_broken(s, d), 0, 1 << 60).groupBy("kind").agg(F.count("*").alias("n")),
    "expand_children": lambda s, d: core.expand(_parts(s, d), "$.tags").select("rec", "pos", "kind", "value"),
    "expand_object": lambda s, d: core.expand(_orders(s, d), "$.customer").select("rec", "pos", "key", "kind", "value"),
    "goto_offset": lambda s, d: core.goto_offset(_events(s, d).withColumn("start", F.col("rec") * 20), 20 * 77 + 5).select("rec"),
    "find_summary": lambda s, d: core.find_summary(from_column(_t(s, d, "documents"), "text", "doc_id"), "er ", True),
    "filter_bool_order": _filter(_parts, "@.big < true || @.size <= 3e1 && !(@.missing >= null)"),
    "schema_keywords": _schema(_parts, {"minProperties": 6, "properties": {"big": {"const": True}, "brand": {"minLength": 9}, "tags": {"minItems": 2, "maxItems": 1}, "size": {"maximum": 30, "exclusiveMinimum": 5}}}),
    "schema_extra": _schema(_parts, {"properties": {"id": True, "tags": True, "brand": True}, "additionalProperties": {"type": "boolean"}}),
    "goto_path": lambda s, d: core.goto(_orders(s, d), "$.customer.segment").select("rec", "value"),
}

_SEVENS = "(SELECT event_id AS rec, event_id * 20 + i - 1 AS o FROM (SELECT event_id, props, unnest(range(1, length(props) + 1)) AS i FROM events) WHERE substring(props, i, 1) = '7')"
_LINES = "(SELECT props, row_number() OVER w - 1 AS rec, (coalesce(sum(strlen(props) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM events WINDOW w AS (ORDER BY event_id))"
_PART = """('{"id":' || p_partkey || ',"brand":"' || p_brand || '","size":' || p_size || ',"tags":["' || p_type || '","' || p_brand || '"],"big":' || (p_size > 25)::VARCHAR || '}')"""
_BAD_KIND = "CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN 'invalid' ELSE 'object' END"
ORACLE_SQL = {
    "filter_num_gt": f"SELECT event_id AS rec FROM events WHERE {_K} > 50",
    "filter_and_or_not": f"SELECT event_id AS rec FROM events WHERE ({_K} >= 10 AND {_K} < 30) OR {_K} = 77",
    "filter_literal_left": f"SELECT event_id AS rec FROM events WHERE {_K} >= 90",
    "filter_missing_ne": "SELECT event_id AS rec FROM events WHERE json_valid(props)",
    "filter_exists": "SELECT event_id AS rec FROM events WHERE event_id % 4 <> 1",
    "filter_not_exists": "SELECT event_id AS rec FROM events WHERE event_id % 4 = 1",
    "filter_type_mismatch": "SELECT event_id AS rec FROM events WHERE event_id % 4 = 2",
    "filter_null": "SELECT event_id AS rec FROM events WHERE event_id % 4 = 0",
    "filter_ne_kinds": "SELECT event_id AS rec FROM events WHERE event_id % 4 <> 3",
    "filter_bool": "SELECT p_partkey AS rec FROM part WHERE p_size > 25",
    "filter_text_order": "SELECT p_partkey AS rec FROM part WHERE p_brand >= 'Brand#3'",
    "filter_nested_orders": "SELECT o_orderkey AS rec FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'",
    "filter_array_index": "SELECT p_partkey AS rec FROM part WHERE p_brand = 'Brand#11'",
    "filter_malformed": f"SELECT event_id AS rec FROM events WHERE event_id % 6 > 3 AND {_K} <> 1",
    "filter_count": f"SELECT count(*) AS total FROM events WHERE {_K} > 50",
    "filter_list": f"SELECT event_id AS rec FROM events WHERE {_K} > 50 ORDER BY event_id LIMIT 10000",
    "conversation_docs": "SELECT conv_id AS rec FROM (SELECT conv_id, arg_min(role, turn) AS r FROM conversations GROUP BY conv_id) WHERE r = 'system'",
    "find_count_documents": "SELECT doc_id AS rec, ((strlen(text) - strlen(replace(text, 'er ', ''))) // 3)::BIGINT AS matches FROM documents WHERE contains(text, 'er ')",
    "find_casefold_pages": "SELECT page_id AS rec, ((strlen(html) - strlen(replace(replace(html, '<p', ''), '<P', ''))) // 2)::BIGINT AS matches FROM pages WHERE contains(html, '<p') OR contains(html, '<P')",
    "find_offsets": "SELECT event_id AS rec, (i - 1)::BIGINT AS \"offset\" FROM (SELECT event_id, props, unnest(range(1, length(props) + 1)) AS i FROM events) WHERE substring(props, i, 1) = '7'",
    "locate_offset_row": "SELECT o AS \"offset\", rec FROM (SELECT event_id * 20 + event_id % 25 - 3 AS o FROM events) a ASOF JOIN (SELECT event_id AS rec, event_id * 20 AS start FROM events) b ON a.o >= b.start",
    "validate_records": f"SELECT event_id AS rec FROM events WHERE NOT json_valid({_BROKEN})",
    "validate_positions": f"SELECT event_id AS rec, o AS \"offset\", 1::BIGINT AS line, o + 1 AS \"column\" FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN length(props) WHEN 1 THEN length(props) - 1 WHEN 2 THEN length(props) + 1 ELSE 6 END AS o FROM events WHERE event_id % 6 < 4)",
    "validate_summary": f"SELECT sum(strlen(j))::BIGINT AS checked, count(*) AS records, count(*) FILTER (NOT json_valid(j)) AS invalid, count(*) FILTER (NOT json_valid(j)) = 0 AS is_valid FROM (SELECT {_BROKEN} AS j FROM events)",
    "validate_values": "SELECT count(*) AS values FROM events",
    "validate_messages": "SELECT event_id AS rec, CASE event_id % 6 WHEN 0 THEN 'expected the end of the input, found `}`' WHEN 1 THEN 'input ended with 1 container(s) unclosed, innermost an object' WHEN 2 THEN 'a second top-level value; this input was read as a single document' ELSE 'numbers may not have leading zeros' END AS message FROM events WHERE event_id % 6 < 4",
    "validate_listed": "SELECT event_id AS rec, CASE event_id % 6 WHEN 0 THEN length(props) WHEN 1 THEN length(props) - 1 WHEN 2 THEN length(props) + 1 ELSE 6 END AS \"offset\" FROM events WHERE event_id % 6 < 4 ORDER BY event_id LIMIT 1000",
    "validate_total": "SELECT count(*) AS total FROM events WHERE event_id % 6 < 4",
    "rows_fields": "SELECT p_partkey AS rec, 'id: ' || p_partkey || ', brand: \"' || p_brand || '\", size: ' || p_size || ', tags: […], big: ' || (p_size > 25)::VARCHAR AS fields, false AS more FROM part WHERE p_partkey >= 100 AND p_partkey < 150",
    "find_from_offset": f"SELECT rec, o AS \"offset\" FROM {_SEVENS} WHERE o >= 5000",
    "find_next": f"SELECT rec, o AS \"offset\", false AS wrapped FROM {_SEVENS} WHERE o > 5000 ORDER BY o LIMIT 1",
    "find_previous": f"SELECT rec, o AS \"offset\", true AS wrapped FROM {_SEVENS} ORDER BY o DESC LIMIT 1",
    "position_in_view": f"SELECT count(*) FILTER (event_id < 500) AS position, bool_or(event_id = 500) AS shown FROM events WHERE {_K} > 50",
    "ndjson_spans": f"SELECT rec, rec + 1 AS line, start, start + strlen(props) AS stop, props AS text FROM {_LINES}",
    "ndjson_filter": f"SELECT rec FROM {_LINES} WHERE {_K} > 50",
    "ndjson_rows": f"SELECT rec, 'object' AS kind, 1::BIGINT AS children, 'k: ' || json_extract_string(props, '$.k') AS fields FROM {_LINES} WHERE rec >= 200 AND rec < 300",
    "document_filter": "SELECT rec, rec + 2 AS line FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rec FROM part) WHERE p_size <= 10 AND p_brand >= 'Brand#2'",
    "document_members": "SELECT rec, p_partkey::VARCHAR AS key FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rec FROM part) WHERE p_size > 25",
    "document_export": f"SELECT '{{' || string_agg('\"' || p_partkey || '\":' || {_PART}, ',' ORDER BY p_partkey) || '}}' AS value FROM part",
    "export_json_array": f"SELECT CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN '[' ELSE '' END || {_PART} || CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN ']' ELSE ',' END AS value FROM part",
    "schema_type": "SELECT event_id AS rec, 'expected integer or null, found string' AS message FROM events WHERE event_id % 4 = 2",
    "schema_required": "SELECT event_id AS rec, 'missing required property `k`' AS message FROM events WHERE event_id % 4 = 1",
    "schema_enum": "SELECT p_partkey AS rec, 'not one of the values in `enum`' AS message FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')",
    "schema_bounds": "SELECT p_partkey AS rec, p_size || CASE WHEN p_size < 10 THEN ' is less than the minimum 10' ELSE ' must be less than 40' END AS message FROM part WHERE p_size < 10 OR p_size >= 40",
    "schema_items_ref": "SELECT p_partkey AS rec, 'longer than the maximum length 7' AS message FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS x FROM part) WHERE length(x) > 7",
    "schema_additional": "SELECT p_partkey AS rec, 'property `big` is not allowed here' AS message FROM part",
    "dedup_records": "SELECT min(event_id) OVER w AS first_rec, event_id AS second_rec FROM events WINDOW w AS (PARTITION BY event_type, user_id % 50) QUALIFY event_id > min(event_id) OVER w",
    "dedup_keys": "SELECT p_partkey AS rec, 'id' AS what, 1::BIGINT AS first FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, k, CASE k WHEN 'id' THEN 1 ELSE 7 + length(p_partkey::VARCHAR) END FROM part, (VALUES ('id'), ('size')) v(k) WHERE p_size % 3 = 0",
    "dedup_elements": "SELECT l_orderkey AS rec, q::INT::VARCHAR AS what FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_quantity::INT ORDER BY l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "dedup_counters": "SELECT 0::BIGINT AS keys_checked, count(*) AS elements_checked, (count(*) - count(DISTINCT (l_orderkey, l_quantity::INT)))::BIGINT AS total FROM lineitem",
    "export_ndjson_min": "SELECT event_id AS rec, replace(props, ' ', '') AS out, false AS salvaged FROM events",
    "export_salvage": f"SELECT event_id AS rec, CASE WHEN json_valid(j) THEN replace(j, ' ', '') ELSE j END AS out, NOT json_valid(j) AS salvaged FROM (SELECT event_id, {_BROKEN} AS j FROM events)",
    "export_pretty": "SELECT event_id AS rec, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS out FROM events",
    "export_csv_rows": "SELECT p_partkey AS rec, p_partkey || ',' || p_brand || ',' || p_size || ',\"[\"\"' || p_type || '\"\",\"\"' || p_brand || '\"\"]\",' || (p_size > 25)::VARCHAR AS out, 'id,brand,size,tags,big' AS header FROM part",
    "csv_columns": "SELECT path, (SELECT min(p_partkey) FROM part) AS first_rec, seq::BIGINT AS first_seq FROM (VALUES ('id', 0), ('brand', 1), ('size', 2), ('tags', 3), ('big', 4)) v(path, seq)",
    "rows_slice": "SELECT p_partkey AS rec, 'object' AS kind, 5::BIGINT AS children, left('{\"id\":' || p_partkey || ',\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"tags\":[\"' || p_type || '\",\"' || p_brand || '\"],\"big\":' || (p_size > 25)::VARCHAR || '}', 120) AS preview FROM part WHERE p_partkey >= 100 AND p_partkey < 150",
    "rows_kind_count": f"SELECT {_BAD_KIND} AS kind, count(*) AS n FROM events GROUP BY 1",
    "expand_children": "SELECT p_partkey AS rec, pos::BIGINT AS pos, 'string' AS kind, '\"' || x || '\"' AS value FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS x, unnest([0, 1]) AS pos FROM part)",
    "expand_object": "SELECT o_orderkey AS rec, pos::BIGINT AS pos, key, kind, value FROM (SELECT o_orderkey, unnest([0, 1]) AS pos, unnest(['key', 'segment']) AS key, unnest(['number', 'string']) AS kind, unnest([c_custkey::VARCHAR, '\"' || c_mktsegment || '\"']) AS value FROM orders JOIN customer ON o_custkey = c_custkey)",
    "goto_offset": "SELECT event_id AS rec FROM events WHERE event_id * 20 <= 1545 ORDER BY event_id DESC LIMIT 1",
    "find_summary": "SELECT sum((strlen(text) - strlen(replace(text, 'er ', ''))) // 3)::BIGINT AS matches, count(*) AS records, sum((strlen(text) - strlen(replace(text, 'er ', ''))) // 3) > 10000 AS limited FROM documents WHERE contains(text, 'er ')",
    "filter_bool_order": "SELECT p_partkey AS rec FROM part WHERE p_size <= 30",
    "schema_keywords": "SELECT p_partkey AS rec, m AS message FROM (SELECT p_partkey, unnest(['fewer than 6 properties', 'more than 1 items', CASE WHEN p_size <= 25 THEN 'not the value that `const` asks for' END, CASE WHEN length(p_brand) < 9 THEN 'shorter than the minimum length 9' END, CASE WHEN p_size > 30 THEN p_size || ' is more than the maximum 30' END, CASE WHEN p_size <= 5 THEN p_size || ' must be greater than 5' END]) AS m FROM part) WHERE m IS NOT NULL",
    "schema_extra": "SELECT p_partkey AS rec, 'expected boolean, found number' AS message FROM part",
    "goto_path": "SELECT o_orderkey AS rec, '\"' || c_mktsegment || '\"' AS value FROM orders JOIN customer ON o_custkey = c_custkey",
}
