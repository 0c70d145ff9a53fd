"""Native text kernels for well-formed JSON: acceptance, minifying, kinds. All are Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strings are kept ($1), white space goes; possessive, so long strings need no stack
MINIFY = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]++'
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'
_MINIFY_PY = re.compile(MINIFY, re.S)


def minify_text(s: str) -> str:
    return _MINIFY_PY.sub(lambda m: m[1] or "", s)


def minify(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("(?s)" + MINIFY), F.lit("$1"))


def guarded(text: Column) -> Column:
    """[record, sentinel] as a variant; NULL where the parser refuses. The sentinel proves that exactly one value was read."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]')))


def accepted(v: Column, text: Column) -> Column:
    """Whether ``guarded(text)`` holds one well-formed value. A false refusal is overturned by the exact stage."""
    return F.coalesce((F.try_variant_get(v, "$[1]", "string") == F.sha2(text, 256)) & F.try_variant_get(v, "$[2]", "variant").isNull(), F.lit(False)) & ~F.coalesce(text.rlike(r"\\u[dD][89a-fA-F]"), F.lit(False))


def with_variant(text: Column, use) -> Column:
    """``use(variant)`` with one parse, however often the variant is used."""
    return F.transform(F.array(guarded(text)), use)[0]


def is_json(text: Column) -> Column:
    return with_variant(text, lambda v: accepted(v, text))


def kind_of(x: Column) -> Column:
    """object, array, string, number, boolean, null of a variant; NULL for nothing."""
    return kind_name(F.schema_of_variant(x))


def kind_name(s: Column) -> Column:
    """The same from ``schema_of_variant``, for one reading of it."""
    return (
        F.when(s.isNull(), F.lit(None).cast("string")).when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("number")
    )
