"""One object for the whole library: ``JsonDataset.open(spark, path)`` and its verbs."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import machine
from ..operators import core, export, schema
from ..sources import records as source

EXPANDED = 16


class JsonDataset:
    """Records and what is known about where they are from: ``kind`` (records, ndjson, document, empty, unknown), the whole documents, the index."""

    def __init__(self, records: DataFrame, kind: str = "records", whole: DataFrame | None = None, index: source.Index | None = None):
        self.records, self.kind, self.whole, self.index = records, kind, whole, index
        self._expanded: OrderedDict[str, DataFrame] = OrderedDict()

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], format: str | None = None) -> JsonDataset:
        """A file, a folder, a pattern, or a list of these; the format is that of the first file with contents, if it is not given."""
        kind = format or source.sniff_path(path)
        if kind == "document":
            whole = source.documents(spark, path)
            return cls(source.split_documents(whole), kind, whole)
        index = source.index(spark, path)
        return cls(source.from_ndjson(spark, index), kind, index=index)

    @classmethod
    def from_text(cls, spark: SparkSession, text: str) -> JsonDataset:
        kind, rows = source.from_text(spark, text)
        return cls(source.split_documents(rows), kind, rows) if kind == "document" else cls(rows, kind)

    @classmethod
    def from_column(cls, df: DataFrame, text: str, key: str) -> JsonDataset:
        return cls(source.from_column(df, text, key))

    def filter(self, expression: str) -> JsonDataset:
        return JsonDataset(core.filter_records(self.records, expression))

    def find(self, needle: str, case_sensitive: bool = False) -> JsonDataset:
        return JsonDataset(core.find_counts(self.records, needle, case_sensitive).drop("matches"))

    def search(self, text: str) -> JsonDataset:
        """A filter if the text starts with @ or $, else a literal search."""
        return self.filter(text) if text.lstrip()[:1] in ("@", "$") and text.strip() else self.find(text)

    def find_offsets(self, needle: str, case_sensitive: bool = False, cap: int | None = core.FIND_CAP, start: int = 0) -> DataFrame:
        return core.find_offsets(self.records, needle, case_sensitive, cap, start)

    def find_next(self, needle: str, offset: int, case_sensitive: bool = False, back: bool = False) -> DataFrame:
        return core.find_next(self.records, needle, offset, case_sensitive, back)

    def position(self, rec: int) -> DataFrame:
        return core.position(self.records, rec)

    def locate(self, offsets: DataFrame) -> DataFrame:
        return core.locate(self.records, offsets)

    def validate(self) -> DataFrame:
        """An empty input is itself an error; a document that is not well-formed has one, at its place in the file."""
        out = core.validate(self.records)
        if self.kind == "empty":
            none = out.sparkSession.createDataFrame([(None, None, 0, 1, 1, machine.MESSAGES["empty"])], out.schema)
            out = out.unionAll(none)
        return out

    def summary(self) -> DataFrame:
        return core.validate_summary(self.records)

    def problems(self, schema_text=None, cap: int = core.PROBLEM_CAP) -> tuple[DataFrame, DataFrame]:
        """(the first ``cap`` problems in order, how many there are) of validation, or of a schema."""
        return core.capped(self.validate() if schema_text is None else self.check_schema(schema_text), cap)

    def check_schema(self, text) -> DataFrame:
        return schema.check_schema(self.records, text)

    def duplicate_records(self) -> DataFrame:
        return core.duplicate_records(self.records)

    def duplicate_keys(self, elements: bool = False) -> DataFrame:
        return core.duplicate_keys(self.records, elements)

    def rows(self, start: int = 0, count: int = 50) -> DataFrame:
        if self.index is not None:  # only the ranges that hold the slice are read
            return core.rows(source.from_ndjson(self.records.sparkSession, self.index, start=start, count=count), start, count)
        return core.rows(self.records, start, count)

    def expand(self, path: str = "$") -> DataFrame:
        """The children at a path; the last EXPANDED ones stay (in memory or on disk) until others are asked for."""
        if path in self._expanded:
            self._expanded.move_to_end(path)
        else:
            self._expanded[path] = core.expand(self.records, path).persist(StorageLevel.MEMORY_AND_DISK)
            if len(self._expanded) > EXPANDED:
                self._expanded.popitem(last=False)[1].unpersist()
        return self._expanded[path]

    def close(self) -> None:
        while self._expanded:
            self._expanded.popitem()[1].unpersist()

    def goto(self, path: str) -> DataFrame:
        return core.goto(self.records, path)

    def goto_row(self, rec: int) -> DataFrame:
        if self.index is not None:
            return source.from_ndjson(self.records.sparkSession, self.index, start=rec, count=1)
        return self.records.where(F.col("rec") == rec)

    def goto_offset(self, offset: int) -> DataFrame:
        return core.goto_offset(self.records, offset)

    def text(self, start: int, end: int, limit: int = 1 << 20) -> DataFrame:
        return core.text_range(self.records, start, end, limit)

    def find_summary(self, needle: str, case_sensitive: bool = False) -> DataFrame:
        return core.find_summary(self.records, needle, case_sensitive)

    def export(self, path: str, kind: str = "ndjson", indent: int = 2) -> None:
        """A folder of text files in record order. A whole document is written as it is, without brackets around it."""
        if self.whole is None:
            export.write(self.records, path, kind, indent)
        elif kind in ("json", "json-pretty"):
            export.write(self.whole, path, kind, indent, wrap=False)
        else:  # the elements of an array, or one line for any other root
            array = F.substring(F.btrim(F.col("text"), F.lit(" \t\r\n")), 1, 1) == "["
            rest = self.whole.where(~F.coalesce(array, F.lit(False)))
            names = rest.columns
            listed = self.records.join(self.whole.where(array).select("source"), "source", "left_semi").select(names)
            export.write(listed.unionAll(rest), path, kind, indent)

    def count(self) -> int:
        return self.index.records if self.index is not None else self.records.count()

    def memory(self) -> dict[str, int]:
        """Bytes that the expansions kept by this object take, in memory and on disk."""
        tracker = self.records.sparkSession.sparkContext._jsc.sc().getRDDStorageInfo()
        return {"memory": sum(x.memSize() for x in tracker), "disk": sum(x.diskSize() for x in tracker)}
