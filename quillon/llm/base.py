"""Shared plumbing of the training-data operators: tables, scratch tables and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BYTES = str(1 << 20)
FILE_ROWS = 250_000
#: Pages are measured from the first row on. By default they are from the hundredth, and the codecs keep direct buffers of the largest page in each task's thread, beside the heap: rows of a MB made pages of 30.
PAGES = {"parquet.page.size.row.check.min": "1"}
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(spark: SparkSession) -> None:
    """Arrow batches end at 1 MiB, so memory does not depend on how long the texts of a batch are. A session's own bound stays."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers can open."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The files survive the loss of any executor, unlike a local checkpoint. The
    shuffle files of the job go when it has ended, as nothing reads them again.
    With ``rows`` (about as many narrow rows come) there is no more than a file for each FILE_ROWS.
    Inside a ``cleared`` block the table goes at the block's end; with ``keep``, at that of the block around it, if there is one.
    """
    spark = df.sparkSession
    lean(spark)
    path = scratch_path(spark, name)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    with released(spark):
        (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.options(**PAGES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Tables saved in this block are deleted at its end: what it returns must be saved with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Jobs in this block delete their shuffle files at their end."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def drop(saved: DataFrame) -> None:
    """Delete one saved table; call it only when nothing reads it any more."""
    files = saved.inputFiles()
    if files:
        _delete(saved.sparkSession, files[0].rpartition("/")[0])


def distinct_ids(docs: DataFrame) -> bool:
    """Whether every row has an id and no two have the same."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def crc32_of_id(col: str = "doc_id") -> Column:
    """Unsigned crc32 of an id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(node, component_id)``, the smallest node id of each.

    Alternating large-star and small-star rounds: O(log n) rounds, each of which
    only takes minima by node (combined before the shuffle) and joins on the node
    (which the adaptive planner splits where a node is hot). No component is ever
    collected into one task, and every round is written to the shared folder.
    Nulls and loops are ignored; nodes without an edge are not returned.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = save(e, name)
    seen, n = None, None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(small.unionAll(low2.select("u", F.col("m").alias("v"))).distinct(), name, n)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen, n = now, 2 * now[0]
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )


LONG, INT, STR, BIN, DBL, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in kinds.items()])
