"""Passes over a growing folder of NDJSON files, as micro-batches that resume where they stopped; progress, and cancelling by tag.

Stream rows have no file order, so ``rec`` is a hash of file and text; all else is as in batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import core


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.input_file_name().alias("source"), F.xxhash64(F.input_file_name(), "value").alias("rec"), F.col("value").alias("text")).where(F.btrim(F.col("text"), F.lit(" \t\r\n")) != "")


def filter_stream(spark: SparkSession, path: str, expression: str) -> DataFrame:
    return core.filter_records(read(spark, path), expression)


def validate_stream(spark: SparkSession, path: str) -> DataFrame:
    return core.validate(read(spark, path))


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now, then stop; a later call goes on from there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """batches, rows, rows_per_second of a pass so far, and whether it still runs."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "rows_per_second": seen[-1]["processedRowsPerSecond"] if seen else 0.0, "running": query.isActive}


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started in this block (and thread) can be cancelled by ``cancel``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs of a pass; a newer search calls this with the tag of the one it replaces."""
    spark.sparkContext.cancelJobsWithTag(tag)


def tasks(spark: SparkSession) -> tuple[int, int]:
    """(finished, all) tasks of the jobs that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getActiveJobsIds() for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
    found = [x for x in map(tracker.getStageInfo, stages) if x]
    return sum(x.numCompletedTasks for x in found), sum(x.numTasks for x in found)
