"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding. Part of quillon.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, kdshard, langid, mixing, neardup
from quillon.llm.base import crc32_of_id, distinct_ids, lean, save, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, go; every other one has a language of the corpus and stays, and where its label is missing it gets the one found."""
    lean(spark)
    model = langid.fit(docs, crc32_of_id() % 5 != 0)
    found = langid.identify(docs, model, COLUMNS[1:]).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def rows_of(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a key for each row: the id, or where ids are missing or repeated a number that is written down in the shared folder."""
    docs = docs.select(COLUMNS)
    if distinct_ids(docs):
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return save(docs.withColumn("row", F.monotonically_increasing_id()), name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one with the smallest id, rows without an id last. Each row is judged by its own text; rows that repeat id and text of one that stays do too."""
    rows = rows_of(docs, "near-rows")
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size=5, threshold=80)
    groups = found.where("not kept").select("component_id").distinct()
    members = found.join(groups, "component_id").select("component_id", F.col("doc_id").alias("row"))
    members = members.join(rows.select("row", "doc_id", F.md5(F.col("text").cast("binary")).alias("same")), "row")
    members = save(members, "near-members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "row")).alias("first"))
    stays = (F.col("row") == F.col("first.row")) | F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("same") == F.col("first.same")), F.lit(False))
    gone = members.join(first, "component_id").where(~stays).select("row")
    return rows.join(save(gone, "near-gone"), "row", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go. Each row is judged by its own text, whatever its id."""
    rows = rows_of(docs, "rows")
    hit = decontam.contamination(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(hit, "row", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once, rarer sources up to twice, in the order in which the blocks are to be read."""
    rows = rows_of(docs, "mix-rows")
    reads = mixing.mix_sources(rows, max_repeat=2.0, cover=True, keep=("row",)).select("row", "pass", "share")  # with cover every row is in pass 0
    return rows.join(reads, "row").repartitionByRange("share", "row").sortWithinPartitions("share", "row", "pass").select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: 24 shards of near equal bytes."""
    return kdshard.sharded(docs, 24).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Mixture inference and the k-d tree are no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
