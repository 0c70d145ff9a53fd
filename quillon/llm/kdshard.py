"""Sharding by a k-d tree over document metadata.

A node with n shards is cut along its widest dimension (width relative to the
whole table: size, source or language) at the weighted quantile that gives n // 2 of its shards their share
of the bytes; cuts go on until every leaf is one shard of the target size.
Quantiles are distributed: histograms of ``bins`` bins, narrowed until the bin
that holds the cut weighs less than ``tolerance`` of a shard, one job for all
nodes of a level. The driver sees at most one row per node, and what it sends back is one row per node too.

Equal texts are one group with the smallest source and language of its rows, and a key
within a dimension ends with the text's crc32, so they stay
together except at a cut that a heavy group straddles, which goes on by doc_id.

Null texts have no bytes, null metadata is a value of its own, repeated rows are
rows, an empty table gives no rows and other columns are ignored. With fewer
rows than shards, or very heavy ones, some shards stay empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import cleared, drop, save

DIMS = ("d_size", "d_source", "d_lang")
LOWEST = -(1 << 62)


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one 52-bit key per dimension: 20 bits of the group's value, 32 of the crc."""
    text = F.col("text").cast("binary")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    names = set(docs.columns)
    word = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), 44) if c in names else F.lit(0).cast("long")
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), word("source").alias("v_source"), word("lang").alias("v_lang")), "rows")
    groups = rows.groupBy("size", "text_crc32").agg(F.min("v_source").alias("v_source"), F.min("v_lang").alias("v_lang"))
    key = lambda v: F.shiftleft(v.cast("long"), 32) + F.col("text_crc32")
    return rows.drop("v_source", "v_lang").join(groups, ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", key(F.least(F.lit((1 << 20) - 1), F.floor(F.log2("size") * 32_000))).alias("d_size"), key(F.col("v_source")).alias("d_source"), key(F.col("v_lang")).alias("d_lang")
    )


def _told(rows: DataFrame, nodes: dict[int, dict], fields: str) -> DataFrame:
    """The rows of these nodes with the nodes' fields: a broadcast of one small row a node."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([{"node": n, **{k: x[k] for k in names}} for n, x in nodes.items()])
    table = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<node int, {fields}>>")).alias("x")).select("x.*")
    return rows.join(F.broadcast(table), "node")


def _search(rows: DataFrame, nodes: dict[int, dict], bins: int, limit: float, heavy: float) -> None:
    """Narrow each node's [lo, hi) of ``key`` until the bin that holds its target weighs at most ``limit`` or is one key.

    nodes[n] has lo, hi and target (weight still to go left of the cut); sets cut and rest (weight missing, if one key over ``heavy`` holds the cut).
    """
    live = {n: x for n, x in nodes.items() if x["hi"] > x["lo"]}
    while live:
        for x in live.values():
            x["step"] = max(1, -(-(x["hi"] - x["lo"]) // bins))
            x["target"] = float(x["target"])
        told = _told(rows, live, "lo long, hi long, step long, target double").where("key >= lo and key < hi")
        hist = told.groupBy("node", "target", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("w"))
        run = hist.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
        got = {r.node: r.m for r in run.where("upto >= target").groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("m")).collect()}
        for n, x in list(live.items()):
            m = got.get(n)
            if m is None:  # rounding: all of it goes left
                x["cut"], x["rest"] = x["hi"], 0
                del live[n]
                continue
            before, a = m.upto - m.w, x["lo"] + m.bin * x["step"]
            b = min(x["hi"], a + x["step"])
            if m.w <= limit or x["step"] == 1:
                after = abs(m.upto - x["target"]) < abs(before - x["target"])
                x["rest"] = x["target"] - before if m.w > heavy else 0
                x["cut"] = a if x["rest"] else (b if after else a)
                del live[n]
            else:
                x["lo"], x["hi"], x["target"] = a, b, x["target"] - before


def _along(dim: str = "dim"):
    """The row's key along the dimension with this number."""
    return F.element_at(F.array(*DIMS), F.col(dim) + 1)


def kd_shards(docs: DataFrame, shards: int = 24, bins: int = 8192, tolerance: float = 0.002, whole: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard for every document of ``docs(doc_id, text, [source, lang])``.

    Cuts are within ``tolerance`` of a shard; a group of equal texts of up to ``whole`` of a shard is never cut.
    """
    rows = save(metadata(docs).withColumn("node", F.lit(0)), "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit, most, span = tolerance * total / shards, whole * total / shards, {}
    count = {0: shards if total else 1}  # node (its first shard): shards
    tied = F.coalesce("doc_id", F.lit(LOWEST))
    while any(n > 1 for n in count.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))])
        nodes = {}
        for r in stats.collect():
            if not span:
                span = {d: max(1, r[f"hi_{d}"] - r[f"lo_{d}"]) for d in DIMS}
            if (n := count[r.node]) > 1:
                wide = max(DIMS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / span[d], d))
                nodes[r.node] = {"dim": DIMS.index(wide), "left": n // 2, "lo": r[f"lo_{wide}"], "hi": r[f"hi_{wide}"] + 1, "target": r.w * (n // 2) / n, "tie": LOWEST}
        along = _told(rows, nodes, "dim int").withColumn("key", _along()).select("node", "size", "key", "doc_id")
        _search(along, nodes, bins, limit, most)
        heavy = {n: x for n, x in nodes.items() if x["rest"]}
        if heavy:  # one group of equal texts holds the cut: it goes on by doc_id
            tie = _told(along, heavy, "cut long").where("key = cut").select("node", "size", tied.alias("key"))
            ends = {r.node: r for r in tie.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
            inner = {n: {"lo": ends[n].lo, "hi": ends[n].hi + 1, "target": x["rest"]} for n, x in heavy.items()}
            _search(tie, inner, bins, limit, most)
            for n, x in inner.items():
                heavy[n]["tie"] = x["cut"]
        for x in count:
            nodes.setdefault(x, {"dim": 0, "cut": 0, "tie": LOWEST, "left": 0})  # one shard, or no rows: nothing to cut
        left = (_along() < F.col("cut")) | ((_along() == F.col("cut")) & (tied < F.col("tie"))) | (F.col("left") == 0)
        told = _told(rows, nodes, "dim int, cut long, tie long, left int")
        before, rows = rows, save(told.withColumn("node", F.when(left, F.col("node")).otherwise(F.col("node") + F.col("left"))).select(*rows.columns), "tree")
        drop(before)
        parts = [(n, nodes[n]["left"], c) for n, c in count.items()]
        count = {k: v for n, k_left, c in parts for k, v in (((n, k_left), (n + k_left, c - k_left)) if k_left else ((n, 1),))}
    return rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))


def with_slots(rows: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, by hash bucket and then doc_id; no task sorts a whole shard."""
    n = rows.count()
    buckets = max(1, n // bucket_rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("long"))
    sums = rows.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = sums.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(before, ["shard", "bucket"]).withColumn("slot", (F.col("before") + rank - 1).cast("long")).drop("bucket", "before")


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    with cleared(docs.sparkSession):
        out = with_slots(save(kd_shards(docs, shards), "sharded"))
        return save(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "slots", keep=True)
