"""Mixing sources to target weights by temperature; DataFrame functions only.

A source with token share p gets weight p^alpha / sum(p^alpha). The exponent is
found by a k-ary bisection (each pass over the table of sources tries 16
exponents) as the smallest one in [0, 1] that respects a repetition limit, or as
the one that meets a target entropy. Weights are realised as block permutations:
a source is read in passes, each a permutation of its documents by a hash of the
pass and the id, and the last pass ends where the source's budget of tokens does.

Tokens are words ([^\\x20\\x09-\\x0D]+). A null source is the source ''; null texts
have no tokens and take no budget; a source without tokens is read once.
Repeated rows are documents of their own and ties of the hash go by doc_id and then length. A
document is placed by the tokens before it in its pass, which need no sort of a
whole source: sums of hash buckets first, then ranks inside buckets of about
``bucket_rows`` documents, so a hot source is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import cleared, save

WORD = r"[^\x20\x09-\x0D]+"


def weigh(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(
        *keep, "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def source_tokens(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sources: DataFrame, max_repeat: float | None = 3.0, entropy: float | None = None, cover: bool = False, ways: int = 16, digits: int = 6) -> float:
    """The smallest exponent with ``digits`` decimals that fits.

    ``entropy`` (nats; clipped to what is possible) or else ``max_repeat``: the most
    often that a source may be read when the budget is all tokens (or, with
    ``cover``, just enough to read every source once).
    """
    has = sources.where("tokens > 0")
    total, low, high, n = has.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or low == high and entropy is None:
        return 1.0
    p, pmin, pmax = F.col("tokens") / F.lit(float(total)), low / total, high / total
    lo, hi = 0.0, 1.0  # the smallest multiple of 10^-digits that fits lies between

    def fits(a: float, s: float, slog: float) -> bool:
        if entropy is not None:  # H = ln(sum p^a) - a * sum(p^a ln p) / sum(p^a), falling in a
            return math.log(s) - a * slog / s <= entropy
        return (pmax / pmin) ** (1 - a) <= max_repeat if cover else pmin ** (a - 1) / s <= max_repeat

    def first_fit(tries: list[float]) -> int | None:
        rows = has.select("tokens", F.posexplode(F.array(*[F.lit(a) for a in tries])).alias("i", "a"))
        got = {r.i: r for r in rows.groupBy("i").agg(F.sum(F.pow(p, F.col("a"))).alias("s"), F.sum(F.pow(p, F.col("a")) * F.log(p)).alias("l")).collect()}
        return next((i for i, a in enumerate(tries) if fits(a, got[i].s, got[i].l)), None)

    unit = 10**digits
    while (hi - lo) * unit > ways / 2:
        tries = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
        i = first_fit(tries)
        if i is None:
            return 1.0
        if i == 0:
            return tries[0]
        lo, hi = tries[i - 1], tries[i]
    grid = [k / unit for k in range(max(0, math.floor(lo * unit) - 1), min(unit, math.ceil(hi * unit) + 1) + 1)]
    i = first_fit(grid)
    return 1.0 if i is None else grid[i]


def quotas(sources: DataFrame, alpha: float, cover: bool = False, budget: int | None = None) -> DataFrame:
    """source, tokens, weight, quota, passes (whole ones), rest (tokens of the last pass)."""
    has = sources.where("tokens > 0")
    total, tokens = has.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha))), F.sum("tokens")).first()
    if not total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("rest"))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.lit(total)).otherwise(0.0)
    if cover:
        budget = has.agg(F.max(F.col("tokens") / weight)).first()[0]
    elif budget is None:
        budget = tokens
    q = F.floor(weight * F.lit(float(budget)) + F.lit(1e-6))
    q = F.greatest(q, F.col("tokens")) if cover else q  # rounding never takes a document
    out = sources.select("source", "tokens", weight.alias("weight"), q.cast("long").alias("quota"))
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)
    return out.withColumn("passes", whole.cast("long")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0).cast("long"))


def realise(weighed: DataFrame, quota: DataFrame, docs: int, bucket_rows: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, pass, place (tokens of the source before it), share (place / quota): a row for each time a document is read.

    Ascending ``share`` interleaves the sources at their weights.
    """
    digits = max(1, math.ceil(math.log(max(2, docs / bucket_rows), 16)))
    rows = weighed.join(quota.select("source", "tokens", "quota", "passes", "rest"), "source")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)))).where("pass >= 0 and (pass < passes or rest > 0)")
    order = F.md5(F.concat_ws("|", F.col("pass").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    rows = rows.withColumn("h", order).withColumn("bucket", F.substring("h", 1, digits))
    sums = rows.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy("source", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "pass", "bucket").orderBy("h", "doc_id", "n_tokens", *keep).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(before, ["source", "pass", "bucket"]).withColumn("at", F.col("before") + inside)
    out = out.where("pass < passes or at < rest").withColumn("place", F.expr("pass * tokens + at"))
    share = F.when(F.col("quota") > 0, F.col("place") / F.col("quota")).otherwise(0.0)
    return out.select(*keep, "doc_id", "source", "n_tokens", "pass", "place", share.alias("share"))


def mix_sources(docs: DataFrame, max_repeat: float | None = 3.0, entropy: float | None = None, cover: bool = False, budget: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``realise`` for ``docs(doc_id, source, text, *keep)`` at the weights that ``exponent`` finds."""
    with cleared(docs.sparkSession):
        weighed = save(weigh(docs, keep), "weighed")
        sources = save(source_tokens(weighed), "sources")
        alpha = exponent(sources, max_repeat, entropy, cover)
        most = sources.agg(F.max("docs")).first()[0] or 0
        return save(realise(weighed, quotas(sources, alpha, cover, budget), most, keep=keep), "mixed", keep=True)
