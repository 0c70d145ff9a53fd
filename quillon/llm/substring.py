"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one document, its minimiser the smallest
fingerprint among its m-word grams (the leftmost, if equal). Consecutive windows
with one minimiser are a super-k-mer, a string of words that goes to the
minimiser's bucket, where its windows are sorted and each but the earliest is
marked. Equal windows have equal minimisers, so they always meet.

What travels first is small: for each super-k-mer its minimiser, a digest of its
string and its place. Sorted by these, a bucket with one place holds no repeated
window, and of places with equal strings all but the earliest are repeated as a
whole. Only where a bucket has different strings do their earliest places send the
packed strings themselves; windows whose fingerprints agree are then compared by
their bytes.

A minimiser that very many super-k-mers share (a frequent line in ever different
surroundings) would be one huge bucket. Such minimisers are found on a sample (one
document in ``SAMPLE``; at most ``HOT_SHARE`` of them can exist, which bounds the
broadcast, and the sample decides nothing but the route): their windows go one by one, each to the bucket
of its own 128-bit digest. Equal rows of a task are combined before the shuffle, so
a passage that a third of all documents hold is a few rows a task.

Null texts have no words; a document of fewer than
k words has no window and stays whole; a null doc_id is before all others and rows that
repeat a doc_id with one text are one document said twice, never removed against each other;
rows of one doc_id with different texts are documents of their own, in the order of the texts' hashes.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import BIN, INT, LONG, STR, cleared, save, schema
from .words import NOT_SPACE, Words, grams, mix, text_bytes, text_slices

SAMPLE, HOT_SHARE, HOT_LEAST, HOLD = 16, 1024, 64, 200_000


def _minimisers(w: Words, rows: int, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser, row, first word in the slice, windows) of the slice's super-k-mers."""
    none = (np.zeros(0, np.int64),) * 4
    g = grams(w.hashes(), m)
    n = len(w) - k + 1
    if n <= 0:
        return none
    doc = np.repeat(np.arange(rows), np.diff(w.first))
    least = g[: len(g) - (k - m)].copy()  # sliding minimum, leftmost
    at = np.arange(len(least))
    for i in range(1, k - m + 1):
        other = g[i : i + len(least)]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    s = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if not len(s):
        return none
    p = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    b = np.flatnonzero(new)
    return g[p[b]].view(np.int64), doc[s[b]], s[b], np.diff(np.append(b, len(s)))


def _line(rb: pa.RecordBatch, w: Words) -> tuple[bytes, np.ndarray]:
    """The slice's words with one space after each, and where each word begins (one more at the end)."""
    parts = [x.as_buffer().to_pybytes().split() for x in rb.column("text") if x.is_valid]
    line = b" ".join([y for x in parts for y in x])
    return line, np.concatenate([np.zeros(1, np.int64), np.cumsum(w.end - w.start + 1)])


def _combined(key1, key2, did, start, size) -> tuple[np.ndarray, ...]:
    """The rows with those that an earlier one equals marked by a negative size and dealt anew; a place said twice stays once."""
    order = np.lexsort((start, did, key2, key1))
    key1, key2, did, start, size = (x[order] for x in (key1, key2, did, start, size))
    new = np.ones(len(key1), bool)
    new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key1)), 0))
    later = (did != did[first]) | (start != start[first])
    keep = new | later
    key1 = np.where(later, mix((did + start).view(np.uint64)).view(np.int64), key1)  # they need no bucket
    return tuple(x[keep] for x in (key1, key2, did, start, np.where(later, -size, size)))


PLACE = dict(key1=LONG, key2=LONG, did=LONG, start=INT, size=INT)


def _place_batch(key1, key2, did, start, size) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t, copy=False)) for x, t in zip((key1, key2, did, start, size), kinds, strict=True)], list(PLACE))


def frequent_minimisers(docs: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimisers with over 1 / HOT_SHARE of the super-k-mers of one document in SAMPLE: fewer than HOT_SHARE of them."""

    def run(batches):
        for rb in text_slices(batches):
            w = Words(*text_bytes(rb.column("text")), NOT_SPACE)
            mh, n = np.unique(_minimisers(w, rb.num_rows, k, m)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mh), pa.array(n)], ["mh", "n"])

    some = docs.where(F.pmod(F.xxhash64("did", F.lit(5)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, schema(mh=LONG, n=LONG))
    counts = save(some.groupBy("mh").agg(F.sum("n").alias("n")).where("n > 1"), "sampled")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.mh for r in counts.where(F.col("n") > max(HOT_LEAST, total / HOT_SHARE)).select("mh").collect()], np.int64))


def places(docs: DataFrame, k: int, m: int, hot: np.ndarray) -> DataFrame:
    """key1, key2, did, start, size of the super-k-mers (minimiser, digest of the string) and of frequent minimisers' windows (halves of a digest); a negative size: repeated."""

    def run(batches):
        held = []
        for rb in text_slices(batches):
            w = Words(*text_bytes(rb.column("text")), NOT_SPACE)
            mh, row, s, size = _minimisers(w, rb.num_rows, k, m)
            if not len(mh):
                continue
            line, at = _line(rb, w)
            did = np.array(rb.column("did"))
            own = s - w.first[row]
            many = np.isin(mh, hot)
            one = np.flatnonzero(~many)
            digest = xxhash.xxh3_64_intdigest
            pk = [digest(line[a:b]) for a, b in zip(at[s[one]].tolist(), (at[s[one] + size[one] + k - 1] - 1).tolist(), strict=True)]
            held.append((mh[one], np.array(pk, np.uint64).view(np.int64), did[row[one]], own[one], size[one]))
            if many.any():
                z = np.flatnonzero(many)
                n = size[z]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(s[z], n) + step
                raw = b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(at[first].tolist(), (at[first + k] - 1).tolist(), strict=True)])
                keys = np.frombuffer(raw, np.int64).reshape(-1, 2)
                held.append((keys[:, 0], keys[:, 1], np.repeat(did[row[z]], n), np.repeat(own[z], n) + step, np.ones(len(first), np.int64)))
            if sum(len(x[0]) for x in held) >= HOLD:
                yield _place_batch(*_combined(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held = []
        if held:
            yield _place_batch(*_combined(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.mapInArrow(run, schema(**PLACE))


def judged(rows: DataFrame) -> DataFrame:
    """mh, did, start, size: repeated strings (mh null), and the earliest places of strings that share a minimiser with other strings."""

    def run(batches):
        held, sent, mixed = None, False, False  # the last string's first place; whether it went out; whether its bucket has more strings
        for rb in batches:
            if not rb.num_rows:
                continue
            key1, key2, did, start, size = (np.array(c) for c in rb.columns)
            known = size < 0
            out = [(np.zeros(int(known.sum()), np.int64), np.zeros(int(known.sum()), bool), did[known], start[known], -size[known])]
            cols = tuple(x[~known] for x in (key1, key2, did, start, size))
            carried = held is not None
            if carried:
                cols = tuple(np.concatenate([h, x]) for h, x in zip(held, cols, strict=True))
            key1, key2, did, start, size = cols
            if len(key1):
                new1 = np.ones(len(key1), bool)
                new1[1:] = key1[1:] != key1[:-1]
                new2 = new1.copy()
                new2[1:] |= key2[1:] != key2[:-1]
                first = np.maximum.accumulate(np.where(new2, np.arange(len(key1)), 0))
                later = (did != did[first]) | (start != start[first])
                out.append((np.zeros(int(later.sum()), np.int64), np.zeros(int(later.sum()), bool), did[later], start[later], size[later]))
                group = np.cumsum(new1) - 1
                many = np.bincount(group, new2) > 1
                many[0] |= carried and mixed
                go = new2 & many[group]
                last = int(first[-1])
                last_sent = bool(go[last]) or (last == 0 and carried and sent)
                if carried and sent:
                    go[0] = False
                out.append((key1[go], np.ones(int(go.sum()), bool), did[go], start[go], size[go]))
                held, sent, mixed = tuple(x[last : last + 1] for x in cols), last_sent, bool(many[-1])
            mh, some, did, start, size = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(mh, mask=~some), pa.array(did), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["mh", "did", "start", "size"])

    return rows.repartition("key1").sortWithinPartitions("key1", "key2", "did", "start").mapInArrow(run, schema(mh=LONG, did=LONG, start=INT, size=INT))


def pack(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The places with their words, joined by single spaces."""
    lists = found.groupBy("did").agg(F.collect_list("mh").alias("mhs"), F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))

    def run(batches):
        for rb in text_slices(batches):
            out_mh, out_did, out_start, out_text = [], [], [], []
            mhs, starts, sizes = rb.column("mhs"), rb.column("starts"), rb.column("sizes")
            for i in range(rb.num_rows):
                words = rb.column("text")[i].as_buffer().to_pybytes().split()
                line = b" ".join(words)
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                start, size = np.array(starts[i].values), np.array(sizes[i].values)
                out_text += [line[a:b] for a, b in zip(at[start].tolist(), (at[start + size + k - 1] - 1).tolist(), strict=True)]
                out_mh.append(np.array(mhs[i].values))
                out_start.append(start)
                out_did.append(np.full(len(start), rb.column("did")[i].as_py()))
            if out_mh:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (out_mh, out_did, out_start)), pa.array(out_text, pa.binary())], ["mh", "did", "start", "packed"])

    return docs.join(lists, "did").select("did", "text", "mhs", "starts", "sizes").mapInArrow(run, schema(mh=LONG, did=LONG, start=INT, packed=BIN))


def _spans(did: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of overlapping windows (did, first word) as spans of words."""
    order = np.lexsort((start, did))
    did, start = did[order], start[order]
    new = np.ones(len(did), bool)
    new[1:] = (did[1:] != did[:-1]) | (start[1:] > start[:-1] + k)
    b = np.flatnonzero(new)
    return did[b], start[b], np.append(start[b[1:] - 1], start[-1:]) + k if len(b) else start[b]


def _later(texts: list[bytes], did: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (did, first word) of packed strings that an earlier one of these equals, word for word."""
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    buf = b"".join(texts)
    w = Words(np.frombuffer(buf, np.uint8), off, NOT_SPACE)
    g = grams(w.hashes(), k)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    n = len(w) - k + 1
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    own = owner[at]
    d, s = did[own], start[own] + (at - w.first[own])
    order = np.lexsort((s, d, g[at]))
    at, d, s = at[order], d[order], s[order]
    key = g[at]
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
    a, b = w.start[at], w.end[at + k - 1]
    later = np.zeros(len(at), bool)
    alike = np.flatnonzero(first != np.arange(len(at)))
    same = [buf[p:q] == buf[x:y] for p, q, x, y in zip(a[alike].tolist(), b[alike].tolist(), a[first[alike]].tolist(), b[first[alike]].tolist(), strict=True)]
    later[alike] = same
    for f in np.unique(first[alike[~np.array(same, bool)]]).tolist():  # one fingerprint, different words: told apart by the words
        seen: dict[bytes, int] = {}
        for j in np.flatnonzero(first == f).tolist():
            earliest = seen.setdefault(buf[a[j] : b[j]], j)
            later[j], first[j] = earliest != j, earliest
    # one document's very place, said twice, is no repetition of itself
    later &= (d != d[first]) | (s != s[first])
    return d[later], s[later]


def marked(packed: DataFrame, k: int, hold: int = 4000) -> DataFrame:
    """Spans (did, a, b) of words in windows with an earlier equal one; all of a minimiser's different strings meet here."""

    def run(batches):
        texts, did, start, last = [], [], [], None

        def flush():
            nonlocal texts, did, start
            got = _spans(*_later(texts, np.array(did, np.int64), np.array(start, np.int64), k), k)
            texts, did, start = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["did", "a", "b"])

        for rb in batches:
            for mh, d, s, text in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if mh != last and len(texts) >= hold:
                    yield flush()
                last = mh
                texts.append(text)
                did.append(d)
                start.append(s)
        if texts:
            yield flush()

    return packed.repartition("mh").sortWithinPartitions("mh").mapInArrow(run, schema(did=LONG, a=LONG, b=LONG))


def repeated_spans(docs: DataFrame, k: int = 20, m: int = 8) -> DataFrame:
    """Spans (did, a, b) of word positions covered by windows whose words also start earlier."""
    found = save(judged(places(docs, k, m, frequent_minimisers(docs, k, m))), "judged")
    whole = found.where("mh is null").select("did", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("size") + (k - 1)).cast("long").alias("b"))
    return whole.unionAll(save(marked(pack(docs, found.where("mh is not null"), k), k), "marked"))


def with_key(docs: DataFrame) -> DataFrame:
    """did, text, no_id: null ids have the smallest long, and say so (that long is also an id)."""
    i = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(i, F.expr("-9223372036854775807L - 1L")).alias("did"), F.col("text").cast("string").alias("text"), i.isNull().alias("no_id"))


def told_apart(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(did, text) in which a did names one text, and the (rank, doc_id) behind new ids, if any were needed.

    New ids are ranks by (no id first, did, hash of the text): sorted ranges are numbered from the counts of those before them.
    """
    mark = F.xxhash64("text")
    told = own.groupBy("did").agg((F.min(mark) < F.max(mark)).alias("differ"), F.max("no_id").alias("none"))
    if told.where("differ or none").isEmpty():
        return own.select("did", "text"), None
    own = own.withColumn("mark", mark).withColumn("first", ~F.col("no_id"))
    keys = save(own.select("first", "did", "mark").distinct().repartitionByRange("first", "did", "mark").withColumn("part", F.spark_partition_id()), "keys")
    counts = keys.groupBy("part").agg(F.count("*").alias("n"))
    ahead = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy("first", "did", "mark"))
    ranks = save(keys.join(ahead, "part").select("first", "did", "mark", rank.cast("long").alias("rank")), "ranks")
    return own.join(ranks, ["first", "did", "mark"]).select(F.col("rank").alias("did"), "text"), ranks.select("rank", F.when(F.col("first"), F.col("did")).alias("doc_id"))


def remove_repeated(docs: DataFrame, k: int = 20, m: int = 8, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every document."""
    with cleared(docs.sparkSession):
        return save(_kept(docs, k, m, with_text), "kept", keep=True)


def _kept(docs: DataFrame, k: int, m: int, with_text: bool) -> DataFrame:
    own, ranks = told_apart(with_key(docs))
    lists = repeated_spans(own, k, m).groupBy("did").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def run(batches):
        for rb in text_slices(batches):
            words_n, removed, digest, kept = [], [], [], []
            aa, bb = rb.column("a"), rb.column("b")
            for i in range(rb.num_rows):
                t = rb.column("text")[i]
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                words_n.append(len(words))
                if aa[i].is_valid:
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, np.array(aa[i].values), 1)
                    np.add.at(drop, np.array(bb[i].values), -1)
                    gone = np.cumsum(drop)[:-1] > 0
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                line = b" ".join(words)
                digest.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    kept.append(line)
            cols = [rb.column("did"), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = dict(doc_id=LONG, n_words=LONG, n_removed=LONG, kept_sha256=STR) | ({"kept_text": STR} if with_text else {})
    out = own.join(lists, "did", "left").select("did", "text", "a", "b").mapInArrow(run, schema(**kinds))
    if ranks is None:
        return out
    return out.withColumnRenamed("doc_id", "rank").join(ranks, "rank").select(*kinds)
