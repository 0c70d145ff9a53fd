"""Benchmark decontamination with a positional inverted index that is partitioned by documents.

The index is a table of blocks, written once to the shared folder: a block holds the
postings of every word of some documents: the distinct terms (64-bit fingerprints of the words' bytes), how often each
occurs, and the positions, term by term, in ascending order, with the documents' spans. Positions count through the block,
with a gap after each document, so that a phrase never crosses documents.

A phrase is found by intersecting offset-adjusted posting lists: from the rarest
of its terms in the block to the most frequent, each list is shifted by the term's offset
in the phrase and intersected with what is left. All phrases of a batch run
through each step together. Proximity matches ask for all words of a phrase near its rarest one.

The benchmark's vocabulary and phrases go to the tasks in parts of at most
``part_words`` words (or one item), so their size is bounded whatever the benchmark's is; more
parts mean more passes over the stored blocks, and their results are merged by row.

Null texts have no words and are never hit; null or empty items are no phrase;
repeated items each count; an empty benchmark hits nothing; documents with missing or repeated ids have each their own result; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BIN, INT, LONG, STR, cleared, save, schema
from .words import ALNUM, Words, give_back, reuse_memory, text_bytes, text_slices

WINDOW = 10
GAP = 1 << 10


def item_words(rb: pa.RecordBatch) -> Words:
    buf, off = text_bytes(rb.column("text"))
    return Words(buf, off, ALNUM, lower=True)


def benchmark_parts(items: DataFrame, part_words: int = 1_000_000):
    """The items' word fingerprints in parts: lists of (item_id, array), read one partition at a time."""

    def hashed(batches):
        for rb in text_slices(batches):
            w = item_words(rb)
            h = w.hashes()
            got = [h[w.first[k] : w.first[k + 1]].tobytes() for k in range(rb.num_rows)]
            yield pa.RecordBatch.from_arrays([rb.column("item_id"), pa.array(got, pa.binary())], ["item_id", "h"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(hashed, schema(item_id=LONG, h=BIN))
    part, held = [], 0
    for r in rows.toLocalIterator():
        h = np.frombuffer(r.h, np.uint64)
        if len(h):
            part.append((r.item_id, h))
            held += len(h)
            if held >= part_words:
                yield part
                part, held = [], 0
    if part:
        yield part


class Phrases:
    """Distinct windows of items by length: rows of places in the sorted vocabulary, and each row's items (flat, and where they begin)."""

    def __init__(self, part: list, window: int = WINDOW):
        flat = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in part)])
        self.vocabulary = np.unique(flat)
        self.item_ids = [i for i, _ in part]
        term = np.searchsorted(self.vocabulary, flat).astype(np.int32)
        size = np.array([len(h) for _, h in part], np.int64)
        begin, length = np.cumsum(size) - size, np.minimum(size, window)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            count = size[mine] - n + 1
            item = np.repeat(mine, count)
            first = np.repeat(begin[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows = term[first[:, None] + np.arange(n)]
            _, at, which = np.unique(np.ascontiguousarray(rows).view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(part) + item)
            self.by_length[n] = rows[at], (pairs % len(part)).astype(np.int32), np.searchsorted(pairs // len(part), np.arange(len(at) + 1))


def build_index(docs: DataFrame) -> DataFrame:
    """Store the blocks: block (its number), doc_ids, spans of the documents' words, and the postings: terms, counts, places."""

    def run(batches):
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for rb in text_slices(batches):
            w = item_words(rb)
            h = w.hashes()
            order = np.argsort(h, kind="stable")  # places of a term stay in order
            terms, counts = np.unique(h[order], return_counts=True)
            doc = np.repeat(np.arange(rb.num_rows, dtype=np.int64), np.diff(w.first))
            place = (order + doc[order] * GAP).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([rb.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (w.first.astype(np.int64), terms, counts.astype(np.int32), place)),
                ],
                ["block", "doc_ids", "spans", "terms", "counts", "places"],
            )
            block += 1

    kinds = T.StructType([T.StructField("block", LONG), T.StructField("doc_ids", T.ArrayType(LONG)), *schema(spans=BIN, terms=BIN, counts=BIN, places=BIN).fields])
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds), "postings")


class Block:
    """One block's postings; a term here is its place among the block's terms."""

    def __init__(self, doc_ids: list, spans: bytes, terms: bytes, counts: bytes, places: bytes):
        self.doc_ids, self.spans, self.terms = doc_ids, np.frombuffer(spans, np.int64), np.frombuffer(terms, np.uint64)
        counts = np.frombuffer(counts, np.int32)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.keys = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) | np.frombuffer(places, np.int32)
        self.begins = self.spans[:-1] + np.arange(len(doc_ids)) * GAP

    def own(self, vocabulary: np.ndarray) -> np.ndarray:
        """The block's terms of the fingerprints; -1: not in the block."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def span(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi = self.ends[terms]
        return np.where(terms > 0, self.ends[terms - 1], 0), hi

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        key = (terms << 32) | places
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key) & (places >= 0) if len(self.keys) else np.zeros(len(key), bool)

    def phrases(self, terms: np.ndarray, limit: int = 1 << 18):
        """Occurrences of each row of ``terms`` as (row, place of its first word), in bounded batches."""
        lo, hi = self.span(terms)
        length = hi - lo
        order = np.argsort(length, axis=1, kind="stable")
        rarest = order[:, 0]
        sizes = length[np.arange(len(terms)), rarest]
        total = np.cumsum(sizes)
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
            rows = np.arange(at, min(to, len(terms)))
            at = to
            n = sizes[rows]
            who = np.repeat(rows, n)
            first = lo[rows, rarest[rows]]
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            place = (self.keys[index] & 0xFFFFFFFF) - rarest[who]
            for k in range(1, terms.shape[1]):  # the next rarest list, shifted
                off = order[who, k]
                keep = self.has(terms[who, off], place + off)
                who, place = who[keep], place[keep]
            yield who, place

    def near(self, terms: np.ndarray, slop: int):
        """(row, place of the rarest term): all terms of the row within ``slop`` words of it, in any order."""
        lo, hi = self.span(terms)
        length = hi - lo
        for row in range(len(terms)):
            order = np.argsort(length[row], kind="stable")
            place = self.keys[lo[row, order[0]] : hi[row, order[0]]] & 0xFFFFFFFF
            for k in order[1:]:
                other = self.keys[lo[row, k] : hi[row, k]] & 0xFFFFFFFF
                a, b = np.searchsorted(other, place - slop), np.searchsorted(other, place + slop, "right")
                place = place[b > a]
            if len(place):
                yield np.full(len(place), row), place

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


MATCHES = T.StructType([*schema(block=LONG, row=INT, doc_id=LONG, n_words=LONG, spans=BIN).fields, T.StructField("items", T.ArrayType(LONG))])
DIGESTS = schema(doc_id=LONG, n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=STR)


def matches(index: DataFrame, phrases: Phrases, slop: int | None = None, digest: bool = False) -> DataFrame:
    """Per document: words, merged hit spans (within the document) and item ids; block and row say which row it is.

    Exact phrases, or with ``slop`` (less than GAP) the places where all words of a phrase are that close to its rarest word.
    With ``digest``, the columns of the query from these, in the same Python worker.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        reuse_memory()
        todo = shared.value
        for rb in batches:
            for row in range(rb.num_rows):
                block = Block(*(rb.column(c)[row].as_py() for c in ("doc_ids", "spans", "terms", "counts", "places")))
                n_words = np.diff(block.spans)
                hits: dict[int, list] = {}
                items: dict[int, set] = {}
                own = block.own(todo.vocabulary)
                for n, (rows, owners, starts) in todo.by_length.items():
                    terms = own[rows]
                    some = np.flatnonzero((terms >= 0).all(axis=1))
                    for who, place in block.phrases(terms[some]) if slop is None else block.near(terms[some], slop):
                        doc = block.doc_of(place)
                        for d, p, w in zip(doc.tolist(), (place - block.begins[doc]).tolist(), some[who].tolist(), strict=True):
                            hits.setdefault(d, []).append((p, p + (n if slop is None else 1)))
                            items.setdefault(d, set()).update(owners[starts[w] : starts[w + 1]].tolist())
                spans = [np.array([y for x in _merged(hits.get(d, [])) for y in x], np.int64).tobytes() for d in range(len(block.doc_ids))]
                names = [[todo.item_ids[k] for k in sorted(items.get(d, ()))] for d in range(len(block.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rb.column("block")[row].as_py()] * len(n_words), pa.int64()), pa.array(np.arange(len(n_words), dtype=np.int32)), pa.array(block.doc_ids, pa.int64()), pa.array(n_words), pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.int64()))],
                    MATCHES.names,
                )
        give_back()

    if digest:
        return index.mapInArrow(lambda batches: digests(run(batches)), DIGESTS)
    return index.mapInArrow(run, MATCHES)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def merge_spans(blobs: list[bytes]) -> list[list[int]]:
    return _merged([tuple(x) for b in blobs for x in np.frombuffer(b, np.int64).reshape(-1, 2).tolist()])


def digests(batches):
    """Columns of the query from batches of ``matches`` rows (one per document)."""
    for rb in batches:
        hit = [sum(b - a for a, b in merge_spans([x])) for x in rb.column("spans").to_pylist()]
        items = [sorted({str(i) for i in x}) for x in rb.column("items").to_pylist()]
        counts = [len(x) for x in rb.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [rb.column("doc_id"), rb.column("n_words"), pa.array(hit, pa.int64()), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])],
            DIGESTS.names,
        )


def found(docs: DataFrame, items: DataFrame, part_words: int = 1_000_000, slop: int | None = None) -> DataFrame:
    """``digests`` for a whole benchmark: the index is stored once, and read once for each part of the benchmark.

    A task has one Python worker, which matches (or merges) and digests: a second one would double what workers hold.
    """
    index, parts = build_index(docs), benchmark_parts(items, part_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return matches(index, Phrases(first), slop, digest=True).withColumn("contaminated", F.col("n_hit") > 0)
    got = [matches(index, Phrases(part), slop) for part in chain([first, second], parts)]
    every = got[0]
    for x in got[1:]:  # of the other parts, what they add
        every = every.unionAll(x.where("octet_length(spans) > 0"))
    one = every.groupBy("block", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("lists"), F.flatten(F.collect_list("items")).alias("items"))

    def join(batches):
        for rb in batches:
            spans = [np.array([y for x in merge_spans(v) for y in x], np.int64).tobytes() for v in rb.column("lists").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("block", "row", "doc_id", "n_words")), pa.array(spans, pa.binary()), rb.column("items")], MATCHES.names)

    return one.mapInArrow(lambda batches: digests(join(batches)), DIGESTS).withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs: DataFrame, items: DataFrame, part_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document; each row has its own result."""
    with cleared(docs.sparkSession):
        return save(found(docs, items, part_words), "hits", keep=True)


def proximity(docs: DataFrame, items: DataFrame, slop: int, part_words: int = 1_000_000) -> DataFrame:
    """The same for words that are near each other: n_hit counts the places where all words of a window are within ``slop`` words of its rarest one (in its block)."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    with cleared(docs.sparkSession):
        return save(found(docs, items, part_words, slop), "near", keep=True)
