"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

Sketch: in round i < t every shingle goes to one hashed bin with value (i, hash);
in round t + i every shingle goes to bin i. Each bin keeps its minimum, so after
2t rounds every coordinate is filled, and rounds stop having an effect once all
are. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, with concentration as for independent coordinates.

Bands of ``rows`` coordinates make buckets. Sets that are equal are one class
first, so exact copies cost one row each. Within buckets, pairs are taken with
one centre first, each verified on the full shingle sets; what that leaves
unconnected is gathered, by sketches and sizes, into sets of alike ones, and
these are compared in blocks of bounded size on the full shingle sets. Nothing is capped: members of a bucket that are already in
one component need no comparison, all others get one.

Null texts and texts without words have an empty set, are linked with nothing
and stay. Where ids are missing or repeated, rows are judged by their own texts: a row's component_id is
the smallest id in its group (null, if none has one), rows with that id stay, and of a group without ids one row does.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BIN, LONG, cleared, components, distinct_ids, save, schema
from .words import NOT_SPACE, Words, grams, mix, text_bytes, text_slices

COORDS = 128
ROWS = 4
BANDS = COORDS // ROWS
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketch(x: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit fingerprints (not empty): COORDS values."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, i = len(x), 0
    step = max(1, min(COORDS, int(2 * COORDS * 5 / n)))
    while i < COORDS:
        k = min(step, COORDS - i)
        h = mix(x[None, :] ^ _SEEDS[i : i + k, None])
        value = ((np.arange(i, i + k, dtype=np.uint64) << np.uint64(48))[:, None] | (h & np.uint64(0xFFFFFFFFFFFF))).ravel()
        np.minimum.at(out, (h >> np.uint64(57)).ravel(), value)
        i += k
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):  # round COORDS + b: all into bin b
        h = mix(x ^ _SEEDS[COORDS + b])
        out[b] = (np.uint64(COORDS + b) << np.uint64(48)) | (h & np.uint64(0xFFFFFFFFFFFF)).min()
    return out


def shingle_sets(rb: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles of ``size`` words (all words, if fewer)."""
    buf, off = text_bytes(rb.column("text"))
    w = Words(buf, off, NOT_SPACE, lower=True)
    h = w.hashes()
    g = grams(h, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null: empty), bands, small (8 bits a coordinate)."""

    def run(batches):
        tags = np.arange(BANDS, dtype=np.uint64)[:, None]
        for rb in text_slices(batches):
            n, digests, bands, small = [], [], [], []
            for s in shingle_sets(rb, size):
                n.append(len(s))
                if not len(s):
                    digests.append(None)
                    bands.append(None)
                    small.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                k = sketch(s)
                rows = np.concatenate([tags, k.reshape(BANDS, ROWS)], axis=1)
                h = np.zeros(BANDS, np.uint64)
                for c in range(ROWS + 1):
                    h = mix(h * np.uint64(3) + rows[:, c])
                bands.append(h.view(np.int64))
                small.append((mix(k) & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "small"],
            )

    kinds = T.StructType([*schema(doc_id=LONG, n_shingles=LONG, digest=BIN).fields, T.StructField("bands", T.ArrayType(LONG)), T.StructField("small", BIN)])
    return docs.mapInArrow(run, kinds)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int, salt_rows: int = 512) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * intersection >= threshold * union, on full sets.

    The set of b is sent once for each ``salt_rows`` pairs or so and kept while the
    sets of its partners stream by: memory is two sets, however many pairs b has.
    """
    many = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    left = pairs.join(many, "b").join(sets.select(F.col("rep").alias("a"), "set"), "a").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "a", "set")
    centre = many.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("a")).join(sets.select(F.col("rep").alias("a"), "set"), "a").select("b", "salt", "kind", "a", "set")

    def run(batches):
        own, of = np.zeros(0, np.uint64), None
        for rb in batches:
            good_a, good_b = [], []
            for b, salt, kind, a, raw in zip(*(rb.column(c).to_pylist() for c in ("b", "salt", "kind", "a", "set")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    own, of = s, (b, salt)
                    continue
                assert of == (b, salt)
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                both = int((own[at] == s).sum()) if len(own) else 0
                if both and 100 * both >= threshold * (len(own) + len(s) - both):
                    good_a.append(a)
                    good_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], ["a", "b"])

    rows = left.unionAll(centre).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return rows.mapInArrow(run, schema(a=LONG, b=LONG))


def _groups(batches, names: list[str]):
    """Runs of rows with equal (key, i, j), from batches sorted by these: (key, i, j, columns)."""
    held = None
    for rb in batches:
        t = pa.Table.from_batches([rb] if held is None else [held, rb])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        cols = [np.array(t.column(c)) for c in ("key", "i", "j")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        begin = np.flatnonzero(new)
        for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield cols[1][x], cols[2][x], t.slice(x, y - x)
        held = t.slice(int(begin[-1])).combine_chunks().to_batches()[0]
    if held is not None and held.num_rows:
        yield held.column("i")[0].as_py(), held.column("j")[0].as_py(), pa.Table.from_batches([held])


def block_links(members: DataFrame, block: int, least: float, threshold: int, exact: bool) -> DataFrame:
    """Links between members (key, rep, comp, small, n_set, [set]) of one key, of different comp: a spanning forest in each block.

    A pair counts if its sizes allow the threshold and its sketches agree in ``least``
    of the coordinates and, with ``exact``, if its full sets meet the threshold (else the
    components are linked, not the members). A
    key's members are dealt to parts of about ``block``; a task compares two parts, so no
    task holds a whole hot key, and at most one row a member leaves it.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rest = ["rep", "comp", "small", "n_set", *(["set"] if exact else [])]
    own = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = own.select("key", "part", *rest, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *rest)

    def run(batches):
        for i, j, t in _groups(batches, rest):
            part, rep, comp, size = (np.array(t.column(c)) for c in ("part", "rep", "comp", "n_set"))
            if len(rep) < 2 or (comp == comp[0]).all():
                continue
            s = np.frombuffer(b"".join(t.column("small").to_pylist()), np.uint8).reshape(-1, COORDS)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] if exact else None
            name = rep if exact else comp.copy()
            comp, out = comp.copy(), []
            for k in np.flatnonzero(part == i).tolist():
                other = (comp != comp[k]) & (100 * np.minimum(size, size[k]) >= threshold * np.maximum(size, size[k]))
                other &= part == j if i != j else np.arange(len(rep)) > k
                ok = np.flatnonzero(other)
                same = (s[ok] == s[k]).sum(axis=1)
                ok = ok[same >= least * COORDS]
                for x in ok[np.argsort(-same[same >= least * COORDS], kind="stable")].tolist():
                    if comp[x] == comp[k]:
                        continue
                    if exact:
                        at = np.searchsorted(sets[k], sets[x])
                        at[at == len(sets[k])] = 0
                        both = int((sets[k][at] == sets[x]).sum())
                        if 100 * both < threshold * (len(sets[k]) + len(sets[x]) - both):
                            continue
                    out.append((max(name[k], name[x]), min(name[k], name[x])))
                    comp[comp == comp[x]] = comp[k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema(a=LONG, b=LONG)).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of ``docs(doc_id, text)``.

    Documents are linked where 100 * intersection >= threshold * union of their
    sets of ``size``-word shingles. Bands are made for thresholds of 80 or more:
    a linked pair shares no bucket with probability below 5e-8 at 0.8. A pair
    that the sketches put below threshold - 0.18 is not verified in the block
    rounds (five standard deviations).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with cleared(docs.sparkSession):
        found = _linked(docs, size, threshold, block) if distinct_ids(docs) else _linked_rows(docs, size, threshold, block)
        return save(found, "near", keep=True)


def _linked_rows(docs: DataFrame, size: int, threshold: int, block: int) -> DataFrame:
    """The same where ids are missing or repeated: by the rows' numbers."""
    rows = save(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _linked(rows.select(F.col("row").alias("doc_id"), "text"), size, threshold, block).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("head"))
    found = save(found.join(rows.select("row", "doc_id"), "row"), "found")
    low = found.groupBy("head").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("head")))
    return found.join(low, "head").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _linked(docs: DataFrame, size: int, threshold: int, block: int) -> DataFrame:
    """The same for documents with an id each."""
    all_docs = save(sketches(docs, size), "sketch")
    classes = all_docs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = all_docs.where("digest is not null").select("digest", "doc_id", "n_shingles").join(classes, "digest").select("doc_id", "n_shingles", "rep")
    member = save(member, "member")
    reps = all_docs.join(member.where("doc_id = rep").select("doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "bands", "small", "n_shingles")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = save(keys.join(many, "key"), "buckets")  # only buckets of two or more
    degree = keys.groupBy("rep").agg(F.sum("n").alias("degree"))
    small = reps.select("rep", "small", F.col("n_shingles").alias("n_set")).join(degree, "rep")
    small = save(small, "candidates")
    wanted = docs.join(small.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id")  # they grow with the documents: no broadcast

    def full(batches):
        for rb in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(rb, size)], pa.binary())], ["rep", "set"])

    sets = save(wanted.select("doc_id", "text").mapInArrow(full, schema(rep=LONG, set=BIN)), "sets")
    comp = None  # (node, component_id) so far
    links = None
    least = threshold / 100 - 0.18
    best = keys.join(small.select("rep", "degree"), "rep").groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("m"))
    star = keys.join(best, "key").where("rep <> m.rep").select(F.col("rep").alias("a"), F.col("m.rep").alias("b")).distinct()
    links = save(verify(save(star, "star"), sets, threshold), "links")
    comp = save(components(links), "components")
    now = keys.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component_id", "rep").alias("comp"))
    open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = now.join(open_keys, "key").join(small.select("rep", "small", "n_set"), "rep")
    alike = save(block_links(members, block, least, threshold, exact=False), "alike")
    if not alike.isEmpty():  # each group of alike components is compared once, on the full sets
        group = components(alike).select(F.col("node").alias("comp"), F.col("component_id").alias("key"))
        own = small.select("rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component_id", "rep").alias("comp"))
        tied = own.join(group, "comp").select("key", "rep", "comp")
        tied = tied.join(small.select("rep", "small", "n_set"), "rep").join(sets, "rep")
        more = save(block_links(tied, block // 4, least, threshold, exact=True), "links")
        if not more.isEmpty():
            comp = save(components(links.unionAll(more)), "components")
    linked = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    alone = all_docs.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
