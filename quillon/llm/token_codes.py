"""Token ids in directly addressable codes (DACs), as files with random access to any token.

Each id is cut into 8-bit chunks, least significant first. Level k holds chunk k
of every id that has one, a continuation bitmap says which ids go on to level
k + 1, and a rank directory (set bits before every 512th position) turns a
position of level k into one of level k + 1 without decoding anything else.

Contract of the operator: null texts are empty; every document gets the end id;
null doc_ids sort first and stay null; repeated doc_ids stay separate documents
in a fixed order; an empty table gives no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BIN, INT, LONG, STR, schema, scratch_path
from .words import Words, mix, text_bytes, text_slices

MAGIC = b"QDAC0001"
RANK_STEP = 512


# ---------------------------------------------------------------- the codes
def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks uint8, continuation bits packed, rank directory uint64) of each level."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // RANK_STEP) * RANK_STEP, dtype=bool)
        padded[: len(rest)] = more
        counts = padded.reshape(-1, RANK_STEP).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), np.packbits(padded, bitorder="little"), rank))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(8)


class Codes:
    """A file's contents: documents, and random access to any token."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token code file")
        (n,) = struct.unpack_from("<I", blob, 8)
        self.head = json.loads(blob[12 : 12 + n])
        at = 12 + n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        docs = self.head["docs"]
        self.doc_ids, self.no_id, self.ends = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.levels = []
        for size in self.head["levels"]:
            steps = -(-size // RANK_STEP)
            self.levels.append((take("u1", size), take("u1", steps * RANK_STEP // 8), take("<u8", steps + 1)))

    def __len__(self) -> int:
        return self.head["tokens"]

    def token(self, i: int) -> int:
        """Token i: one byte, one bit and at most one rank per level."""
        out = shift = 0
        for chunks, bits, rank in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            first = i // RANK_STEP
            seen = np.unpackbits(bits[first * RANK_STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - first * RANK_STEP]
            i, shift = int(rank[first]) + int(seen.sum()), shift + 8
        raise ValueError("a code without an end")

    def tokens(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Tokens a to b (not included): at every level just the positions that these need."""
        b = len(self) if b is None else b
        out, where, shift = np.zeros(max(0, b - a), dtype=np.uint32), np.arange(max(0, b - a)), 0
        for chunks, bits, rank in self.levels:
            if not len(where):
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            low = a // RANK_STEP * RANK_STEP
            on = np.unpackbits(bits[low // 8 : -(-b // 8)], bitorder="little")[: b - low].astype(bool)
            first = int(rank[low // RANK_STEP]) + int(on[: a - low].sum())
            on = on[a - low :]
            where, a, b, shift = where[on], first, first + int(on.sum()), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def to_blob(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels = encode_levels(flat)
    head = json.dumps({"docs": len(doc_ids), "tokens": len(flat), "levels": [len(x[0]) for x in levels]}).encode()
    parts = [MAGIC, struct.pack("<I", len(head)), head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), np.cumsum([len(x) for x in ids], dtype="<i8").tobytes()]
    for chunks, bits, rank in levels:
        parts += [chunks.tobytes(), bits.tobytes(), rank.astype("<u8").tobytes()]
    return b"".join(parts)


# ---------------------------------------------------------------- the tokenizer
_MARKS = ".,;:!?*%$&#"
#: what stands before a piece: the start of the text, a line feed, a space
_LEADS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], dtype=np.uint64)


class PieceEncoder:
    """A byte-level BPE of the tokenizers library, with the ids of pieces kept.

    Such a tokenizer never merges across a single space or line feed that stands
    between two other characters, nor between a letter or digit and a mark after
    it, so a text is encoded piece by piece: the library encodes each piece that is new,
    known ones are looked up for a whole slice at once, by 64-bit fingerprints.
    A text that spells out an added token (which the library recognises anywhere) is encoded in one call. The first ``keep`` pieces that a worker meets (frequent ones come early) stay
    known. A text with any other white space between or around words is encoded in one call.
    """

    def __init__(self, path: str, keep: int = 1 << 20, keep_cores: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.keep, self.keep_cores = keep, keep_cores
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.slots = np.zeros(0, np.int32)  # made when a text is encoded
        self.keys = np.zeros(keep, np.uint64)
        self.begin, self.size = np.zeros(keep, np.int64), np.zeros(keep, np.int64)
        self.flat = np.zeros(8 * keep, self.kind)
        self.n = self.used = 0
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        ends = (np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * int(self.kind[-1])).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def pieces(self, words: list[str], leads: list[str]) -> list[bytes | None]:
        """Ids of each lead + word (lead: a space or nothing); None where cuts around the word are not safe."""
        cores = [w.rstrip(_MARKS) for w in words]
        cores = [lead + (c if c[-1:].isalnum() else w) for c, w, lead in zip(cores, words, leads, strict=True)]
        new = list({c for c in cores if c not in self.cores})
        fresh = dict(zip(new, self._ids(new), strict=True))
        tails = [w[len(c) - len(lead) :] for c, w, lead in zip(cores, words, leads, strict=True)]
        more = [t for t in set(tails) if t not in self.tails]
        last = dict(zip(more, self._ids(more), strict=True)) if more else {}
        out = []
        for w, c, t in zip(words, cores, tails, strict=True):
            ids = self.cores.get(c)
            tail = self.tails.get(t)
            out.append((fresh[c] if ids is None else ids) + (last[t] if tail is None else tail) if w.strip() is w else None)
        if len(self.cores) < self.keep_cores:
            self.cores.update(fresh)
        if len(self.tails) < 10_000:
            self.tails.update(last)
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` after it; ids of each text) from the texts' bytes."""
        if not len(self.slots):
            self.slots = np.full(4 * self.keep, -1, np.int32)
        docs = len(off) - 1
        w = Words(buf, off)
        count = np.diff(w.first)
        doc = np.repeat(np.arange(docs), count)
        lead = np.zeros(len(w), np.int64)  # 0 start, 1 line feed, 2 space
        gap = w.start.copy()
        gap[1:] -= w.end[:-1]
        begins = np.zeros(len(w), bool)
        begins[w.first[:-1][count > 0]] = True
        before = buf[np.maximum(w.start - 1, 0)]
        lead[~begins & (before == 0x0A)] = 1
        lead[~begins & (before == 0x20)] = 2
        odd = np.where(begins, w.start != off[doc], (gap != 1) | (lead == 0))
        bad = np.bincount(doc[odd], minlength=docs) > 0
        some = count > 0
        bad[some] |= w.end[w.first[1:][some] - 1] != off[1:][some]
        bad |= ~some & (np.diff(off) > 0)
        raw = buf.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                bad[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        h = mix(w.hashes() ^ _LEADS[lead])
        slot = (h >> np.uint64(20)).astype(np.int64) % len(self.slots)
        entry = self.slots[slot].astype(np.int64)
        hit = (entry >= 0) & (self.keys[np.maximum(entry, 0)] == h)
        miss = np.flatnonzero(~hit)
        sizes, flats = [], np.zeros(0, self.kind)
        if len(miss):
            keys, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            words = [raw[x:y].decode("utf-8", "replace") for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            kinds = lead[at].tolist()
            got = self.pieces(words, [" " if k == 2 else "" for k in kinds])
            unsafe = np.array([x is None for x in got])
            if unsafe.any():
                bad[doc[miss[unsafe[which]]]] = True
            got = [b"" if x is None else self.feed + x if k == 1 else x for x, k in zip(got, kinds, strict=True)]
            width = int(self.kind[-1])
            sizes = [len(x) // width for x in got]
            flats = np.frombuffer(b"".join(got), self.kind)
            entry[miss] = self.n + which
        size_new = np.array(sizes, np.int64)
        begin_new = self.used + np.cumsum(size_new) - size_new
        # batch entries: the known ones, the new ones, the end id, texts encoded whole
        whole = np.flatnonzero(bad)
        extra = self._ids([buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in whole]) if len(whole) else []
        extra = [np.frombuffer(x, self.kind) for x in extra]
        tail = [np.array([end], self.kind), *extra]
        tail_size = np.array([len(x) for x in tail], np.int64)
        size = np.concatenate([self.size[: self.n], size_new, tail_size])
        begin = np.concatenate([self.begin[: self.n], begin_new, self.used + len(flats) + np.cumsum(tail_size) - tail_size])
        flat = np.concatenate([self.flat[: self.used], flats, *tail]) if len(flats) or extra else np.concatenate([self.flat[: self.used], *tail])
        n_new, n_old = len(size_new), self.n
        # the pieces of a text, and its end
        good = ~bad[doc]
        pieces = np.where(bad, 1, count)
        ends = np.cumsum(pieces + 1)
        tokens = np.full(int(ends[-1]) if docs else 0, n_old + n_new, np.int64)
        base = ends - pieces - 1
        within = np.arange(len(w)) - w.first[:-1][doc]
        tokens[(base[doc] + within)[good]] = entry[good]
        tokens[base[whole]] = n_old + n_new + 1 + np.arange(len(whole))
        s = size[tokens]
        total = np.cumsum(s)
        ids = flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin[tokens] - (total - s), s)]
        n_ids = np.diff(np.concatenate([[0], total])[np.concatenate([[0], ends])])
        if n_new and self.n + n_new <= self.keep and self.used + len(flats) <= len(self.flat):
            a, b = self.n, self.n + n_new
            self.keys[a:b], self.begin[a:b], self.size[a:b] = keys, begin_new, size_new
            self.flat[self.used : self.used + len(flats)] = flats
            where = (keys >> np.uint64(20)).astype(np.int64) % len(self.slots)
            free = (self.slots[where] < 0) & ~unsafe
            self.slots[where[free]] = np.arange(a, b)[free]
            self.n, self.used = b, self.used + len(flats)
        return ids, n_ids


_encoders: dict = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, which outlives a task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this process's encoders and the pieces that they keep."""
    _encoders.clear()


# ---------------------------------------------------------------- the operator
def write_codes(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = 8 << 20, file_tokens: int = 4 << 20) -> tuple[str, list]:
    """Encode ``docs(doc_id, text)`` and write the ids as .dac files in ascending doc_id order.

    Ids are encoded where the texts lie; what is shuffled is ids (two bytes each
    for this vocabulary), to ranges of doc_id taken from quantiles. A task keeps one file
    (``file_tokens``) in memory. Returns the folder and (file, tokens) in order,
    one for each ``shard_bytes`` of text or so; of over 100 000 ranges, each gets longer, and has more files.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "codes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(100_000, max(1, total // shard_bytes)))
    cuts = []
    if n > 1:
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(100_000, 10 * n))).first()[0] or []))

    def encode(batches):
        enc = encoder(tokenizer)
        at = np.array(cuts, dtype=np.int64)
        for rb in text_slices(batches, limit=2 << 20):
            keys = rb.column("doc_id")
            ids, n = enc.encode(*text_bytes(rb.column("text")), end_id)
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(n * ids.itemsize, dtype=np.int32)])
            coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            parts = np.searchsorted(at, np.array(keys.fill_null(-(1 << 63))), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(parts), keys, coded], ["part", "doc_id", "ids"])

    coded = docs.mapInArrow(encode, schema(part=INT, doc_id=LONG, ids=BIN))

    def write(batches):
        from pyarrow import fs
        from tokenizers import Tokenizer

        kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
        store, base = fs.FileSystem.from_uri(folder)
        part, keys, ids, held, file = None, [], [], 0, 0

        def flush():
            nonlocal keys, ids, held, file
            name = f"part-{part:06d}-{file:06d}.dac"
            import uuid

            store.create_dir(base, recursive=True)
            with store.open_output_stream(tmp := f"{base}/.{name}.{uuid.uuid4().hex}") as f:  # a second attempt writes the same bytes
                f.write(to_blob(keys, ids))
            store.move(tmp, f"{base}/{name}")
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], ["file", "tokens"])
            keys, ids, held, file = [], [], 0, file + 1
            return out

        for rb in batches:
            for p, key, raw in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if keys and (p != part or held >= file_tokens):
                    yield flush()
                    file = file if p == part else 0
                part = p
                x = np.frombuffer(raw, dtype=kind).astype(np.uint32)
                keys.append(key)
                ids.append(x)
                held += len(x)
        if keys:
            yield flush()

    files = coded.repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(write, schema(file=STR, tokens=LONG)).collect()
    return folder, sorted((r.file, r.tokens) for r in files)


def read_digests(spark, folder: str, files: list) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    out = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)
    if not files:
        return spark.createDataFrame([], out)
    base, starts = 0, {}
    for name, tokens in files:
        starts[name], base = base, base + tokens

    def read(batches):
        for rb in batches:
            for path, blob in zip(rb.column("path").to_pylist(), rb.column("content"), strict=True):
                codes, at = Codes(blob.as_buffer().to_pybytes()), starts[path.rpartition("/")[2]]
                ends = codes.ends.astype(np.int64)
                begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crcs = []
                for lo in range(0, len(ends), 256):  # some documents at a time
                    hi = min(len(ends), lo + 256)
                    ids = codes.tokens(int(begins[lo]), int(ends[hi - 1])).astype("<u4")
                    crcs += [zlib.crc32(ids[a - begins[lo] : b - begins[lo]].data) for a, b in zip(begins[lo:hi], ends[lo:hi], strict=True)]
                keys = pa.array(codes.doc_ids, pa.int64(), mask=codes.no_id.astype(bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins + at), pa.array(ends - begins), pa.array(crcs, pa.int64())], out.names)

    return spark.read.format("binaryFile").load(f"{folder}/*.dac").select("path", "content").mapInArrow(read, out)
