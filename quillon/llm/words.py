"""Vectorised word kernels: the bytes of many texts at once, never a Python loop over characters.

A text is its UTF-8 bytes. Words are maximal runs of word bytes; a table of 256
flags says which bytes those are, so multi-byte characters never split.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _pow(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_ODD, _INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def text_slices(batches, col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``limit`` bytes of ``col`` (a longer text is a slice of its own)."""
    reuse_memory()
    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.schema.get_field_index(col)
        c = rb.column(k)
        if not pa.types.is_large_string(c.type):
            c = c.cast(pa.large_string())
        rb = rb.set_column(k, pa.field(col, pa.large_string()), c)
        ends = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
        at = 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            to = min(to, rb.num_rows)
            yield rb.slice(at, to - at)
            at = to
    give_back()


@functools.cache
def reuse_memory():
    """The C library, set to reuse the memory of freed arrays within a task in place of mapping each array anew (page faults cost as much as the arithmetic)."""
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.mallopt(_M_MMAP_THRESHOLD, 256 << 20)
        lib.mallopt(_M_TRIM_THRESHOLD, 256 << 20)
    except (OSError, AttributeError):  # another C library
        return None
    return lib


_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def give_back() -> None:
    """At the end of a task, freed memory goes back to the system: a reused worker holds little while idle."""
    pa.default_memory_pool().release_unused()
    if lib := reuse_memory():
        lib.malloc_trim(0)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each text) of a large_string column; null is empty."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """The words of a slice: byte spans, and for text i the words first[i]:first[i+1]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.off = off
        cut = off[(off > 0) & (off < len(buf))]  # a word never spans two texts
        starts, ends, last = [], [], False
        for a in range(0, len(buf), CHUNK_BYTES):  # a long text, in chunks: flags and sums stay small
            b = min(len(buf), a + CHUNK_BYTES)
            flag = np.zeros(b - a + 2, dtype=bool)
            flag[0], flag[1:-1], flag[-1] = last, kind[self.buf[a:b]], b < len(buf) and kind[self.buf[b]]
            inside = flag[1:-1]
            begins, stops = inside & ~flag[:-2], inside & ~flag[2:]
            here = cut[np.searchsorted(cut, a) : np.searchsorted(cut, b)] - a
            begins[here] = inside[here]
            here = cut[np.searchsorted(cut, a + 1) : np.searchsorted(cut, b + 1)] - 1 - a
            stops[here] = inside[here]
            starts.append(np.flatnonzero(begins) + a)
            ends.append(np.flatnonzero(stops) + (a + 1))
            last = bool(inside[-1])
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit fingerprints of the words' bytes."""
        raw = np.zeros(len(self), dtype=np.uint64)
        i = 0
        while i < len(raw):
            a = int(self.start[i])
            j = int(np.searchsorted(self.end, a + CHUNK_BYTES, "right"))
            if j <= i:  # a word longer than a chunk
                raw[i] = self._long(a, int(self.end[i]))
                i += 1
                continue
            b = int(self.end[j - 1])
            p, inv = _pow(b - a + 1)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf[a:b]] * p[: b - a], out=sums[1:])
            raw[i:j] = (sums[self.end[i:j] - a] - sums[self.start[i:j] - a]) * inv[self.start[i:j] - a]
            i = j
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(_INV))

    def _long(self, a: int, b: int) -> np.uint64:
        total = 0
        for x in range(a, b, CHUNK_BYTES):
            y = min(b, x + CHUNK_BYTES)
            part = int((_BYTE[self.buf[x:y]] * _pow(y - x)[0][: y - x]).sum(dtype=np.uint64))
            total += part * pow(_ODD, x - a, 1 << 64)
        return np.uint64(total & ((1 << 64) - 1))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n consecutive values from each position; the last n - 1 positions have none."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(_ODD) + h[i : len(h) - n + 1 + i]
    return mix(out)
