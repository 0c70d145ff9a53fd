"""Language-model scoring with a causal self-attention model, trained in numpy on subword ids.

Words are cut into subwords by a public tokenizer. A symbol is a subword with
the flag "last of its word", so words are prefix-free and the symbols' chain rule
gives a proper distribution over words. One attention head over windows of
``T`` symbols predicts a symbol's class (frequent symbols are their own class,
the others are clustered by their contexts), first its group of classes and then the class in that
group, so a target takes 2 * GROUPS exponentials and not CLASSES; within a class a symbol has its
share. Windows overlap: each has ``S`` new positions, which are scored once, and
T - S positions of context. Windows never cross documents.

A word's probability is a mixture of that model's and of the corpus counts in the light of
it: the model's probability of the class of the word's first symbol, times the
word's share of the corpus tokens in that class. The weight is found by expectation-maximisation on
training documents that the net does not learn from (one in ``HELD``, by a hash of the text), each
occurrence left out of its count.

Everything learnt grows with the input. Symbol counts, shares, classes and their
contexts cover every training document, long ones too. The net starts on the driver from
about ``sample_bytes`` of windows (its start only) and then learns from every window of the training
documents not held, however long they are: in ``ROUNDS`` rounds, tasks take steps over their windows and their nets are
averaged.

Counts of the ``frequent`` most frequent words (that bound is the broadcast's) go
to the tasks; words beyond them are joined with the whole table of counts, so every word is
looked up exactly. As each of these is rare, that join has no hot key.

Null texts are empty: one end token. An empty table gives no rows. Repeated rows
are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .base import BIN, BOOL, DBL, LONG, STR, drop, save, schema
from .token_codes import encoder, forget
from .words import NOT_SPACE, Words, give_back, reuse_memory, text_bytes, text_slices

T, S, D, H, SINGLES, CLUSTERS, OWN = 48, 40, 16, 24, 32, 32, 4096
KINDS = 4  # first or later, last or not: of a word's symbols
CLASSES = SINGLES + CLUSTERS
GROUPS = math.isqrt(CLASSES)  # of consecutive classes, as many as each has: the net gives the group and then the class in it
HELD, ROUNDS, REACH, BINS, SLOT_BITS = 16, 4, 6, 64, 22
STRIDE, TOGETHER = 1, 4096  # the net learns from every window; so many are stored together
PARTS = [f"f{i}" for i in range(ROUNDS)]


# ---------------------------------------------------------------- symbols
class Subwords:
    """Words to symbols: 2 * subword id + (1 for the last of the word); the end token has the highest symbol."""

    def __init__(self, path: str):
        self.path = path
        self.end = 2 * encoder(path).tok.get_vocab_size()

    def shapes(self) -> np.ndarray:
        """2 * (begins a word) + (is the last) for each symbol."""
        first = np.zeros(self.end // 2 + 1, np.int64)
        for token, i in encoder(self.path).tok.get_vocab().items():
            first[i] = token.startswith("\u0120")
        out = np.repeat(2 * first, 2)[: self.end + 1]
        out[1::2] += 1
        return out

    def flat(self, words: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols end to end, and how many each has.

        Some words at a time are one text, with a space before each: this tokenizer never merges across it, and
        a subword that begins with the space is a word's first. Where their number is not the words', the words go one by one.
        """
        enc = encoder(self.path)
        if not hasattr(enc, "leads"):
            enc.leads = np.zeros(self.end // 2, bool)
            enc.leads[[i for t, i in enc.tok.get_vocab().items() if t.startswith("\u0120")]] = True
        parts = [words[a : a + together] for a in range(0, len(words), together)]
        flat, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, got in zip(parts, enc.tok.encode_batch_fast([" " + " ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int64)
            begin = np.flatnonzero(enc.leads[ids])
            if len(begin) != len(part) or begin[0] or not all(x.strip() is x for x in part):
                each = [x.ids for x in enc.tok.encode_batch_fast([" " + x for x in part], add_special_tokens=False)]
                ids, begin = np.array([i for x in each for i in x], np.int64), np.cumsum([0, *map(len, each[:-1])])
            flat.append(ids)
            size.append(np.diff(np.append(begin, len(ids))))
        ids, size = np.concatenate(flat), np.concatenate(size)
        ids *= 2
        ids[np.cumsum(size) - 1] += 1
        return ids, size


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[begin : begin + size], end to end."""
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[at]


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents with n targets: (document, first target) of each window of S targets."""
    count = -(-n // S)
    doc = np.repeat(np.arange(len(n)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * S


PAD, BEGIN = -1, -2  # in a frame: outside of the document; just before it


def frames(sym: np.ndarray, n_doc: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of windows (document, first target) with the T - S + 1 before them, and the targets' places in ``sym``."""
    local = at[:, None] + np.arange(-(T - S) - 1, S)[None, :]
    place = (np.cumsum(n_doc) - n_doc)[doc][:, None] + local
    ok = (local >= 0) & (local < n_doc[doc][:, None])
    rows = np.where(ok, sym[np.where(ok, place, 0)], PAD).astype(np.int32)
    rows[local == -1] = BEGIN
    return rows, place[:, T - S + 1 :]


def packed(rows: np.ndarray) -> bytes:
    """``frames`` as their halves in 16 bits (32, for a very large vocabulary) and the lowest bits, eight to a byte."""
    up = rows.ravel() + 2
    half = up >> 1
    wide = bool(len(half)) and int(half.max()) > 0xFFFF
    return bytes([wide]) + half.astype("<u4" if wide else "<u2").tobytes() + np.packbits(up & 1).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    size = 4 if raw[0] else 2
    n = (len(raw) - 1) * 8 // (8 * size + 1)  # each has its half and a bit
    n -= n % (T + 1)
    half = np.frombuffer(raw, f"<u{size}", n, 1).astype(np.int32)
    half *= 2
    half += np.unpackbits(np.frombuffer(raw, np.uint8, offset=1 + n * size), count=n)
    half -= 2
    return half.reshape(-1, T + 1)


# ---------------------------------------------------------------- the model
#: highest score of a key for each query; none for keys that come later
_CAP = np.where(np.arange(T)[None, :] <= np.arange(T - S, T)[:, None], 30, -1e9).astype(np.float32)


_ONES = np.ones((max(T, CLASSES), 1), np.float32)


def _with_bias(w: np.ndarray, bias: np.ndarray, more: int = 0) -> np.ndarray:
    """Weights and, for a unit that is always one, biases; with ``more``, that unit also comes out."""
    out = np.zeros((len(w) + 1, len(bias) + more), np.float32)
    out[:-1, : len(bias)], out[-1, : len(bias)], out[-1, len(bias) :] = w, bias, 1
    return out


def _exponentials(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scores, GROUPS at a time, up to a factor for these, and their sums; ``y`` is brought to their highest (in place) only where some leave the range."""
    x = y.reshape(-1, GROUPS)
    if x.max(initial=0) <= 80:
        e = np.exp(x)
        each = e @ _ONES[:GROUPS, 0]
        if each.min(initial=1) > 1e-30:
            return e, each
    x -= x.max(1, keepdims=True)
    e = np.exp(x)
    return e, e @ _ONES[:GROUPS, 0]


_FIRST = np.arange(0, CLASSES, GROUPS, dtype=np.uint8)
_OWN = np.stack([np.arange(CLASSES) // GROUPS, GROUPS + np.arange(CLASSES) % GROUPS], 1)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Places of target classes in ascending order; (group, begin, end) of each group's; and where, among ``scores`` in that order, those of their group and class are."""
    target = target.astype(np.uint8)  # short ones are sorted by their digits
    order = np.argsort(target, kind="stable")
    target = target[order]
    ends = np.searchsorted(target, _FIRST).tolist() + [len(target)]
    own = _OWN.take(target, 0)
    own += np.arange(0, 2 * GROUPS * len(target), 2 * GROUPS)[:, None]
    return order, [(g, a, b) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a], own


def _scores(z: np.ndarray, w: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Of every group, and of the classes in the target's one."""
    y = np.empty((len(z), 2 * GROUPS), np.float32)
    for g, a, b in spans:
        np.matmul(z[a:b], w[g], out=y[a:b])
    return y


class Attention:
    """Input ids (windows by T) to class probabilities at the last S positions."""

    def __init__(self, inputs: int, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3 / math.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (r.standard_normal((inputs, D)) * 0.3).astype(np.float32), "P": (r.standard_normal((T, D)) * 0.1).astype(np.float32), "Wq": f(D, D), "Wk": f(D, D), "Wv": f(D, D), "W1": f(D, H) * 3, "b1": np.zeros(H, np.float32), "Wo": f(H, CLASSES), "bo": np.zeros(CLASSES, np.float32), "Wg": f(H, GROUPS), "bg": np.zeros(GROUPS, np.float32)}

    def outputs(self) -> np.ndarray:
        """For targets of each group: the weights and biases of all groups, and of its classes."""
        p, w = self.p, np.empty((GROUPS, H + 1, 2 * GROUPS), np.float32)
        w[:, :H, :GROUPS], w[:, H, :GROUPS] = p["Wg"], p["bg"]
        w[:, :H, GROUPS:], w[:, H, GROUPS:] = p["Wo"].reshape(H, GROUPS, GROUPS).transpose(1, 0, 2), p["bo"].reshape(GROUPS, GROUPS)
        return w

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def projected(self) -> tuple[np.ndarray, ...]:
        """Keys with values, and queries with embeddings, of every input id and of every place, which a window only looks up; biases are weights of a unit that is always one."""
        if not hasattr(self, "_projected"):
            p, root = self.p, np.float32(math.sqrt(D))
            one = lambda x, c: np.concatenate([x, np.full((len(x), 1), c, np.float32)], 1)
            eq, pq, ek, pk, ev, pv = (x @ w for w in (p["Wq"] / root, p["Wk"], p["Wv"]) for x in (p["E"], p["P"]))
            w1 = np.concatenate([one(p["W1"], 0), one(p["b1"][None, :], 1)])
            both = lambda x, y: np.concatenate([x, y], 1)
            self._projected = both(ek, one(ev, 0)), both(pk, one(pv, 0)), both(eq, one(p["E"], 1)), both(pq, one(p["P"], 0))[T - S :], w1, self.outputs()
        return self._projected

    def log_class(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of the target classes (windows by S)."""
        ekv, pkv, eqx, pqx, w1, wo = self.projected()
        kv, qx = ekv.take(ids, 0), eqx.take(ids[:, T - S :], 0)
        kv += pkv
        qx += pqx
        a = np.matmul(qx[:, :, :D], kv[:, :, :D].transpose(0, 2, 1))
        np.minimum(a, _CAP, out=a)
        np.exp(a, out=a)
        h = np.matmul(a, kv[:, :, D:])
        h /= (a.reshape(-1, T) @ _ONES[:T]).reshape(-1, S, 1)
        h += qx[:, :, D:]
        order, spans, own = _by_group(target.ravel())
        z = h.reshape(-1, D + 1).take(order, 0) @ w1
        np.maximum(z, 0, out=z)
        y = _scores(z, wo, spans)
        each = _exponentials(y)[1]
        got = y.ravel()[own]
        got -= np.log(each).reshape(-1, 2)
        out = np.empty(len(y), np.float32)
        out[order] = got[:, 0] + got[:, 1]
        return out.reshape(target.shape)

    def gradients(self, ids: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the used targets, and its gradients; all products but attention's are of two plain matrices.

        Keys and values are never made: the queries' and keys' weights are one matrix, and attention's means are taken of embeddings.
        Attention's rows are never divided by their sums: embeddings have a component that is always one, so the sums come with the products, and the products are divided.
        """
        p, b, root = self.p, len(ids), np.float32(math.sqrt(D))
        x = np.concatenate([p["E"], np.ones((len(p["E"]), 1), np.float32)], 1).take(ids, 0)
        x += np.concatenate([p["P"], np.zeros((T, 1), np.float32)], 1)
        fq, keys = x[:, T - S :].reshape(-1, D + 1), x[:, :, :D]
        wqk = p["Wq"] @ p["Wk"].T / root
        q = (fq[:, :D] @ wqk).reshape(b, S, D)
        a = np.matmul(q, keys.transpose(0, 2, 1))
        np.minimum(a, _CAP, out=a)
        np.exp(a, out=a)
        att = np.matmul(a, x).reshape(-1, D + 1)
        total = att[:, D:].copy()
        att /= total
        wv = np.zeros((D + 1, D + 1), np.float32)
        wv[:D, :D] = p["Wv"]
        h = att @ wv
        h += fq  # its last component is one, the biases' unit
        order, spans, own = _by_group(target.ravel())
        h = h.take(order, 0)
        z = h @ _with_bias(p["W1"], p["b1"], 1)
        np.maximum(z, 0, out=z)
        wo = self.outputs()
        y, each = _exponentials(_scores(z, wo, spans))
        weight = use.ravel()[order].astype(np.float32)
        n = max(1.0, float(weight.sum()))
        flat, weight = y.reshape(-1), np.repeat(weight, 2)
        loss = -float(np.dot(np.log(flat[own.ravel()] / each + 1e-30), weight)) / n
        weight /= np.float32(n)
        y *= (weight / each)[:, None]
        flat[own.ravel()] -= weight
        y, dz, go = y.reshape(-1, 2 * GROUPS), np.empty((len(z), H), np.float32), np.zeros_like(wo)
        for i, c, d in spans:
            np.matmul(y[c:d], wo[i, :H].T, out=dz[c:d])
            np.matmul(z[c:d].T, y[c:d], out=go[i])
        dz *= z[:, :H] > 0
        dh, g1 = np.empty((len(z), D), np.float32), h.T @ dz
        dh[order] = dz @ p["W1"].T
        g = {"Wg": go[:, :H, :GROUPS].sum(0), "bg": go[:, H, :GROUPS].sum(0), "Wo": go[:, :H, GROUPS:].transpose(1, 0, 2).reshape(H, CLASSES), "bo": go[:, H, GROUPS:].ravel(), "W1": g1[:D], "b1": g1[D]}
        part = np.empty((len(dh), D + 1), np.float32)
        np.divide(dh @ p["Wv"].T, total, out=part[:, :D])
        np.negative(np.einsum("ij,ij->i", part[:, :D], att[:, :D]), out=part[:, D])
        part = part.reshape(b, S, D + 1)
        ds = np.matmul(part, x.transpose(0, 2, 1))
        ds *= a
        dq = np.matmul(ds, keys).reshape(-1, D)
        gqk = fq[:, :D].T @ dq / root
        g |= {"Wq": gqk @ p["Wk"], "Wk": gqk.T @ p["Wq"], "Wv": att[:, :D].T @ dh}
        dx = np.matmul(ds.transpose(0, 2, 1), q)
        dx += np.matmul(a.transpose(0, 2, 1), part[:, :, :D])
        dh += dq @ wqk.T
        dx[:, T - S :] += dh.reshape(b, S, D)
        g["P"] = dx.sum(0)
        pairs = np.zeros((len(p["E"]), D // 2), np.complex64)  # two sums at a time
        np.add.at(pairs.reshape(-1), (ids.reshape(-1, 1) * (D // 2) + np.arange(D // 2)).ravel(), dx.view(np.complex64).ravel())
        g["E"] = pairs.view(np.float32)
        return loss, g

    def step(self, state: dict, ids: np.ndarray, target: np.ndarray, use: np.ndarray, rate: float) -> float:
        """One step of Adam; ``state`` is empty at first. All weights lie in one array, and so do their means."""
        if not state:
            flat = np.concatenate([v.ravel() for v in self.p.values()])
            ends = np.cumsum([v.size for v in self.p.values()])
            self.p = {k: flat[e - v.size : e].reshape(v.shape) for (k, v), e in zip(self.p.items(), ends, strict=True)}
            state |= {"t": 0, "flat": flat, "m": np.zeros_like(flat), "s": np.zeros_like(flat)}
        loss, g = self.gradients(ids, target, use)
        t = state["t"] = state["t"] + 1
        m, s, g = state["m"], state["s"], np.concatenate([g[k].ravel() for k in self.p])
        m *= np.float32(0.9)  # ten times the mean, and a hundred times the squares' mean
        m += g
        g *= g
        s *= np.float32(0.99)
        s += g
        if t % 256 == 0:  # what fades away is none, and takes no slow arithmetic
            m[np.abs(m) < 1e-30] = 0
            s[s < 1e-30] = 0
        np.sqrt(s, out=g)
        g *= np.float32(0.1 / math.sqrt(1 - 0.99**t))
        g += np.float32(1e-8)
        np.divide(m, g, out=g)
        g *= np.float32(0.1 * rate / (1 - 0.9**t))
        state["flat"] -= g
        return loss

    def train(self, ids: np.ndarray, target: np.ndarray, use: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 2) -> float:
        r, state, mean = np.random.default_rng(seed), {}, 0.0
        for t in range(1, steps + 1):
            w = r.integers(0, len(ids), batch)
            loss = self.step(state, ids[w], target[w], use[w], rate * min(1.0, t / 20) * (1 - 0.9 * t / steps))
            mean = loss if t == 1 else 0.95 * mean + 0.05 * loss
        return mean


def singles(counts: np.ndarray) -> np.ndarray:
    """The symbols that are classes of their own: the end token and the most frequent ones."""
    order, end = np.argsort(-counts, kind="stable"), len(counts) - 1
    return np.concatenate([[end], order[order != end]])[:SINGLES]


def contexts(sym: np.ndarray, n_doc: np.ndarray, col: np.ndarray):
    """symbol * SINGLES + single for each pair of a single (``col``: its place, else -1) and another symbol within REACH places in a document."""
    at = np.arange(len(sym)) + np.repeat(np.arange(len(n_doc)) * REACH, n_doc)  # documents lie REACH places apart
    flat = np.zeros(len(sym) + REACH * len(n_doc), np.int32)
    place = np.full(len(flat), -2, np.int8)
    flat[at], place[at] = sym, col[sym]
    hot, cold = place >= 0, place == -1
    for gap in range(1, REACH + 1):
        n = max(0, len(flat) - gap)
        for x, y in ((0, gap), (gap, 0)):
            k = np.flatnonzero(hot[x : x + n] & cold[y : y + n])
            yield flat[y : y + n][k] * np.int32(SINGLES) + place[x : x + n][k]


def cluster(counts: np.ndarray, own: np.ndarray, near: np.ndarray, shape: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol and log share within its class, from the symbols' counts, the single ones, ``contexts`` (symbols by SINGLES) and places in a word."""
    symbols = len(counts)
    kind = np.full(symbols, CLASSES - 1, dtype=np.int64)
    seen = np.setdiff1d(np.flatnonzero(counts > 0), own)
    seen = seen[np.argsort(-counts[seen], kind="stable")]
    table = near[seen] + 0.02
    base = table.sum(0) / max(table.sum(), 1e-9)
    f = np.log1p(table / table.sum(1, keepdims=True) / base)
    f /= np.linalg.norm(f, axis=1, keepdims=True) + 1e-9
    r = np.random.default_rng(seed)
    each = CLUSTERS // KINDS
    kind[:] = SINGLES + shape * each
    for t in range(KINDS):
        mine = np.flatnonzero(shape[seen] == t)
        if len(mine) < each:
            continue
        g, w = f[mine], np.sqrt(counts[seen[mine]])[:, None]
        centre = g[r.choice(min(len(g), 40 * each), each, replace=False)]
        for _ in range(12):
            at = (g @ centre.T).argmax(1)
            for c in range(each):
                v = (g * w)[at == c].sum(0)
                centre[c] = v / (np.linalg.norm(v) + 1e-9) if (at == c).any() else centre[c]
        kind[seen[mine]] = SINGLES + t * each + at
    kind[own] = np.arange(SINGLES)
    weight = counts + 0.05
    share = np.log(weight) - np.log(np.bincount(kind, weight, minlength=CLASSES)[kind])
    return kind, share


class Model:
    """Everything that scoring needs besides the whole table of counts."""

    def inputs(self, frames: np.ndarray):
        """Of ``frames``: (input ids, target classes, valid)."""
        if not hasattr(self, "_tables"):  # BEGIN and PAD are the places -2 and -1
            self._tables = np.append(self.input_of, [self.begin, self.pad]), np.append(self.kind, [0, 0])
        ids, kinds = self._tables
        targets = frames[:, T - S + 1 :]
        return ids[frames[:, :-1]], kinds[targets], targets >= 0

    def log_symbols(self, sym: np.ndarray, n_doc: np.ndarray, batch: int = 128) -> np.ndarray:
        """Natural log probability of each symbol's class; each is scored in one window."""
        out = np.zeros(len(sym))
        doc, at = windows(n_doc)
        for a in range(0, len(doc), batch):
            rows, place = frames(sym, n_doc, doc[a : a + batch], at[a : a + batch])
            ids, target, ok = self.inputs(rows)
            out[place[ok]] = self.net.log_class(ids, target)[ok]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of fingerprints in the sorted ``hashes``, or -1: by a table of their high bits, and a search where two share a slot."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        if not hasattr(self, "_slots"):
            self._slots = np.full(1 << SLOT_BITS, -1, np.int32)
            self._slots[self.hashes >> np.uint64(64 - SLOT_BITS)] = np.arange(len(self.hashes))
        at = self._slots[h >> np.uint64(64 - SLOT_BITS)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.hashes[at] != h))
        if len(other):
            near = np.minimum(np.searchsorted(self.hashes, h[other]), len(self.hashes) - 1)
            at[other] = np.where(self.hashes[near] == h[other], near, -1)
        return at

    def joined(self, more: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, sizes and beginnings of the frequent words, ``more`` words and the end: the tables have room for these behind them, so that a slice copies no table."""
        n, k = len(self.flat), len(self.size)
        to, last = n + len(more), k + len(lens)
        if not hasattr(self, "_room") or len(self._room[0]) <= to or len(self._room[1]) <= last:
            self._room = np.empty(to + len(more) + 1, np.int32), np.empty(last + len(lens) + 1, np.int32), np.empty(last + len(lens) + 1, np.int64)
            flat, size, begin = self._room
            flat[:n], size[:k], begin[:k] = self.flat, self.size, np.cumsum(self.size) - self.size
        flat, size, begin = self._room
        flat[n:to], flat[to] = more, self.subwords.end
        size[k:last], size[last] = lens, 1
        begin[k], begin[k + 1 : last + 1] = n, n + np.cumsum(lens)
        return flat, size, begin

    def symbols(self, rb: pa.RecordBatch):
        """Of a slice: its words' places in the frequent ones (-1: rare), the rare ones and their strings.

        And its symbols end to end, how many each document has, the place of each token's (words and ends)
        first one, the documents' numbers of words and each word's document.
        """
        buf, off = text_bytes(rb.column("text"))
        w = Words(buf, off, NOT_SPACE, lower=True)
        h = w.hashes()
        at = self.find(h)
        rare = np.flatnonzero(at < 0)
        raw = w.buf.tobytes()
        strings = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[rare].tolist(), w.end[rare].tolist(), strict=True)]
        distinct, which = np.unique(h[rare], return_inverse=True) if len(rare) else (np.zeros(0), np.zeros(0, np.int64))
        one = np.zeros(len(distinct), np.int64)
        one[which] = np.arange(len(rare))
        syms, lens = self.subwords.flat([strings[i] for i in one.tolist()]) if len(distinct) else (np.zeros(0, np.int64),) * 2
        flat, size, begin = self.joined(syms, lens)
        entry = at.copy()
        entry[rare] = len(self.size) + which
        # an end token after each document
        n_words = np.diff(w.first)
        tokens = np.full(len(h) + len(n_words), len(self.size) + len(lens), dtype=np.int64)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        tokens[np.arange(len(h)) + doc] = entry
        sizes = size[tokens]
        sym = gather(flat, begin[tokens], sizes)
        ends = np.cumsum(n_words + 1)
        n_doc = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])])
        return at, rare, strings, sym, n_doc, np.cumsum(sizes) - sizes, n_words, doc

    def words(self, rb: pa.RecordBatch):
        """Of a slice: its words' places in the frequent ones (-1: rare), the rare ones and their strings.

        And for each token (words and ends): the net's log probability, and the net's
        probability of its first class for each of the corpus tokens in that class.
        """
        at, rare, strings, sym, n_doc, first, n_words, doc = self.symbols(rb)
        if not len(sym):
            return at, rare, strings, np.zeros(0), np.zeros(0), n_words, doc
        lc = self.log_symbols(sym, n_doc)
        each = np.exp(lc[first]) / np.maximum(self.mass[self.kind[sym[first]]], 1)
        return at, rare, strings, np.add.reduceat(lc + self.share[sym], first), each, n_words, doc


def count_words(docs: DataFrame, hold: int = 400_000) -> DataFrame:
    """word, c over ``docs(text)``, combined within slices and tasks before the shuffle."""

    def run(batches):
        held, size = [], 0

        def combined():
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for rb in text_slices(batches):
            buf, off = text_bytes(rb.column("text"))
            w = Words(buf, off, NOT_SPACE, lower=True)
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.end - w.start)])
            got = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(w.buf[NOT_SPACE[w.buf]])]).value_counts()
            held.append(pa.table([_strings(got.field("values")), got.field("counts")], ["word", "c"]))
            size += len(got)
            if size >= hold:
                held = [combined()]
                size = held[0].num_rows
                if size >= hold // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, size = [], 0
        if held:
            yield from combined().to_batches(max_chunksize=20_000)

    return docs.select("text").mapInArrow(run, schema(word=STR, c=LONG)).groupBy("word").agg(F.sum("c").alias("c"))


def _strings(raw: pa.Array) -> pa.Array:
    """As text; bytes that are no UTF-8 read as U+FFFD."""
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encoded(learn: DataFrame, m: Model, col: np.ndarray) -> DataFrame:
    """One pass over the training documents: rows with every window that the net learns from, ``packed`` by the round in which it does (f0, f1, ...); and rows (k, c), counts over all.

    k is a ``contexts`` key, or beyond these a symbol, or beyond these a symbol that begins a token.
    """
    shared = learn.sparkSession.sparkContext.broadcast((m, col))

    def run(batches):
        model, of = shared.value
        n, turn = len(of), 0
        near, every = np.zeros(n * SINGLES, np.int64), np.zeros(2 * n, np.int64)
        for rb in text_slices(batches):
            _, _, _, sym, n_doc, first, *_ = model.symbols(rb)
            for k in contexts(sym, n_doc, of):
                np.add.at(near, k, 1)
            every += np.concatenate([np.bincount(sym, minlength=n), np.bincount(sym[first], minlength=n)])
            use = np.array(rb.column("learns").to_pylist(), bool)
            doc, at = windows(np.where(use, n_doc, 0))
            for x in range(0, len(doc), ROUNDS * TOGETHER):
                y = min(len(doc), x + ROUNDS * TOGETHER)
                share = [np.arange(x + (part - turn) % ROUNDS, y, ROUNDS) for part in range(ROUNDS)]  # each round has its share of every slice
                raw = [pa.array([packed(frames(sym, n_doc, doc[now], at[now])[0])], pa.binary()) for now in share]
                yield pa.RecordBatch.from_arrays([*raw, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], [*PARTS, "k", "c"])
                turn += 1
        near = np.concatenate([near, every])
        at = np.flatnonzero(near)
        for a in range(0, len(at), 1 << 16):
            k = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(k), pa.binary())] * ROUNDS, pa.array(k), pa.array(near[k])], [*PARTS, "k", "c"])

    rows = learn.select(F.col("text").cast("string").alias("text"), (~_held()).alias("learns"))
    return save(rows.mapInArrow(run, schema(**dict.fromkeys(PARTS, BIN), k=LONG, c=LONG)), "encoded")


def _held() -> Column:
    return F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HELD)) == 0


def learn_all(m: Model, streams: DataFrame, batch: int = 64, rate: float = 0.005) -> None:
    """The net learns from every window of ``streams(f0, f1, ...)`` once, a column at a time."""
    names = sorted(m.net.p)
    m.windows = 0
    adders = max(1, math.isqrt(streams.rdd.getNumPartitions()))
    for turn in range(ROUNDS):
        light = Model()  # without the words
        light.net, light.kind, light.input_of, light.pad, light.begin = m.net, m.kind, m.input_of, m.pad, m.begin
        shared = streams.sparkSession.sparkContext.broadcast(light)
        speed = rate * (1 - 0.9 * turn / ROUNDS)

        def run(batches):
            reuse_memory()
            model, r, state, n = shared.value, np.random.default_rng(turn), {}, 0
            net = Attention(1)
            net.p = {k: v.copy() for k, v in model.net.p.items()}
            for rb in batches:
                for raw in rb.column(0):
                    ids, target, ok = model.inputs(unpacked(raw.as_buffer()))
                    order = r.permutation(len(ids))
                    for a in range(0, len(ids), batch):
                        w = order[a : a + batch]
                        net.step(state, ids[w], target[w], ok[w], speed * min(1.0, (state.get("t", 0) + 1) / 20) * len(w) / batch)
                    n += len(ids)
            give_back()
            if n:
                yield _parts([n], [np.concatenate([net.p[k].ravel() for k in names]).astype(np.float64) * n])

        def add(batches):
            n, total = 0, 0.0
            for rb in batches:
                for k, raw in zip(rb.column("n").to_pylist(), rb.column("p"), strict=True):
                    n, total = n + k, total + np.frombuffer(raw.as_py(), np.float64)
            if n:
                yield _parts([n], [total])

        kinds = schema(n=LONG, p=BIN)
        got = streams.select(PARTS[turn]).where(F.col(PARTS[turn]).isNotNull()).mapInArrow(run, kinds).repartition(adders).mapInArrow(add, kinds).collect()
        n = sum(x.n for x in got)
        if n:
            flat, at = sum(np.frombuffer(x.p, np.float64) for x in got) / n, 0
            for k in names:
                size = m.net.p[k].size
                m.net.p[k] = flat[at : at + size].reshape(m.net.p[k].shape).astype(np.float32)
                at += size
        m.windows += n


def _parts(n: list, p: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([x.tobytes() for x in p], pa.binary())], ["n", "p"])


def fit(docs: DataFrame, train: Column, tokenizer: str, sample_bytes: int = 2_000_000, frequent: int = 1_000_000, steps: int = 500) -> tuple[Model, DataFrame]:
    """The model and the saved table of counts (word, c) of the training documents."""
    learn = docs.where(train)
    counts = save(count_words(learn.where("text is not null")), "counts")
    ends = learn.count()
    n_words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    m = Model()
    m.ends, m.N, m.V = ends, (n_words or 0) + ends, distinct + (1 if ends else 0)
    # the least count that keeps the broadcast within its bound
    steps_of = {r.s: r.n for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*").alias("n")).collect()}
    least, held = None, 0
    for s in sorted(steps_of, reverse=True):
        if held + steps_of[s] > frequent:
            break
        held, least = held + steps_of[s], s
    top = counts.where(F.floor(F.log2("c") * 8) >= (least if least is not None else 1 << 30)).toArrow()
    m.subwords = Subwords(tokenizer)
    words = top["word"].cast(pa.large_string()).combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    h = Words(*text_bytes(words), NOT_SPACE).hashes()
    flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(words), 10_000):
        x, n = m.subwords.flat(words[a : a + 10_000].to_pylist())
        flat.append(x.astype(np.int32))
        size.append(n)
    forget()
    order = np.argsort(h)
    flat, size = np.concatenate(flat), np.concatenate(size)
    m.hashes, m.c, m.size = h[order], np.array(top["c"], np.int64)[order], size[order].astype(np.int32)
    m.flat = gather(flat, (np.cumsum(size) - size)[order], size[order])
    del top, words, flat
    symbols = m.subwords.end + 1
    often = np.bincount(m.flat, np.repeat(m.c, m.size), minlength=symbols)  # which symbols are frequent shows in frequent words; the counts below are of all
    often[m.subwords.end] += ends
    col = np.full(symbols, -1)
    own = singles(often)
    col[own] = np.arange(SINGLES)
    rows = encoded(learn, m, col)
    sums = np.zeros(symbols * (SINGLES + 2))
    got = rows.where("k is not null").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    sums[np.array(got["k"], np.int64)] = np.array(got["c"], np.float64)
    near, m.counts, begins = sums[: symbols * SINGLES].reshape(symbols, SINGLES), sums[symbols * SINGLES : -symbols], sums[-symbols:]
    m.kind, m.share = cluster(m.counts, own, near, m.subwords.shapes())
    m.mass = np.bincount(m.kind, begins, minlength=CLASSES)
    m.pad, m.begin = OWN + CLASSES, OWN + CLASSES + 1
    m.input_of = OWN + m.kind
    m.input_of[np.argsort(-m.counts, kind="stable")[:OWN]] = np.arange(OWN)
    m.net = Attention(OWN + CLASSES + 2)
    first, held = [], 0
    for part in PARTS:  # where the net starts; it learns from all of them below
        if held >= sample_bytes:
            break
        for r in rows.select(part).where(F.col(part).isNotNull()).toLocalIterator():
            first.append(unpacked(r[0]))
            held += first[-1].nbytes
            if held >= sample_bytes:
                break
    if first:
        m.loss = m.net.train(*m.inputs(np.concatenate(first)), steps)
    learn_all(m, rows)
    drop(rows)
    m.weight = _mixture(m, learn.where(_held()), counts)
    return m, counts


def _lower(t: str) -> str:
    return t.translate(_AZ)


_AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def _mixture(m: Model, held: DataFrame, counts: DataFrame, rounds: int = 30) -> float:
    """Weight of the counts, by EM on the words of training documents kept from the net, each occurrence left out of its count.

    EM needs only how the ratio of the two models is distributed: it is counted in steps of 1 / BINS of its logarithm.
    """
    shared = held.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        model = shared.value
        for rb in text_slices(batches):
            at, rare, strings, lp, each, n_words, doc = model.words(rb)
            place = np.arange(len(at)) + doc
            e = np.log(each[place] + 1e-300) - lp[place]  # of one occurrence
            own = np.where(at >= 0, model.c[np.maximum(at, 0)] - 1, 0) if len(model.c) else np.zeros(len(at))
            some = own > 0
            bins, n = np.unique(np.floor((np.log(own[some]) + e[some]) * BINS).astype(np.int64), return_counts=True)
            none = int(((at >= 0) & ~some).sum())
            size, more = len(bins) + 1, len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * size + strings, pa.string()), pa.array(np.concatenate([np.zeros(size), e[rare]])),
                    pa.array([None, *bins.tolist(), *[None] * more], pa.int64()), pa.array(np.concatenate([[none], n, np.ones(more, np.int64)]).astype(np.int64)),
                ],
                ["word", "e", "bin", "n"],
            )

    rows = save(held.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema(word=STR, e=DBL, bin=LONG, n=LONG)), "ratios")
    rare = rows.where("word is not null").drop("bin").join(counts, "word", "left")
    rare = rare.select(F.when(F.col("c") > 1, F.floor((F.log(F.col("c") - 1) + F.col("e")) * BINS)).alias("bin"), "n")
    got = rows.where("word is null").select("bin", "n").unionAll(rare).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in got)
    if not total:
        return 0.5
    ratio = np.exp(np.minimum((np.array([r.bin for r in got if r.bin is not None], float) + 0.5) / BINS, 600))
    n = np.array([r.n for r in got if r.bin is not None], float)
    x = 0.5
    for _ in range(rounds):
        x = float((n * (x * ratio / (x * ratio + 1 - x))).sum() / total)
    return min(0.98, max(0.02, x))


def score(docs: DataFrame, train: Column, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, v, x = model.N, model.V, model.weight
    floor = n + 0.1 * (v + 1)

    def run(batches):
        m = shared.value
        base_of = np.log10((m.c + 0.1) / floor)
        end_base = math.log10((m.ends + 0.1) / floor)
        for rb in text_slices(batches):
            at, rare, strings, lp, each, n_words, doc = m.words(rb)
            k = rb.num_rows
            net = np.exp(lp)
            place = np.arange(len(at)) + doc
            ok = at >= 0
            base = np.bincount(doc[ok], base_of[at[ok]], minlength=k) + end_base
            known = np.bincount(doc[ok], minlength=k) + (1 if m.ends else 0)
            got = np.bincount(doc[ok], np.log10(x * m.c[at[ok]] * each[place[ok]] + (1 - x) * net[place[ok]] + 1e-300), minlength=k)
            ends = np.cumsum(n_words + 1) - 1
            got = got + np.log10(x * m.ends * each[ends] + (1 - x) * net[ends] + 1e-300)
            off = np.searchsorted(doc[rare], np.arange(k + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rb.column("doc_id"), rb.column("held_out"), pa.array(n_words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(got),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(strings, pa.string())), pa.ListArray.from_arrays(pa.array(off), pa.array(lp[place[rare]])), pa.ListArray.from_arrays(pa.array(off), pa.array(each[place[rare]])),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "got", "rare", "lp", "each"],
            )

    kinds = T_.StructType([*schema(doc_id=LONG, held_out=BOOL, n_tokens=LONG, known=LONG, base=DBL, got=DBL).fields, T_.StructField("rare", T_.ArrayType(T_.StringType())), T_.StructField("lp", T_.ArrayType(DBL)), T_.StructField("each", T_.ArrayType(DBL))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~train, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    part = save(rows.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "lp", "each")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.lp").alias("lp"), F.col("w.each").alias("each"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10((c + 0.1) / floor)).alias("base2"), F.sum((c > 0).cast("long")).alias("known2"),
        F.sum(F.log10(F.lit(x) * c * F.col("each") + F.lit(1 - x) * F.exp("lp") + F.lit(1e-300))).alias("got2"),
    )
    zero = lambda k: F.coalesce(k, F.lit(0))
    return part.drop("rare", "lp", "each").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known2")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"), (F.col("got") + zero("got2")).alias("score"),
    )


__all__ = ["Attention", "Model", "cluster", "count_words", "fit", "score", "BIN"]
