"""Language identification by mixture inference: EM over word likelihoods built from character n-grams.

Each language has smoothed log probabilities of hashed byte n-grams (two orders).
The likelihood of a word is that of its n-grams; a document is a mixture of
languages with unknown proportions, estimated by expectation-maximisation. The
set of languages is chosen by backward elimination under a penalised likelihood:
a language stays only if it pays more than ``penalty`` log units per
log(number of words).

Null texts and texts without a letter give ``und`` with score 0. Labels that are
null take no part in learning. Without any labelled row every document is ``und``.
Ties between languages go to the first in sorted order. Repeated rows are
answered each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BIN, BOOL, DBL, LONG, STR, schema
from .words import NOT_SPACE, Words, mix, text_bytes, text_slices

ORDERS = (3, 4)
BITS = 15
SIZE = 1 << BITS
SLICE = 1 << 18  # bytes of text at a time, as the n-grams of a byte take about a hundred
_SKIP = np.zeros(256, dtype=np.uint8)
_SKIP[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 1  # ASCII that is no letter
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[_SKIP.astype(bool)] = 0x20


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], Words]:
    """For each order: bucket of the n-gram that ends at each byte of a word, and that byte's place; n-grams begin with a space."""
    flat = _FOLD[buf]
    # Latin-1 capitals in UTF-8: C3 80..9E
    two = np.flatnonzero((flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[:-1] == 0xC3)) + 1 if len(flat) > 1 else np.zeros(0, int)
    flat[two] += 0x20
    words = Words(flat, off, NOT_SPACE)
    # each word as " word ", laid end to end
    n = words.end - words.start + 2
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    text = np.full(at[-1], 0x20, dtype=np.uint64)
    inner = np.arange(at[-1] - 2 * len(n)) + np.repeat(2 * np.arange(len(n)) + 1, n - 2)
    source = np.arange(at[-1] - 2 * len(n)) + np.repeat(words.start - np.concatenate([np.zeros(1, np.int64), np.cumsum(n - 2)[:-1]]), n - 2) if len(n) else np.zeros(0, np.int64)
    text[inner] = flat[source]
    ids, owner = [], []
    for k, order in enumerate(ORDERS):
        if len(text) < order:
            ids.append(np.zeros(0, np.int64))
            owner.append(np.zeros(0, np.int64))
            continue
        g = np.zeros(len(text) - order + 1, dtype=np.uint64)
        for i in range(order):
            g = g * np.uint64(257) + text[i : len(g) + i]
        word = np.repeat(np.arange(len(n)), n)[: len(g)]
        whole = np.repeat(at[1:], n)[: len(g)] - np.arange(len(g)) >= order  # n-grams do not cross words
        ids.append(((mix(g[whole]) >> np.uint64(64 - BITS)).astype(np.int64)) + k * SIZE)
        owner.append(word[whole])
    return ids, owner, words


def fit(docs: DataFrame, train: Column, docs_per_language: int = 4000) -> dict:
    """Counts from at most about ``docs_per_language`` labelled documents of each language (chosen by a hash of doc_id).

    The bound is what keeps the model's cost the same at any input size; whole
    texts of the chosen documents are used.
    """
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "table": np.zeros((len(ORDERS) * SIZE, 0), np.float32)}
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))]), F.col("lang"))
    some = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for rb in text_slices(batches, limit=SLICE):
            lang = np.array(rb.column("lang").to_pylist(), dtype=object)
            buf, off = text_bytes(rb.column("text"))
            ids, owner, words = _features(buf, off)
            of_word = np.repeat(np.arange(len(lang)), np.diff(words.first))
            for k in set(lang.tolist()):
                mine = (lang == k)[of_word]
                got = totals.setdefault(k, np.zeros(len(ORDERS) * SIZE, np.int64))
                for i, o in zip(ids, owner, strict=True):
                    got += np.bincount(i[mine[o]], minlength=len(got))
        for k, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()], pa.binary())], ["lang", "counts"])

    counts = {k: np.zeros(len(ORDERS) * SIZE, np.int64) for k in langs}
    for r in some.repartition(6).mapInArrow(count, schema(lang=STR, counts=BIN)).toLocalIterator():
        counts[r.lang] += np.frombuffer(r.counts, np.int64)
    table = np.zeros((len(ORDERS) * SIZE, len(langs)), np.float32)
    for j, k in enumerate(langs):
        for o in range(len(ORDERS)):
            c = counts[k][o * SIZE : (o + 1) * SIZE] + 0.2
            table[o * SIZE : (o + 1) * SIZE, j] = np.log(c / c.sum()) / len(ORDERS)
    return {"langs": langs, "table": table}


def _em(like: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """like: words x languages, scaled so that each row's maximum is 1."""
    for _ in range(rounds):
        joint = like * pi
        pi = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    return pi, float(np.log(like @ pi).sum())


def infer(loglike: np.ndarray, penalty: float = 3.0, rounds: int = 8) -> np.ndarray:
    """Language proportions of one document from its words' log likelihoods."""
    like = np.exp(np.maximum(loglike - loglike.max(axis=1, keepdims=True), -30.0))
    kept = np.arange(like.shape[1])
    if len(kept) > 1:
        cost = penalty * np.log(len(like) + 1.0)
        pi, best = _em(like, np.full(len(kept), 1 / len(kept)), rounds)
        best -= cost * len(kept)
        while len(kept) > 1:
            out = int(np.argmin(pi))
            fewer = np.delete(np.arange(len(kept)), out)
            got, now = _em(like[:, fewer], pi[fewer] / max(pi[fewer].sum(), 1e-12), rounds if len(fewer) > 1 else 0)
            now -= cost * len(fewer)
            if now < best:
                break
            kept, like, pi, best = kept[fewer], like[:, fewer], got, now
    else:
        pi = np.ones(1)
    out = np.zeros(loglike.shape[1])
    out[kept] = pi / pi.sum()
    return out


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, *keep)`` with lang_pred, score and the proportions as text; the model (a few MB) goes with the tasks."""
    import re

    langs, table = model["langs"], model["table"]
    rest = keep if keep is not None else []
    shared = docs.sparkSession.sparkContext.broadcast(table)
    letter = re.compile(r"[^\W\d_]")
    plain = lambda c: c.cast(pa.string()) if pa.types.is_large_string(c.type) else c

    def run(batches):
        logp = shared.value
        for rb in text_slices(batches, limit=SLICE):
            buf, off = text_bytes(rb.column("text"))
            ids, owner, words = _features(buf, off)
            like = np.zeros((len(words), len(langs)), np.float64)
            for i, o in zip(ids, owner, strict=True):
                got = logp[i]
                for j in range(len(langs)):
                    like[:, j] += np.bincount(o, got[:, j], minlength=len(words))
            seen = ~_SKIP.astype(bool)[buf]
            letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(seen)])
            texts = rb.column("text")
            pred, score, mixture = [], [], []
            for k in range(rb.num_rows):
                a, b = int(words.first[k]), int(words.first[k + 1])
                some = a < b and langs and letters[off[k + 1]] > letters[off[k]]
                if some and not seen[off[k] : off[k + 1]][buf[off[k] : off[k + 1]] < 0x80].any():
                    some = letter.search(texts[k].as_py()) is not None
                if not some:
                    pred.append("und")
                    score.append(0.0)
                    mixture.append("")
                    continue
                pi = infer(like[a:b])
                best = int(np.argmax(pi))
                pred.append(langs[best])
                score.append(min(1.0, float(pi[best])))
                mixture.append(",".join(f"{langs[j]}:{pi[j]:.4f}" for j in np.argsort(-pi, kind="stable") if pi[j] > 0))
            yield pa.RecordBatch.from_arrays(
                [plain(rb.column(c)) for c in ["doc_id", *rest]] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())],
                ["doc_id", *rest, "lang_pred", "score", "mixture"],
            )

    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = schema(doc_id=kinds["doc_id"], **{c: kinds[c] for c in rest}, lang_pred=STR, score=DBL, mixture=STR)
    return docs.select("doc_id", *rest, *([] if "text" in rest else ["text"])).mapInArrow(run, out)
