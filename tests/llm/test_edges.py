"""Empty tables, clashing columns, very long texts, several languages: what the small tests of the operators do not reach."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import chat, langid, lmscore, substring, token_codes
from quillon.llm.base import crc32_of_id, save
from quillon.llm.queries import tokenizer_path
from quillon.llm.words import NOT_SPACE, Words, grams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_infer(loglike, penalty=3.0, rounds=8):
    """The mixture of one document, in loops over lists."""
    words = [[math.exp(max(x - max(row), -30.0)) for x in row] for row in loglike.tolist()]
    kept = list(range(loglike.shape[1]))

    def em(pi, rounds):
        for _ in range(rounds):
            new = [0.0] * len(kept)
            for row in words:
                total = sum(row[k] * p for k, p in zip(kept, pi, strict=True))
                for i, k in enumerate(kept):
                    new[i] += row[k] * pi[i] / total / len(words)
            pi = new
        return pi, sum(math.log(sum(row[k] * p for k, p in zip(kept, pi, strict=True))) for row in words)

    cost = penalty * math.log(len(words) + 1)
    pi, best = em([1 / len(kept)] * len(kept), rounds)
    best -= cost * len(kept)
    while len(kept) > 1:
        out = pi.index(min(pi))
        before, kept = kept, kept[:out] + kept[out + 1 :]
        rest = pi[:out] + pi[out + 1 :]
        got, now = em([p / max(sum(rest), 1e-12) for p in rest], rounds if len(kept) > 1 else 0)
        now -= cost * len(kept)
        if now < best:
            kept = before
            break
        pi, best = got, now
    return {k: p / sum(pi) for k, p in zip(kept, pi, strict=True)}


def test_mixture_is_that_of_plain_expectation_maximisation():
    r = np.random.default_rng(5)
    for _ in range(40):
        n, k = int(r.integers(1, 60)), int(r.integers(2, 6))
        like = r.normal(0, 3, (n, k)) + 6 * np.eye(k)[r.choice(k, n, p=r.dirichlet(np.ones(k) * 0.5))]
        want, got = plain_infer(like), langid.infer(like)
        assert {i for i in range(k) if got[i] > 0} == set(want) and all(abs(got[i] - p) < 1e-9 for i, p in want.items())


def test_languages_held_out_and_mixed(spark):
    r = np.random.default_rng(6)
    letters = {"aa": "abcdeimno", "bb": "klmoprstu", "cc": "aeghiwxyz"}
    words = {k: ["".join(r.choice(list(v), r.integers(2, 8))) for _ in range(400)] for k, v in letters.items()}
    say = lambda k, n: " ".join(r.choice(words[k], n))
    rows = [(i, say(k, int(r.integers(20, 60))), k, None, 1) for i in range(300) for k in (list(words)[i % 3],)]
    rows += [(1000 + i, f"{say('aa', 60)} {say('bb', 40)}", None, None, 1) for i in range(10)] + [(2000, "12 3", "aa", None, 1), (2001, None, "bb", None, 1)]
    d = spark.createDataFrame([(*x, "k", 0.5) for x in rows], DOCS + ", lang_pred string, score double").withColumn("held", crc32_of_id() % 5 == 0)
    got = {x.doc_id: x for x in langid.identify(d.drop("lang_pred", "score"), langid.fit(d, ~d.held), ["held"]).collect()}
    held = [x for x in rows if x[0] < 300 and got[x[0]].held]
    assert len(held) > 30 and sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.98 * len(held)
    for i in range(1000, 1010):
        mix = dict(p.split(":") for p in got[i].mixture.split(","))
        assert set(mix) == {"aa", "bb"} and 0.45 < float(mix["aa"]) < 0.75
    assert got[2000].lang_pred == got[2001].lang_pred == "und"


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    assert langid.identify(d, langid.fit(d, crc32_of_id() % 5 != 0)).count() == 0
    m, counts = lmscore.fit(d, crc32_of_id() % 10 != 0, tokenizer_path(), steps=2)
    assert lmscore.score(d, crc32_of_id() % 10 != 0, m, counts).count() == 0
    c = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(c)).count() == 0
    one = spark.createDataFrame([(1, "only held out", None, None, 0)], DOCS)  # nothing to learn from
    m, counts = lmscore.fit(one, crc32_of_id() < 0, tokenizer_path(), steps=2)
    (x,) = lmscore.score(one, crc32_of_id() < 0, m, counts).collect()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (True, 4, 0, 0) and x.score < 0


def test_clashing_columns(spark):
    rows = [(i, f"some words to say {i} and some more of them", "en", "s", 1) for i in range(40)]
    names = "row, word, c, rare, lp, each, known, got, base, held_out, part, ids, start, a, b, did, mh, size, first, mark, no_id, conv, formatted".split(", ")
    d = spark.createDataFrame([(*x, *["k"] * len(names)) for x in rows], f"{DOCS}, {', '.join(f'{n} string' for n in names)}")
    train = crc32_of_id() % 10 != 0
    m, counts = lmscore.fit(d, train, tokenizer_path(), steps=2)
    assert lmscore.score(d, train, m, counts).count() == 40 and substring.remove_repeated(d).count() == 40
    folder, files = token_codes.write_codes(d, tokenizer_path(), 2)
    assert token_codes.read_digests(spark, folder, files).count() == 40
    c = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "yes", "x", "y"), (None, 0, None, None, "x", "y")], "conv_id long, turn long, role string, text string, formatted string, n_turns string")
    got = {x.conv_id: (x.n_turns, x.loss_chars) for x in chat.read_back(chat.format_turns(c)).collect()}
    assert got == {1: (2, 3), None: (1, 0)}


def test_turns_that_tie_go_by_role_and_text(spark):
    rows = [(7, 1, "user", "b"), (7, 1, "assistant", "z"), (7, 1, "user", "a"), (7, 0, None, "first")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = [x.formatted for x in chat.format_turns(c).coalesce(1).collect()]
    assert [next(chat.parse(x)) for x in lines] == [("", "first"), ("assistant", "z"), ("user", "a"), ("user", "b")]


@pytest.mark.parametrize("text", ["word and another " * 1_500_000, "x" * 24_000_000])
def test_words_of_a_very_long_text_take_little_more_than_it(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(raw)], np.int64)
    Words(raw[:100], np.array([0, 100]), NOT_SPACE).hashes()  # tables of powers are there already
    tracemalloc.start()
    w = Words(raw, off, NOT_SPACE)
    h = w.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(raw) + (100 << 20)
    few = text[:100_000].rsplit(" ", 1)[0].encode()
    if len(w) > 1:
        small = Words(np.frombuffer(few, np.uint8), np.array([0, len(few)]), NOT_SPACE).hashes()
        assert (h[: len(small)] == small).all() and (grams(h, 3)[:1000] == grams(small, 3)[:1000]).all()


def test_a_very_long_document_is_removed_word_by_word(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, "other " + long[: len(long) // 2]), (3, "x")]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(rows[1][1].split())
    whole = rows[1][1].split()[-1] == f"w{n - 2}"
    assert got[1] == (300_000, 0) and got[3] == (1, 0) and got[2] == (n, n - 1 if whole else n - 2)


def test_the_net_learns_from_every_window(spark):
    texts = [*(f"w{i} " * (i % 90) for i in range(120)), "long words " * 30_000]
    d, train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crc32_of_id() % 10 != 0
    learns = [r.text for r in d.where(train).where(~lmscore._held()).select("text").collect()]
    sub = lmscore.Subwords(tokenizer_path())
    every = sum(-(-(len(sub.flat(t.split())[0]) + 1) // lmscore.S) for t in learns)
    m, _ = lmscore.fit(d, train, tokenizer_path(), steps=2)
    assert len(texts[-1].split()) in [len(t.split()) for t in learns] and m.windows == every


@pytest.mark.parametrize("end", [100_514, 400_000])
def test_windows_are_packed_and_read_back(end):
    r = np.random.default_rng(8)
    for n in [*range(12), 5000]:
        rows = r.integers(-2, end + 1, (n, lmscore.T + 1)).astype(np.int32)
        rows[:1, :3] = lmscore.PAD, lmscore.BEGIN, end
        assert (got := lmscore.unpacked(lmscore.packed(rows))).shape == rows.shape and (got == rows).all()


@pytest.mark.parametrize("bias", [0.0, 500.0, -500.0])
def test_gradients_of_classes_far_from_zero(bias):
    r = np.random.default_rng(9)
    net = lmscore.Attention(50)
    ids, target, use = r.integers(0, 50, (3, lmscore.T)), r.integers(0, lmscore.CLASSES, (3, lmscore.S)), np.ones((3, lmscore.S), bool)
    loss, g = net.gradients(ids, target, use)
    net.p["bo"] += np.float32(bias)  # all classes alike: nothing else changes
    far, h = net.gradients(ids, target, use)
    assert abs(far - loss) < 1e-3 and all(np.allclose(g[k], h[k], atol=1e-4) for k in g)


def test_scratch_tables_of_large_rows_need_no_large_direct_buffers(spark):
    def large(batches):
        for rb in batches:
            for _ in range(0, 30 * rb.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(1).bytes(1 << 20)], pa.binary())], ["x"])

    jvm = spark.sparkContext._jvm
    pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    direct = lambda: next(p.getMemoryUsed() for p in pools if p.getName() == "direct")
    jvm.System.gc()
    before = direct()
    saved = save(spark.range(1).coalesce(1).mapInArrow(large, "x binary"), "large")
    assert direct() - before < 30 << 20 and saved.count() == 30


def test_a_target_takes_the_exponentials_of_its_groups_only(monkeypatch):
    r, exp, seen = np.random.default_rng(10), np.exp, []
    net = lmscore.Attention(50)
    ids, target, use = r.integers(0, 50, (3, lmscore.T)), r.integers(0, lmscore.CLASSES, (3, lmscore.S)), np.ones((3, lmscore.S), bool)
    monkeypatch.setattr(lmscore.np, "exp", lambda x, *a, **k: seen.append(np.size(x)) or exp(x, *a, **k))
    net.log_class(ids, target)
    net.gradients(ids, target, use)
    monkeypatch.undo()
    assert sum(seen) <= 2 * target.size * (lmscore.T + lmscore.CLASSES // 2)
    assert np.allclose(sum(exp(net.log_class(ids, np.full_like(target, c))) for c in range(lmscore.CLASSES)), 1, atol=1e-4)


@pytest.mark.parametrize("name", ["Wg", "bg", "Wo", "bo", "Wq", "Wk", "Wv"])
def test_gradients_of_groups_and_attention(name):
    r = np.random.default_rng(11)
    net = lmscore.Attention(50)
    ids, target, use = r.integers(0, 50, (3, lmscore.T)), r.integers(0, lmscore.CLASSES, (3, lmscore.S)), r.random((3, lmscore.S)) < 0.8
    _, g = net.gradients(ids, target, use)
    weights, ups = net.p[name], []
    k = np.unravel_index(int(np.abs(g[name]).argmax()), weights.shape)
    for step in (0.02, -0.04):
        weights[k] += np.float32(step)
        net.__dict__.pop("_projected", None)
        ups.append(-float(net.log_class(ids, target)[use].sum()) / use.sum())
    assert abs((ups[0] - ups[1]) / 0.04 - g[name][k]) < 0.02 * abs(g[name][k]) + 2e-4


def test_slices_share_the_table_of_frequent_words():
    m = lmscore.Model()
    m.subwords = type("Ends", (), {"end": 99})
    m.flat, m.size = np.arange(7, dtype=np.int32), np.array([3, 4], np.int32)
    for more, lens in (([50, 51, 52], [1, 2]), ([], []), ([60], [1]), (list(range(70, 90)), [5, 15])):
        flat, size, begin = m.joined(np.array(more, np.int64), np.array(lens, np.int64))
        n = 2 + len(lens) + 1
        assert [flat[b : b + s].tolist() for b, s in zip(begin[:n].tolist(), size[:n].tolist(), strict=True)] == [[0, 1, 2], [3, 4, 5, 6], *(x.tolist() for x in np.split(np.array(more, int), np.cumsum(lens)[:-1].astype(int)) if len(lens)), [99]]
    assert m.joined(np.zeros(1, int), np.ones(1, int))[0] is m.joined(np.zeros(2, int), np.ones(2, int))[0]
    assert "_room" not in m.__getstate__()
