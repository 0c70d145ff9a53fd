"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import chat, decontam, hnsw, kdshard, langid, lmscore, mixing, neardup, substring, token_codes
from quillon.llm.base import components, crc32_of_id
from quillon.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, size int, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, 5, 1, "k") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(4)
    words = [f"w{i}{'é' if i % 7 == 0 else ''}" for i in range(300)]
    out = [" ".join(r.choice(words, r.integers(3, 120))) for _ in range(60)]
    base = out[0] + " " + out[1]
    near = [" ".join(w if r.random() > 0.01 else "x" for w in base.split()) for _ in range(12)]
    return [*out, *near, base, base, None, "", "   \n ", "one", "One", "a a a a a a " * 30, "Long " + "z q " * 20000, out[3] + " " + out[4]]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())  # as the library gives it


def test_codes_random_access_and_round_trip(spark, texts, tmp_path, library):
    texts = [*texts, "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c <|endoftext|", "hello world <|endoftext|>\n", "plain hello world"]
    ids = np.random.default_rng(1).integers(0, 1 << 31, 3000).astype(np.uint32) >> np.random.default_rng(2).integers(0, 31, 3000).astype(np.uint32)
    c = token_codes.Codes(token_codes.to_blob([1, None], [ids[:1000], ids[1000:]]))
    assert (c.tokens() == ids).all() and (c.document(1) == ids[1000:]).all() and all(c.token(i) == ids[i] for i in range(0, 3000, 7)) and (c.tokens(500, 1500) == ids[500:1500]).all()
    folder, files = token_codes.write_codes(docs(spark, texts), tokenizer_path(), 2, shard_bytes=20_000, file_tokens=500)
    at, want = 0, {}
    for i, t in enumerate(texts):
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i], at = (at, len(x), zlib.crc32(x.tobytes())), at + len(x)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_codes.read_digests(spark, folder, files).collect()}
    assert got == want
    assert token_codes.write_codes(docs(spark, ["x"]).limit(0), tokenizer_path(), 2)[1] == []


def test_codes_of_a_slice_without_new_pieces(library):
    enc = token_codes.PieceEncoder(tokenizer_path())
    for texts in (["a b", ""], ["a b", "", " \n"], ["", "  "], [" \n"]):
        raw = [t.encode() for t in texts]
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in raw])])
        ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), off, 2)
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.dtype == enc.kind and ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]


def test_langid(spark, texts):
    d = docs(spark, [*texts, "123 45", "der und die das ist nicht"])
    model = langid.fit(d, crc32_of_id() % 5 != 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, model).collect()}
    assert len(got) == len(texts) + 2 and got[len(texts)] == ("und", 0.0) and got[0][0] == "en"
    assert all(langid.identify(d, {"langs": [], "table": np.zeros((2 * langid.SIZE, 0), np.float32)}).toPandas().lang_pred == "und")


def test_lm_base_counts_are_exact(spark, texts):
    d, train = docs(spark, texts), crc32_of_id() % 10 != 0
    m, counts = lmscore.fit(d, train, tokenizer_path(), frequent=50, steps=20)
    rows = {r.doc_id: r for r in lmscore.score(d, train, m, counts).collect()}
    words = [lmscore._lower(t or "").split() for t in texts]
    learn = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in learn for w in [*words[i], None])
    n = sum(c.values())
    for i, w in enumerate(words):
        want = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in [*w, None])
        assert rows[i].n_tokens == len(w) + 1 and rows[i].n_known == sum(c[x] > 0 for x in [*w, None]) and rows[i].train_tokens == n
        assert abs(rows[i].base_score - want) < 1e-6 * abs(want) and rows[i].score < 0


def test_lm_learns_from_every_training_document(spark, texts):
    d, train = docs(spark, [*texts, *(f"{w} " * 60_000 for w in ("deep", "long", "wide"))]), crc32_of_id() % 10 != 0
    every = [lmscore._lower(r.text or "").split() for r in d.where(train).collect()]
    got = [lmscore.fit(d, train, tokenizer_path(), sample_bytes=b, frequent=f, steps=5)[0] for b, f in ((1, 50), (2_000_000, 1_000_000))]
    sub = lmscore.Subwords(tokenizer_path())
    streams = [np.concatenate([sub.flat(w)[0], [sub.end]]).astype(int) for w in every]
    n = np.bincount(np.concatenate(streams), minlength=sub.end + 1)
    learns = [len(lmscore._lower(r.text or "").split()) for r in d.where(train).where(~lmscore._held()).collect()]
    assert len(learns) < len(every) and max(learns) == 60_000
    for m in got:  # whatever sample_bytes and frequent are
        weight = n + 0.05
        assert np.allclose(m.share, np.log(weight / np.bincount(m.kind, weight, minlength=lmscore.CLASSES)[m.kind]))
        assert m.mass.sum() == sum(len(w) + 1 for w in every)
        all_windows = sum(-(-len(s) // lmscore.S) for s, h in zip(streams, d.where(train).select(lmscore._held().alias("h")).collect(), strict=True) if not h.h)
        assert 0 <= lmscore.STRIDE * m.windows - all_windows < lmscore.STRIDE * 8  # one in STRIDE of each task
        held = [len(s) for s in streams]
        assert m.windows > 0.9 * sum(-(-k // lmscore.S) for k in held if k > 60_000) / lmscore.STRIDE
    assert abs(got[0].weight - got[1].weight) < 0.05


def test_subwords_of_many_words_are_those_of_each(library):
    words = ["a", "hello", "x<|endoftext|>y", "<|endoftext|>", "\u00a0b", "c\u00a0", "\u3000", "don't", "12ab", "...", "é", "日本語", "a\u2003b", "Ġ", "\u0120x", "tail."] * 30
    sub = lmscore.Subwords(tokenizer_path())
    flat, size = sub.flat(words, together=7)
    want = [library.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert size.tolist() == [len(x) for x in want] and (flat // 2).tolist() == sum(want, []) and (flat % 2).sum() == len(words)
    assert [len(x) for x in sub.flat([])] == [0, 0]


def test_lm_probabilities_add_up_and_each_symbol_is_scored_once(spark, texts):
    d, train = docs(spark, texts), crc32_of_id() % 10 != 0
    m, _ = lmscore.fit(d, train, tokenizer_path(), steps=20)
    r = np.random.default_rng(7)
    n_doc = np.array([1, 39, 40, 41, 200, 3])
    sym = r.choice(np.flatnonzero(m.counts), n_doc.sum())
    doc, at = lmscore.windows(n_doc)
    rows, place = lmscore.frames(sym, n_doc, doc, at)
    ids, target, ok = m.inputs(rows)
    assert sorted(place[ok].tolist()) == list(range(len(sym))) and (m.kind[sym[place[ok]]] == target[ok]).all()
    total = sum(np.exp(m.net.log_class(ids, np.full_like(target, c)))[ok] for c in range(lmscore.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    seen = np.bincount(m.kind, minlength=lmscore.CLASSES) > 0
    assert np.allclose(np.bincount(m.kind, np.exp(m.share), minlength=lmscore.CLASSES)[seen], 1)
    # what comes later, or in another document, changes nothing
    a, b = m.log_symbols(sym, n_doc), m.log_symbols(np.concatenate([sym[:120], r.permutation(sym[120:])]), n_doc)
    assert np.allclose(a[:120], b[:120], atol=1e-5)
    # the gradients are those of the scores
    few, want, use = ids[:2], target[:2], ok[:2]

    def loss():
        m.net.__dict__.pop("_projected", None)
        return -float(m.net.log_class(few, want)[use].sum()) / use.sum()

    got, g = m.net.gradients(few, want, use)
    assert abs(got - loss()) < 1e-3
    for name, k in (("E", (int(few[0, -1]), 3)), ("Wq", (1, 2)), ("Wk", (3, 0)), ("Wv", (2, 5)), ("P", (20, 1)), ("W1", (4, 4)), ("b1", (3,)), ("Wo", (5, int(want[0, 0]))), ("bo", (int(want[0, 0]),))):
        old, step = m.net.p[name][k], np.float32(0.02)
        m.net.p[name][k] = old + step
        up = loss()
        m.net.p[name][k] = old - step
        down = loss()
        m.net.p[name][k] = old
        assert abs((up - down) / (2 * step) - g[name][k]) < 0.02 * abs(g[name][k]) + 2e-4, name


def test_chat_round_trip():
    for t in ("", "a", "\\", "###", "####", "</turn>", "\\### Assistant: </turn> ok", "\n### User: x</turn>\n", "</turn", "\\\\n<#"):
        for role in ("user", "assistant", "", "Assistant", "a: b", "x\n#"):
            assert list(chat.parse(chat.render_turn(role, t))) == [(role, t)]


def test_mixing_limits_repeats(spark, texts):
    d = docs(spark, texts)
    rows = mixing.mix_sources(d, max_repeat=1.5, cover=True).collect()
    n = Counter(r.doc_id for r in rows)
    assert set(n) == set(range(len(texts))) and max(n.values()) <= 2
    places = sorted((r.source, r.place) for r in rows if r.n_tokens)
    assert len(set(places)) == len(places)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def brute_substring(texts, k):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                drop[s : s + k] = [True] * k
            seen.add(g)
        out[i] = (len(w), sum(drop), hashlib.sha256(b" ".join(x for x, y in zip(w, drop, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("least", [64, 0])
def test_substring(spark, texts, least, monkeypatch):
    monkeypatch.setattr(substring, "HOT_LEAST", least)  # 0: minimisers over the mean take the windows' way
    monkeypatch.setattr(substring, "SAMPLE", 1 if least == 0 else substring.SAMPLE)
    few = [t if t is None or len(t) < 20_000 else t[:3000] for t in texts]
    few += [f"{few[i]} {few[2]} {few[i + 1]}" for i in range(6)]
    d = docs(spark, few)
    if least == 0:
        assert len(substring.frequent_minimisers(substring.with_key(d), 20, 8))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeated(d, k=20).collect()}
    assert got == brute_substring(few, 20)
    assert substring.remove_repeated(d.limit(0)).count() == 0


def test_windows_of_one_fingerprint_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(substring, "grams", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    d, s = substring._later([b"a b c", b"x b c", b"a b c d", b"b c d"], np.array([1, 2, 3, 4]), np.array([0, 5, 7, 9]), 2)
    assert sorted(zip(d.tolist(), s.tolist(), strict=True)) == [(2, 6), (3, 7), (3, 8), (4, 9), (4, 10)]


def test_a_bucket_over_many_batches(spark):
    rows = [(1, 5, 10, 0, 2), (1, 5, 11, 0, 2), (1, 6, 9, 4, 1), (1, 6, 12, 4, 1), (1, 7, 13, 0, 3), (2, 1, 1, 0, 1), (3, 1, 1, 0, 1), (3, 1, 1, 0, 1), (4, 1, 5, 0, 1), (4, 2, 6, 0, 1), (5, 0, 7, 7, -2)]
    d = spark.createDataFrame(rows, "key1 long, key2 long, did long, start int, size int").coalesce(1)
    want = sorted([(None, 11, 0, 2), (None, 12, 4, 1), (1, 10, 0, 2), (1, 9, 4, 1), (1, 13, 0, 3), (4, 5, 0, 1), (4, 6, 0, 1), (None, 7, 7, 2)], key=str)
    for size in ("1", "2", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, substring.judged(d).collect()), key=str) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_of_repeated_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    low = -(1 << 63)
    rows = [(1, one), (1, one), (1, two), (1, None), (None, "z " + two), (2, one + " " + two), (low, "y " + two)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, did int, mark string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in substring.remove_repeated(d).collect())
    assert got == [(low, 31, 30), (0, 31, 0), (1, 0, 0), (1, 30, 0), (1, 30, 0), (1, 30, 30), (2, 60, 60)]


def test_hnsw_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[500:700] = x[500]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), __import__("pyspark").sql.functions.col("vec_id") % 100 == 0, shard_rows=400).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hit += len(set(want) & set(g.vec_id))
        assert len(g) == 10 and q < 900
    assert hit >= 0.9 * 90


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "copies", "far"])
def test_hnsw_recall_of_one_shard(kind):
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 48))
    if kind == "clusters":
        x = r.standard_normal((100, 48))[r.integers(0, 100, 3000)] * 10 + 0.1 * x
    if kind == "copies":
        x[500:2000] = x[r.integers(0, 40, 1500)]
    if kind == "far":
        x += 500
    x = x.astype(np.float32)
    g = hnsw.build(np.arange(3000), x)
    assert hnsw._reach(g["layers"][0]).all() and sorted(g["members"].tolist()) == list(range(3000))
    found, begins, hit = hnsw.search(g, x[::30]), np.concatenate([[0], g["ends"][:-1]]), 0
    for i, q in enumerate(range(0, 3000, 30)):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        best = np.sort(np.delete(d, q))[:10]
        got = np.concatenate([hnsw._others(g["members"][begins[j] : g["ends"][j]], q, 10) for j in found[i][found[i] >= 0]])
        hit += (np.sort(d[got])[:10] <= best * (1 + 1e-9)).sum()
    assert hit >= 0.9 * 1000


def test_hnsw_scores_doubles_as_given(spark):
    rows = [(i, [1.0 + i * 1e-12, 2.0]) for i in range(30)]
    got = hnsw.nearest(spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, shard string, ask int"), __import__("pyspark").sql.functions.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 11)]
    assert all(r.score == abs(rows[r.vec_id][1][0] - 1.0) for r in got)
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), __import__("pyspark").sql.functions.col("vec_id") == 0).count() == 0


def test_hnsw_of_repeated_query_rows(spark):
    rows = [(0, [1.0, 0.0])] * 14 + [(0, [0.0, 5.0])] + [(i, [1.0, 0.0]) for i in range(1, 13)] + [(20 + i, [0.0, 5.0 + i]) for i in range(12)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), __import__("pyspark").sql.functions.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == sorted([(i, i) for i in range(1, 11)] + list(enumerate([*range(20, 26), 1, 2, 3, 4], 1)))


def test_near_duplicates(spark, texts):
    few = [t if t is None or len(t) < 20_000 else t[:3000] for t in texts]

    def shingles(t):
        w = lmscore._lower(t or "").split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    s = [shingles(t) for t in few]
    comp = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, few), 4, 80).collect()}
    assert got == {i: (len(s[i]), comp[i], comp[i] == i) for i in range(len(s))}


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    base, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, base), (2, other), (2, base + " one"), (3, base), (None, other + " two"), (None, "x y z"), (None, "x y z"), (None, None), (4, ""), (4, base), (1, base)]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rep string")
    got = sorted(((r.doc_id or 0), (r.component_id or 0), r.n_shingles, r.kept) for r in neardup.near_duplicates(d, 4, 80).collect())
    assert got == sorted([(1, 1, 57, True), (1, 1, 57, True), (2, 2, 57, True), (2, 1, 58, False), (3, 1, 57, False), (0, 2, 58, False), (0, 0, 1, True), (0, 0, 1, False), (0, 0, 0, True), (4, 4, 0, True), (4, 1, 57, False)])
    assert neardup.near_duplicates(d.limit(0), 4, 80).count() == 0


def test_decontamination(spark, texts):
    items = spark.createDataFrame([(0, texts[5]), (1, None), (2, ""), (3, "ONE."), (10, texts[6]), (11, texts[6])], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), items).collect()}
    assert got[5].contaminated and got[5].n_hit == got[5].n_words and got[6].n_items == 2 and got[texts.index("one")].n_hit == 1 and not got[texts.index(None)].contaminated
    assert {k: v.n_hit for k, v in got.items()} == {r.doc_id: r.n_hit for r in decontam.contamination(docs(spark, texts), items, part_words=30).collect()}
    assert not any(r.contaminated for r in decontam.contamination(docs(spark, texts), items.limit(0)).collect())
    assert decontam.contamination(docs(spark, texts).limit(0), items).count() == 0


def test_decontamination_of_repeated_ids_in_parts(spark, texts):
    rows = [(1, texts[5]), (1, texts[6]), (None, texts[7]), (None, texts[8]), (None, texts[5]), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, texts[5]), (1, texts[8]), (2, texts[9])], "item_id long, text string")
    one, many = (sorted((r.doc_id or 0, *r[1:]) for r in decontam.contamination(d, items, part_words=n).collect()) for n in (1_000_000, 3))
    assert one == many and len(one) == len(rows) and [r[-1] for r in one].count(True) == 3


def test_decontamination_has_one_python_worker_a_task(spark, texts, monkeypatch):
    items = spark.createDataFrame([(0, texts[5]), (1, texts[8])], "item_id long, text string")
    plans, save = [], decontam.save
    monkeypatch.setattr(decontam, "save", lambda df, name, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df, name, **k))
    for part_words, stages in ((1_000_000, 1), (3, 3)):  # a stage for each part, and one that merges these
        decontam.contamination(docs(spark, texts), items, part_words)
        lines = [x for x in plans[-1].splitlines() if "Project" not in x]
        assert sum("MapInArrow" in x for x in lines) == stages and not any("MapInArrow" in a and "MapInArrow" in b for a, b in zip(lines, lines[1:], strict=False))


def test_proximity(spark):
    r = np.random.default_rng(2)
    words = [[f"w{i}" for i in r.integers(0, 12, n)] for n in (40, 25, 3, 60)]
    items = [["w1", "w2", "w3"], ["w4", "w4"], ["w0", "nowhere"]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)], "item_id long, text string, block string")
    got = {x.doc_id: x for x in decontam.proximity(d, b, 2).collect()}
    total = Counter(w for x in words for w in x)
    for i, w in enumerate(words):
        places, n = set(), set()
        for k, item in enumerate(items):
            if all(total[x] for x in item):
                rare = min(item, key=lambda x: total[x])
                hit = [p for p, x in enumerate(w) if x == rare and all(y in w[max(0, p - 2) : p + 3] for y in item)]
                places |= set(hit)
                n |= {k} if hit else set()
        assert (got[i].n_hit, got[i].n_items) == (len(places), len(n))


def test_kd_shards(spark, texts):
    rows = kdshard.sharded(docs(spark, texts * 6), 4).toPandas()
    assert len(rows) == 6 * len(texts)
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert kdshard.sharded(docs(spark, ["x"]).limit(0), 4).count() == 0
    few = kdshard.sharded(docs(spark, ["x" * 5000, None, "", "same", "same", "y" * 9000]), 24).toPandas()  # shards without rows
    assert sorted(few.doc_id) == list(range(6)) and few.shard.between(0, 23).all()
    even = kdshard.sharded(docs(spark, [f"text {i}" for i in range(400)]), 8).toPandas().groupby("shard")["size"].sum()
    assert len(even) == 8 and even.max() <= 1.05 * even.mean()
    one = kdshard.sharded(docs(spark, texts), 1).toPandas()
    assert set(one.shard) == {0} and sorted(one.slot) == list(range(len(texts)))


def brute_shards(rows, shards):
    """Plain recursion over (size, crc, source, lang): cuts at the key whose weight to the left is nearest to the share."""
    import math

    low = {}
    for size, crc, source, lang in rows:
        g = low.setdefault((size, crc), [source, lang])
        g[0], g[1] = min(g[0], source), min(g[1], lang)
    keys = [tuple((v << 32) + crc for v in (min((1 << 20) - 1, math.floor(math.log2(size) * 32_000)), *low[size, crc])) for size, crc, _, _ in rows]
    span = [max(1, max(k[d] for k in keys) - min(k[d] for k in keys)) for d in range(3)]
    names, out = kdshard.DIMS, [0] * len(rows)

    def cut(mine, first, n):
        if n == 1 or not mine:
            for i in mine:
                out[i] = first
            return
        d = max(range(3), key=lambda d: ((max(keys[i][d] for i in mine) - min(keys[i][d] for i in mine)) / span[d], names[d]))
        target, upto, at = sum(rows[i][0] for i in mine) * (n // 2) / n, 0, None
        for k in sorted({keys[i][d] for i in mine}):
            w = sum(rows[i][0] for i in mine if keys[i][d] == k)
            if upto + w >= target:
                at = k + 1 if abs(upto + w - target) < abs(upto - target) else k
                break
            upto += w
        cut([i for i in mine if keys[i][d] < at], first, n // 2)
        cut([i for i in mine if keys[i][d] >= at], first + n // 2, n - n // 2)

    cut(list(range(len(rows))), 0, shards)
    return out


def test_kd_shards_are_those_of_plain_medians(spark):
    r = np.random.default_rng(11)
    texts = ["x" * int(n) + str(i) for i, n in enumerate(r.integers(10, 3000, 500))]
    texts[100:140] = [texts[i] for i in range(40)]  # equal texts
    d = docs(spark, texts)
    got = {x.doc_id: x for x in kdshard.kd_shards(d, 6, tolerance=0.0, whole=0.1).collect()}
    word = {v: int(x) for v, x in d.selectExpr("source", "shiftrightunsigned(xxhash64(coalesce(source, '\\0')), 44) as s").distinct().collect()}
    langs = {v: int(x) for v, x in d.selectExpr("lang", "shiftrightunsigned(xxhash64(coalesce(lang, '\\0')), 44) as s").distinct().collect()}
    rows = [(len(t) + 8, zlib.crc32(t.encode()), word["s" if i % 3 else None], langs["en" if i % 2 else None]) for i, t in enumerate(texts)]
    assert [got[i].shard for i in range(500)] == brute_shards(rows, 6)
    assert all(got[i].shard == got[100 + i].shard for i in range(40))


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(e, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
