"""The pipeline against what its stages say, on the small table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline


LETTER = re.compile(r"[^\W\d_]")


def brute_pipeline(docs, items):
    """{doc_id: times in the output} in plain Python, from {doc_id: (text, source)} and the benchmark's texts."""
    low = lambda t: t.translate({c: c + 32 for c in range(0x41, 0x5B)})
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    docs = {i: d for i, d in docs.items() if d[0] is not None and LETTER.search(d[0])}
    # near-duplicates
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(words(low(t))) for i, (t, _) in docs.items()}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    by = defaultdict(set)
    for i, x in sets.items():
        for g in x:
            by[g].add(i)
    for i, x in sets.items():
        for j, both in Counter(j for g in x for j in by[g] if j > i).items():
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    docs = {i: d for i, d in docs.items() if find(i) == i}
    # benchmark passages
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    grams = defaultdict(set)
    for t in items:
        w = plain(t)
        n = min(10, len(w))
        grams[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    hit = lambda w: any(tuple(w[k : k + n]) in g for n, g in grams.items() if n for k in range(len(w) - n + 1))
    docs = {i: d for i, d in docs.items() if not hit(plain(d[0]))}
    # reads: temperature with a limit of two
    n_tokens = {i: len(words(t)) for i, (t, _) in docs.items()}
    tokens = Counter()
    for i, (_, source) in docs.items():
        tokens[source or ""] += n_tokens[i]
    some = [t for t in tokens.values() if t]
    a = 1.0 if max(some) == min(some) else max(0.0, math.ceil((1 - math.log(2) / math.log(max(some) / min(some))) * 1e6 - 1e-7) / 1e6)
    weight = {k: t**a / sum(x**a for x in some) for k, t in tokens.items() if t}
    budget = max(tokens[k] / w for k, w in weight.items())
    out = Counter()
    for k in tokens:
        mine = [i for i, (_, source) in docs.items() if (source or "") == k]
        if not tokens[k]:
            out.update(mine)
            continue
        quota = max(tokens[k], math.floor(weight[k] * budget + 1e-6))
        for turn in range(quota // tokens[k]):
            out.update(mine)
        turn, left = quota // tokens[k], quota % tokens[k]
        for i in sorted(mine, key=lambda i: (hashlib.md5(f"{turn}|{i}".encode()).hexdigest(), i)):
            if left > 0:
                out[i] += 1
            left -= n_tokens[i]
    return out


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).toPandas()
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert Counter(out.doc_id) == brute_pipeline(docs, items)
    assert out.shard.between(0, 23).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_missing_labels_are_filled_and_the_mix_is_in_order(spark, tmp_path):
    text = {"en": "the cat and the dog sat on the mat with the other cats", "de": "der hund und die katze liegen auf der matte mit den anderen"}
    rows = [(i, f"{text[k]} {i}", k if i % 9 else None, "a" if i % 4 else "b", 1) for i in range(120) for k in ("en" if i % 2 else "de",)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    got = {r.doc_id: r.lang for r in steps["language_id"](spark, d, "").collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(120)}
    mixed = [r.source for r in steps["mix"](spark, d, "").collect()]
    assert mixed.count("a") == 90 and 30 < mixed.count("b") <= 60
    half = mixed[: len(mixed) // 2]  # the sources are spread over it
    assert abs(half.count("b") - mixed.count("b") / 2) <= 3
    for name in ("language_id", "near_dedup", "mix", "shard"):
        assert steps[name](spark, d.limit(0), "").count() == 0


def test_stages_with_repeated_and_missing_ids(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(14))
    plain = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, plain[0], "en", "s"), (1, plain[0], "en", "s"), (2, plain[1], None, None), (None, plain[2], "en", "s"), (3, plain[3] + " " + item, "en", "s"), (4, None, "en", "s"), (None, None, None, None)]
    d = spark.createDataFrame([(*r, 1, 5, 6, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, reads int, copy int, hit_id string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert ids(steps["language_id"](spark, d, str(tmp_path))) == [0, 1, 1, 2, 3]
    assert ids(steps["near_dedup"](spark, d, str(tmp_path))) == [0, 0, 1, 1, 2, 3, 4]
    assert ids(steps["decontaminate"](spark, d, str(tmp_path))) == [0, 0, 1, 1, 2, 4]
    mixed = ids(steps["mix"](spark, d, str(tmp_path)))
    assert set(mixed) == {0, 1, 2, 3, 4} and mixed.count(1) == 2 and mixed.count(2) == 2 and mixed.count(0) >= 2
    assert len(ids(steps["shard"](spark, d, str(tmp_path)))) == len(rows)


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(14))
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    rows = [(None, a), (None, a), (None, a + " more"), (None, "x " + item), (None, e), (5, b), (5, c), (5, "y " + item), (4, b + " more"), (6, None), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    got = lambda name: sorted(((r.doc_id or 0), r.text or "") for r in steps[name](spark, d, str(tmp_path)).collect())
    assert got("decontaminate") == sorted(((i or 0), t or "") for i, t in rows if item not in (t or ""))
    near = got("near_dedup")
    assert len(near) == 7 and sum(t.startswith("a0") for _, t in near) == 1
    assert (4, b + " more") in near and (5, b) not in near and (5, c) in near and (5, "y " + item) in near and (0, "x " + item) not in near and (0, e) in near
