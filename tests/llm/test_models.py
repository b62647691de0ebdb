import hashlib
import math
import os
import random
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty, words

from orrery.llm import kneser_ney as K
from orrery.llm import quality as Q


#: Sizes at which everything is split.
SMALL = {"unit": 500, "per_bucket": 64, "text_per_bucket": 2048}


def corpus(spark, n=400):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = [vocabulary[int(r.random() ** 2 * 60)] for _ in range(r.randint(3, 40))]
        junk = i % 4 == 0
        rows.append((i, " ".join(x + "###" if junk and r.random() < 0.5 else x for x in w), 0 if junk else 1))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, label int")


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


def test_quality_on_held_out_rows(spark):
    rows, df = corpus(spark)
    labels = df.select("doc_id", "label")
    found = {r.doc_id: r for r in Q.quality_scores(df.drop("label"), labels).collect()}
    assert all(found[d].held_out == (fold(d) == 0) for d, _, _ in rows) and all(0 <= r.score <= 1 for r in found.values())
    held = [(found[d].score >= 0.3) == bool(y) for d, _, y in rows if fold(d) == 0]
    assert sum(held) / len(held) >= 0.9
    bent = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - label else label end as label")
    again = {r.doc_id: r.score for r in Q.quality_scores(df.drop("label"), bent).collect()}
    assert all(abs(again[d] - r.score) < 1e-12 for d, r in found.items())


def test_quality_of_awkward_rows(spark):
    _, df = corpus(spark)
    labels = df.select("doc_id", "label").unionByName(spark.createDataFrame([(None, 1), (3, None), (77777, 1)], "doc_id long, label int"))
    found = Q.quality_scores(awkward(spark).unionByName(df.drop("label"), allowMissingColumns=True), labels).collect()
    assert len(found) == 14 + 400 and all(0 <= r.score <= 1 for r in found)
    blank = {r.score for r in found if r.doc_id in (4, 5) and r.score not in {x.score for x in found if x.doc_id == 6}}
    assert len(blank) >= 1
    assert {r.score for r in Q.quality_scores(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(empty(spark), labels).count() == 0


def brute_scores(train, test, order):
    """The same model with dictionaries."""
    texts = [["<s>", *words(t, lower=True), "</s>"] for t in train]
    grams = {order: Counter(tuple(w[i : i + order]) for w in texts for i in range(len(w) - order + 1))}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
        if n > 1:
            grams[n].update(tuple(w[:n]) for w in texts if len(w) >= n)
    off, follow = {}, defaultdict(list)
    for n, found in grams.items():
        off[n] = K.discounts([sum(v == i for v in found.values()) for i in (1, 2, 3, 4)])
        for g, c in found.items():
            follow[g[:-1]].append(c)
    count = Counter(x for w in texts for x in w[1:])
    types, tokens = len(count), sum(count.values())
    out = []
    for t in test:
        w = ["<s>", *words(t, lower=True), "</s>"]
        score = base = 0.0
        for i in range(1, len(w)):
            p = 1 / (types + 1)
            for n in range(1, min(order, i + 1) + 1):
                g = tuple(w[i - n + 1 : i + 1])
                if after := follow.get(g[:-1]):
                    c = grams[n][g]
                    p = (max(0.0, c - off[n][min(c, 3)]) + sum(off[n][min(x, 3)] for x in after) * p) / sum(after)
            score += math.log10(p)
            base += math.log10((count[w[i]] + 0.5) / (tokens + 0.5 * (types + 1)))
        out.append((len(w) - 1, sum(count[b] > 0 for b in w[1:]), tokens, base, score))
    return out


@pytest.mark.parametrize(("order", "sizes"), [(2, {}), (3, {}), (2, SMALL), (3, SMALL), (4, SMALL)])
def test_language_model(spark, order, sizes):
    rows, df = corpus(spark)
    rows = [(d, t.title()) for d, t, _ in rows] + [(1000, None), (1001, " "), (1002, "unseen words here")]
    rows += [(1100 + i, " ".join(["again"] * (20 + i)) + f" and w{i} w{i + 1}") for i in range(30)]
    found = {r.doc_id: r for r in K.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order, **sizes).collect()}
    want = brute_scores([t for d, t in rows if fold(d) != 1], [t for _, t in rows], order)
    for (d, _), w in zip(rows, want, strict=True):
        r = found[d]
        assert r.held_out == (fold(d) == 1) and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_language_model_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two, three = (K.language_model_scores(docs, order=n).where("held_out").selectExpr("sum(score) as score", "sum(base_score) as base").first() for n in (2, 3))
    assert three.score > 0.9 * three.base and three.score > two.score


def test_few_files_are_open_at_once(spark, monkeypatch):
    _, df = corpus(spark)
    model = K.fit(df, unit=500, per_bucket=64, text_per_bucket=2048)
    _, _, tokens, counts = next(K._tokens(pa.array([r.text for r in df.collect()])))
    want = model.score(tokens, counts)[2]
    monkeypatch.setattr(K, "OPEN", 3)
    model.store._open.clear()
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = len(os.listdir("/proc/self/fd"))
    assert len(os.listdir(model.store.uri.removeprefix("file:"))) > 40
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (used + 12, hard))
        assert (model.score(tokens, counts)[2] == want).all() and len(model.store._open) <= 3
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
        model.store.delete()


def test_files_are_put_in_place_once(tmp_path):
    store = K.Store(str(tmp_path))
    store.write_arrays("a", np.arange(5, dtype=np.uint64), np.arange(3, dtype=np.uint32), np.empty(0, np.uint64))
    store.write_arrays("a", np.arange(5, dtype=np.uint64), np.arange(3, dtype=np.uint32), np.empty(0, np.uint64))
    assert [x.tolist() for x in store.arrays("a")] == [[0, 1, 2, 3, 4], [0, 1, 2], []] and os.listdir(tmp_path) == ["a"] and store.arrays("b") == []


@pytest.mark.parametrize(("n", "low"), [(1, 30), (7, 32), (5000, 30), (5000, 32)])
def test_shelf(n, low):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, 2 * n, np.uint64))
    own, other = np.sort(keys[::2]), keys[1::2]
    width, begin, bits = K.shelf(own, low)
    bits = bits << np.uint32(32 - low)
    at, there = K.on_shelf(width, begin, bits, own, low)
    assert there.all() and at.tolist() == list(range(len(own))) and not K.on_shelf(width, begin, bits, other, low)[1].any()


def test_language_model_of_awkward_rows(spark):
    found = K.language_model_scores(awkward(spark)).collect()
    assert len(found) == 14 and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in found)
    assert K.language_model_scores(empty(spark)).count() == 0
    one = K.language_model_scores(spark.createDataFrame([(2, "a b")], "doc_id long, text string")).first()
    assert one.train_tokens == (0 if one.held_out else 3)


def test_probabilities_add_up(spark):
    _, df = corpus(spark, 60)
    model = K.fit(df)
    known = sorted({w for r in df.collect() for w in r.text.lower().split()})
    for before in ("w1", "nothing"):
        texts = [f"{before} {w}" for w in [*known, "unknown"]] + [before]
        p = 0.0
        for _, _, tokens, counts in K._tokens(pa.array(texts)):
            scores = model.score(tokens, counts)[2]
            ends = np.cumsum(counts)
            p += (10 ** scores[ends[:-1] - 2]).sum() + 10 ** scores[ends[-1] - 1]
        assert p == pytest.approx(1, abs=1e-9)
    model.store.delete()


def plain_ftrl(examples):
    """Weights from dictionaries, one feature after another."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= Q.L1 else ((1 if zi > 0 else -1) * Q.L1 - zi) / ((Q.BETA + math.sqrt(n.get(i, 0.0))) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for label, features in examples:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
            for i, x in features.items():
                g = (p - label) * x
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / Q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight, set(z)


def test_quality_beside_plain_ftrl(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["good", "bad", "word", "!!", "x1,y2", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    docs += [(3, "another text of one id"), (5, docs[5][1]), (None, "no id")]
    labels = [(i, i % 2) for i in range(0, 80, 2)] + [(1, 1), (3, 0), (3, 1), (3, 1), (7, None), (None, 1)]
    weights = Q.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"))

    def features(text):
        ((_, _, found, _, n),) = Q._features(pa.array([text]))
        count = Counter(found.tolist())
        return {i: c / math.sqrt(max(1, int(n[0]))) for i, c in count.items()} | {1 << Q.BITS: 1.0}

    examples = {}
    for i, text in docs:
        for j, label in labels:
            if i == j and i is not None and label is not None:
                spread = hashlib.md5(f"quality:{i}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
                examples[spread, label] = (label, features(text))
    weight, seen = plain_ftrl([examples[k] for k in sorted(examples)])
    assert len(examples) == 45 and all(abs(weights[i] - weight(i)) < 1e-9 for i in seen)
    assert all(weights[i] == 0 for i in range(len(weights)) if i not in seen)


def test_examples_of_one_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART", 100)
    seen = []
    docs = spark.range(2000).selectExpr("7L as doc_id", "concat('text ', id) as text")
    labels = spark.range(10_000).selectExpr("7L as doc_id", "cast(id % 2 as int) as label")
    real = Q.np.average
    monkeypatch.setattr(Q.np, "average", lambda x, axis, weights: seen.extend(weights) or real(x, axis=axis, weights=weights))
    Q.fit(docs, labels, sample=400)
    assert 300 <= sum(seen) <= 500 and len(seen) == 4 and max(seen) <= 150
