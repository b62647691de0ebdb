import random

import numpy as np
import pytest
from helpers import awkward, empty, words
from pyspark.sql import functions as F

from orrery.llm import ngram_join as N
from orrery.llm.components import components


def brute(rows, k, num, den):
    """doc_id -> (number of shingles, least id that links reach)."""
    sets = []
    for _, text in rows:
        w = words(text, lower=True)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = top(i), top(j)
                above[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    common = [word() for _ in range(14)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            w = r.choice(texts[:6] if kind < 0.35 else texts).split()
            for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
        else:
            w = [word() for _ in range(r.choice((1, 3, 5, 20, 60, 90)))]
            if r.random() < 0.4:
                w = common + w
        texts.append(" ".join(w) or "x")
        rows.append((i, texts[-1]))
    return rows + [(n, None), (n + 1, " ")]


@pytest.mark.parametrize(("seed", "k", "num", "den", "common", "block"), [(1, 4, 85, 100, 64, 4096), (2, 4, 85, 100, 3, 7), (3, 5, 4, 5, 8, 16), (4, 2, 1, 2, 3, 5)])
def test_same_as_brute_force(spark, monkeypatch, seed, k, num, den, common, block):
    monkeypatch.setattr(N, "COMMON", common)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "UNIT", 2000)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = N.ngram_jaccard_join(df, k=k, num=num, den=den).select("doc_id", "n_shingles", "component_id")
    want = brute(rows, k, num, den)
    assert sorted(map(tuple, found.collect())) == want
    assert len({x[2] for x in want}) < len(want) - 20


def test_awkward_rows(spark):
    found = N.ngram_jaccard_join(awkward(spark), k=4, num=85, den=100).collect()
    of = {}
    for r in found:
        of.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert of[1] == of[2] == [(9, 1)] and of[3] == [(0, 3)] and of[4] == [(0, 4)] and of[5] == [(0, 5)]
    assert of[6] == of[7] == [(1, 6)] and of[10] == [(4, 10)] * 2 and sorted(of[9]) == [(1, 9), (2, 9)] and of[None] == [(3, None)]
    assert N.ngram_jaccard_join(empty(spark)).count() == 0


def test_prefix_matches():
    levels = np.array([2, 2, 2, 64, 64])
    matches, held = N.prefix_matches(100, 10, levels, 4, 5)
    assert 1 <= matches <= N.MOST_MATCHES and held == min(5, 20 - 10 + matches)


@pytest.mark.parametrize(("k", "num", "den", "linked"), [(4, 85, 100, 101), (5, 4, 5, 202)])
def test_short_texts_with_common_shingles(spark, k, num, den, linked):
    texts = [f"{c}1 {c}2 {c}3 {c}4 {c}5 {c}6 {c}7 {c}8" for c in "ab"]
    texts[1] += " b9"
    rows = [(1000 * i + j, f"{t} w{j}" if j else t) for i, t in enumerate(texts) for j in range(101)]
    found = N.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den)
    want = brute(rows, k, num, den)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == want
    assert sum(x[2] in (0, 1000) for x in want) == linked + (linked == 101)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2)])
def test_no_more_matches_than_a_similar_set_has(num, den):
    for n in range(1, 30):
        for single in range(n - -(-n * num // den) + 1):
            matches, held = N.prefix_matches(n, single, np.full(n - single, 64), num, den)
            assert 1 <= matches <= held <= n - single and matches <= -(-n * num // den)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        above[y] = x
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.root for x in found.collect()} == {x: top(x) for x in above}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0
