import random

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, words

from orrery.llm import text as T


def spans(texts, f=T.words):
    out = []
    for at, to, data, offsets in T.chunks(pa.array(texts)):
        starts, stops, counts = f(data, offsets)
        found = [bytes(data[a:b]) for a, b in zip(starts, stops, strict=True)]
        ends = np.cumsum(counts)
        out += [found[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        assert to - at == len(counts)
    return out


def test_words_of_each_row():
    texts = [r[1] for r in AWKWARD] + ["a", "", "b c", None, "d"]
    assert spans(texts) == [words(t) for t in texts]
    assert spans(texts[3:7]) == [words(t) for t in texts[3:7]] and spans([]) == []
    sliced = pa.array(["x y", "z", None, "w"]).slice(1)
    assert [len(T.words(d, o)[0]) for _, _, d, o in T.chunks(sliced)] == [2]


def test_runs_of_letters_and_signs():
    assert spans(["ab,cd!! é9", "", "##"], T.class_runs) == [[b"ab", b",", b"cd", b"!!", "é9".encode()], [], [b"##"]]


def test_hashes_are_of_the_words():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abÄ9.") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(300)]
    seen = {}
    for at, to, data, offsets in T.chunks(pa.array(texts)):
        starts, stops, _ = T.words(data, offsets)
        for a, b, h in zip(starts, stops, T.word_hashes(data, starts, stops).tolist(), strict=True):
            assert seen.setdefault(bytes(data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) > 300


def test_shingles():
    texts = ["a b c d e", "a b c d", "b c d e", "a b", "a b", "b a", "", "A b c D"]
    found = []
    for at, to, data, offsets in T.chunks(pa.array(texts)):
        starts, stops, counts = T.words(data, offsets)
        values, rows = T.shingle_hashes(T.word_hashes(data, starts, stops, lower=True), counts, 4)
        found += [set(values[rows == i].tolist()) for i in range(to - at)]
    assert found[0] == found[1] | found[2] and len(found[0]) == 2
    assert found[3] == found[4] != found[5] and found[6] == set() and found[7] == found[1] and len(found[3]) == 1
