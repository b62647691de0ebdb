"""The combined automaton beside one regex after another."""

import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, awkward, empty

from orrery.llm.secret_scan import BASE, MORE, Automaton, Rule, secret_spans

RULES = (*BASE, *MORE)


@pytest.fixture(scope="module")
def automaton():
    return Automaton(RULES)


def plain(text, rules=RULES):
    data = (text or "").encode()
    found = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.pattern.encode(), data):
            if len(m["value"] if "value" in m.re.groupindex else m[0]) >= rule.least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def scanned(automaton, texts):
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = automaton.spans(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [found.get(i, []) for i in range(len(texts))]


def test_random_texts(automaton):
    rng = random.Random(1)
    parts = ["token", "PassWord", "passwd", "secret", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdef012345", "AKIA", "ABCD12345678901", "0123456789abcdef", "é😀", ".", "eyJ", "abc_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "x" * 36, "xoxb-", "-", "/", "\n", "z", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 12, 30]))) for _ in range(3000)]
    texts += ["x eyJ" + "a" * n + ".eyJ" + "b" * 15 + "." + rng.choice(["", "c-_" * 5, "eyJ.x"]) for n in range(0, 30, 3)]
    assert scanned(automaton, texts) == [plain(t) for t in texts]
    assert {i for t in texts for _, i, _ in plain(t)} == set(range(len(RULES)))


def test_matches_longer_than_lanes(automaton):
    texts = ["token" + " " * 5000 + "=" + " " * 4000 + "abcdefghijkl", "f" * 9000, "a" * 1023 + "g" + "b" * 1024, "secret=" + "A" * 20_000 + " AKIA" + "Z" * 3000, ("x" * 1019 + "AKIA" + "Q" * 14) * 3, "token=abc token=abcdefghijkl", "token=apikey: abcdefghijklm"]
    assert scanned(automaton, texts) == [plain(t) for t in texts]
    assert all(plain(t) for t in texts[:-1]) and not plain(texts[-1])


@pytest.mark.parametrize("pattern", ["a*", "ab|abcd", "abcd|c", r"\bab", "(?=a)b"])
def test_rules_that_need_more_than_one_pass(pattern):
    with pytest.raises(ValueError):
        Automaton((Rule("x", pattern),))


def test_other_rules():
    rules = (Rule("digits", "[^a-z ]{2,4}x?"), Rule("word", "(?i)be(?:e|at)+s{0,2}!"), Rule("any", "q.q"))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abetsq!X1 \nx") for _ in range(60)) for _ in range(200)]
    assert scanned(Automaton(rules[1:]), texts) == [plain(t, rules[1:]) for t in texts]
    with pytest.raises(ValueError):
        Automaton((Rule("x", "xy"),) * 17)


def test_awkward_rows(spark):
    more = spark.createDataFrame([(20, "é😀 token = 'abcdefghijklmn' and é " + "0a" * 20, "en", "a", 1), (20, "é😀 token = 'abcdefghijklmn' and é " + "0a" * 20, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = awkward(spark).unionByName(more, allowMissingColumns=True).selectExpr("*", "'x' as spans", "'y' as text_to_scan")
    found = secret_spans(docs, RULES, "doc_id", "text", "spans").collect()
    assert len(found) == len(AWKWARD) + 2 and found[0].__fields__ == ["doc_id", "text", "spans_", "spans"]
    for r in found:
        data = (r.text or "").encode()
        points = lambda b, data=data: len(data[:b].decode())
        assert [tuple(s) for s in r.spans] == [(RULES[i].kind, points(a), points(b)) for a, i, b in plain(r.text)]
    assert sum(len(r.spans) for r in found) == 4
    assert secret_spans(empty(spark), RULES, "doc_id").count() == 0
