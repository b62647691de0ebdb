"""The trie of conversations and their repair beside plain versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest

from orrery.llm import conversation_repair as R
from orrery.llm import conversation_trie as C

COLUMNS = "conv_id long, turn long, role string, text string, here boolean"


def plain_trie(rows):
    """All nodes from dictionaries over whole sequences."""
    by = defaultdict(list)
    for conv, turn, role, text, here in rows:
        if conv is not None:
            by[conv] += [(turn is not None, turn or 0, role or "", text or "")] if here in (None, True) else []
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(by):
        turns = tuple((r, t) for _, _, r, t in sorted(by[conv]))
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ids = ",".join(map(str, ends.get(node, [])))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), kids(node), sum(not kids(x) for x in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def same(df, want):
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, df.collect())) == order(want)


@pytest.mark.parametrize(("turns", "neighbours"), [(1 << 17, 64), (9, 2), (30, 3)])
def test_trie_over_many_shards(spark, monkeypatch, turns, neighbours):
    monkeypatch.setattr(C, "SHARD_TURNS", turns)
    monkeypatch.setattr(C, "NEIGHBOURS", neighbours)
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        length = rng.choice([0, 1, 2, 3, 5])
        rows.append((conv, None, "", "", False))
        rows += [(conv, i, rng.choice(["user", "bot"]), "x" * rng.choice([1, 1, 1, 2]), True) for i in range(length)]
    rows += [(conv, i, "user", "same text", True) for conv in range(100, 140) for i in range(3)]  # copies over several shards
    rows += [(200, i, "user", str(i), True) for i in range(200)]
    rows += [(201, i, "user", str(i), True) for i in range(198)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as id", "'y' as shard", "1 as chars", "2 as key")
    same(C.prefix_trie(df), plain_trie(rows))


def test_trie_of_awkward_rows(spark):
    rows = [(1, None, None, "a", None), (1, 2, "user", None, None), (1, 2, "user", None, None), (2, None, None, "a", None), (2, 1, "", "é😀", True), (None, 1, "user", "a", True), (3, 0, "user", "", True), (-5, 0, "user", "", True)]
    same(C.prefix_trie(spark.createDataFrame(rows, COLUMNS)), plain_trie(rows))
    assert C.prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c}-{t}") for c in (0, 1, 2, 3, 4, 101, -7, -100) for t in (None, 0, 1, 2, 3, 4, 5)] + [(None, 1, "user", "x")]
    got = defaultdict(list)
    for r in C.rebuilt(spark.createDataFrame(rows, COLUMNS.rsplit(",", 1)[0])).where("here").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append(r.text)
    import zlib

    own = lambda c: [f"{c}-{t}" for t in (None, 0, 1, 2, 3, 4, 5)]
    for c in (0, 1, 2, 3, 4, 101, -7, -100):
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        assert got[c] == (own(base)[:h] if base in (0, -100) else []) + own(c)[h:]
    assert None not in got


def test_tree_is_balanced_among_siblings():
    tree = C.TernaryTree()
    for k in C.medians(1023):
        tree.add([k], [1], 1, k)
    deepest, todo = 0, [(tree.same[0], 1)]
    while todo:
        at, d = todo.pop()
        if at >= 0:
            deepest = max(deepest, d)
            todo += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert deepest == 10 and tree.members[0] == 1023


def plain_repair(rows):
    """(cost, audit) from all edits with up to two inserts at a time; rows: (initial, fault)."""
    best = (10**9, "")
    choices = []
    for role, fault in rows:
        own = [("D", 3, None)]
        if fault in ("", "truncated"):
            extra = bool(fault)
            own += [("R", 2 + extra, "u"), ("R", 2 + extra, "a"), *([("K", extra, role)] if role else [])]
        choices.append(own)
    inserts = ["", "u", "a", "ua", "au"]
    for picks in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = "".join(g + (p[2] or "") for g, p in zip(gaps, picks, strict=False)) + gaps[-1]
            head = roles[1:] if roles[:1] == "s" else roles
            if (roles and (not head or head != "ua" * (len(head) // 2))) or len(head) % 2:
                continue
            cost = sum(p[1] for p in picks) + 2 * sum(map(len, gaps))
            audit = "".join("I" * len(g) + p[0] for g, p in zip(gaps, picks, strict=False)) + "I" * len(gaps[-1])
            best = min(best, (cost, audit))
    return best


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(R.SPACE)[-1:]
        out.append((role[:1], "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    return out


def test_edits_are_the_cheapest_and_least():
    rng, steps = random.Random(3), R.Steps()
    for _ in range(250):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "c!", " ", "d?"])) for i in range(rng.choice([0, 1, 2, 3]))]
        c = R.Conversation(steps)
        for row in rows:
            c.add(*row)
        cost, edits, tail = c.edits()
        audit = "".join(x[0] for x in c.repaired(edits, tail))
        assert (cost, audit) == plain_repair(plain_faults(rows)), rows
    assert len(steps) < 5000


def test_large_conversations_use_files(monkeypatch):
    rng = random.Random(8)
    rows = [(i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", f"{i}.", ""])) for i in range(5000)]

    def run():
        c = R.Conversation(R.Steps())
        for row in rows:
            c.add(*row)
        cost, edits, tail = c.edits()
        return cost, list(c.repaired(edits, tail)), c.duplicate, c.turns, c.texts._rolled

    small = run()
    monkeypatch.setattr(R, "IN_MEMORY", 1000)
    monkeypatch.setattr(R, "DIGESTS", 64)
    large = run()
    assert small[:4] == large[:4] and large[4] and not small[4]
    roles = "".join(r.decode()[:1] for letter, r, _ in small[1] if letter != "D")
    assert roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_rows_carry_over_batches(spark, batch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["one.", "two", "three!"]), True) for c in range(20) for t in range(rng.choice([1, 5, 8]))]
    rows += [(90, None, None, None, True), (90, 3, "user", "x.", None), (90, 3, "user", "x.", None), (91, 1, "user", "", False), (None, 1, "user", "y.", True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as cost", "'y' as audit", "1 as order")
        found = {r.conv_id: r for r in R.repair_conversations(df).collect()}
        turns = defaultdict(list)
        for r in R.repaired_turns(df).orderBy("conv_id", "turn").collect():
            turns[r.conv_id].append(f"{r.role}:{r.text}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for c, t, role, text, here in rows:
        by[c] += [(t, " " if role is None else role, " " if text is None else text)] if here in (None, True) else []
    assert set(found) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r))
        known = [t for t, _, _ in own if t is not None]
        f = found[c]
        faults = plain_faults(own)
        assert (f.blank, f.duplicate, f.truncated) == tuple(sum(x == k for _, x in faults) for k in ("blank", "duplicate", "truncated"))
        assert f.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert f.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
        if len(own) <= 3:
            assert (f.cost, f.audit) == plain_repair(faults)
        assert f.repaired_sha256 == hashlib.sha256("\n".join(turns[c]).encode()).hexdigest()
    assert found[91][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert R.repair_conversations(empty).count() == 0 and R.repair_conversations(R.damaged(empty)).count() == 0
