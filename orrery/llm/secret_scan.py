"""Secret scans: all rules in one automaton, which goes over the bytes of every text once.

Each rule's regex becomes a minimal automaton by subset construction.  A search for it is an automaton over lists of
its states, the oldest start first, so that a match is the leftmost one and the longest from there.  The searches of
all rules run side by side in one automaton, minimised again, whose transition array also tells where matches end.
Texts are cut into lanes that numpy steps side by side; a lane whose start was guessed wrong is run again until its
states are those of the first run.  A match's start is found by the reversed rule, backwards from its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from orrery.llm import text as T
from orrery.llm.columns import unused
from orrery.shipping import ship

#: Bytes that a lane steps through.
STEPS = 1024
_ALL = (1 << 256) - 1


@dataclass(frozen=True)
class Rule:
    """kind; a regex of literals, sets, groups, | and repeats over ASCII (no anchors, no looking around); how many characters
    its group ``value``, or without one the whole match, has at least.  Shorter matches use up their text, but are dropped."""

    kind: str
    pattern: str
    least: int = 1


#: The rules that every scan of the query has, in order.  A run of too few hexadecimal digits holds no longer
#: one, so their least number can stand in the pattern, and short runs, which all prose has, aren't even found.
BASE = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds of secrets by their public formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host", r"gh[opusr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("claims", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


# ---- from regexes to transition arrays


class _Graph:
    """States with free steps and steps on sets of bytes (as 256-bit masks), built from a parsed regex."""

    def __init__(self, pattern: str, backwards: bool) -> None:
        parsed = re._parser.parse(pattern.encode())
        self.any_case, self.backwards = bool(parsed.state.flags & re.IGNORECASE), backwards
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[int, int]]] = []
        self.start = self.new()
        self.end = self.add(parsed, self.start)

    def new(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def add(self, items: Iterable, at: int) -> int:
        """Where one is after a sequence of parsed items that begins at a state."""
        for kind, value in reversed(list(items)) if self.backwards else items:
            at = self.item(str(kind), value, at)
        return at

    def item(self, kind: str, value, at: int) -> int:
        if kind in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            self.steps[at].append((self.bytes_of(kind, value), to := self.new()))
            return to
        if kind == "SUBPATTERN":
            return self.add(value[-1], at)
        if kind == "BRANCH":
            to = self.new()
            for way in value[1]:
                self.free[at].append(start := self.new())
                self.free[self.add(way, start)].append(to)
            return to
        if kind == "MAX_REPEAT":
            least, most, inner = value
            for _ in range(least):
                at = self.add(inner, at)
            if most == re._parser.MAXREPEAT:
                self.free[at].append(loop := self.new())
                self.free[self.add(inner, loop)].append(loop)
                return loop
            ends = [at]
            for _ in range(most - least):
                ends.append(at := self.add(inner, at))
            for e in ends[:-1]:
                self.free[e].append(at)
            return at
        raise ValueError(f"a rule can't have {kind}")

    def bytes_of(self, kind: str, value) -> int:
        if kind == "ANY":
            return _ALL ^ (1 << 10)
        if kind != "IN":
            mask = self.cased(1 << value)
            return mask if kind == "LITERAL" else _ALL ^ mask
        mask, negated = 0, False
        for what, x in value:
            if str(what) == "NEGATE":
                negated = True
            elif str(what) in ("LITERAL", "RANGE"):
                a, b = (x, x) if str(what) == "LITERAL" else x
                mask |= (1 << (b + 1)) - (1 << a)
            else:
                raise ValueError(f"a rule can't have {what}")
        mask = self.cased(mask)
        return _ALL ^ mask if negated else mask

    def cased(self, mask: int) -> int:
        if self.any_case:
            letters = ((1 << 26) - 1) << 65
            mask |= (mask & letters) << 32 | (mask >> 32) & letters
        return mask

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(found)


def byte_classes(masks: Iterable[int]) -> np.ndarray:
    """A number for each byte; bytes of one number are in the same of the sets."""
    label = np.zeros(256, np.int64)
    for mask in masks:
        bits = np.array([mask >> b & 1 for b in range(256)])
        label = np.unique(label * 2 + bits, return_inverse=True)[1]
    return label


def minimised(steps: np.ndarray, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """steps (state, class) and outputs (state, any) with states of like behaviour made one; state 0 stays 0."""
    label, n = np.zeros(len(steps), np.int64), 0
    while True:
        label = np.unique(np.hstack([label[:, None], outputs, label[steps]]), axis=0, return_inverse=True)[1].ravel()
        if label.max() + 1 == n:
            break
        n = label.max() + 1
    first = np.unique(label, return_index=True)[1]
    order = np.argsort(first)  # by the first state of each label, so that 0 stays in front
    rank = np.argsort(order)
    return rank[label[steps[first[order]]]], outputs[first[order]]


def deterministic(graph: _Graph, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (state, class) and which states accept; the start is 0, and the dead state accepts nothing and stays."""
    byte_of = np.unique(classes, return_index=True)[1]
    start = graph.closed([graph.start])
    number, rows, todo = {start: 0}, [], [start]
    for states in todo:
        row = []
        for b in byte_of:
            to = graph.closed(t for s in states for mask, t in graph.steps[s] if mask >> int(b) & 1)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = np.array([[graph.end in states] for states in todo])
    steps, accepts = minimised(np.array(rows), accepts)
    return steps, accepts[:, 0]


def _searches(steps: np.ndarray, accepts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The search for one rule: steps (state, class and the end of a text), and which of them end a match."""
    n_classes, live = steps.shape[1], np.array([a or (row != i).any() for i, (row, a) in enumerate(zip(steps, accepts, strict=True))])
    if accepts[0]:
        raise ValueError(f"{kind} matches the empty text")
    if (live[steps[accepts]] & ~accepts[steps[accepts]]).any():
        raise ValueError(f"{kind} can go on after a match without being one")

    def after(threads: tuple[int, ...], c: int) -> tuple[int, ...]:
        moved = tuple(dict.fromkeys(int(t) for t in steps[list(threads), c] if live[t]))
        done = [t for t in moved if accepts[t]]
        if done and done[0] != moved[0]:
            raise ValueError(f"{kind} can match while an earlier start is open")
        return tuple(done[:1]) or moved

    number, rows, ends, todo = {(): 0}, [], [], [()]
    for threads in todo:
        row, end = [], []
        matched = bool(threads) and bool(accepts[threads[0]])
        for c in range(n_classes):
            over = matched and not live[steps[threads[0], c]]
            to = after(threads if matched and not over else (0,) if over else (*threads, 0), c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            end.append(over)
        rows.append([*row, 0])
        ends.append([*end, matched])
    return minimised(np.array(rows), np.array(ends))


class Automaton:
    """All rules: ``kinds`` (a class for each byte, and ``end`` behind a text), ``next`` and ``found`` (by state times classes
    plus class; next is premultiplied), where found has a bit for each rule whose match ends before the byte."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        if len(rules) > 16:
            raise ValueError("more than 16 rules in one automaton")
        forward, back = ([_Graph(r.pattern, b) for r in rules] for b in (False, True))
        self.kinds = byte_classes(m for g in forward for s in g.steps for m, _ in s)
        self.end = int(self.kinds.max()) + 1
        self.kinds = self.kinds.astype(np.uint8)
        searches = [_searches(*deterministic(g, self.kinds), r.kind) for g, r in zip(forward, rules, strict=True)]
        self.back = [(steps.tolist(), accepts.tolist(), (~accepts & (steps == np.arange(len(steps))[:, None]).all(axis=1)).tolist()) for steps, accepts in (deterministic(g, self.kinds) for g in back)]
        self.checks = [(re.compile(r.pattern.encode()), "value" in re.compile(r.pattern).groupindex, r.least) for r in rules]
        self.rules = rules
        begin = (0,) * len(rules)
        number, rows, found, todo = {begin: 0}, [], [], [begin]
        for states in todo:
            to = np.stack([s[x] for (s, _), x in zip(searches, states, strict=True)], axis=1)
            row = []
            for t in map(tuple, to.tolist()):
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                row.append(number[t])
            rows.append(row)
            found.append(sum(e[x].astype(np.int64) << i for i, ((_, e), x) in enumerate(zip(searches, states, strict=True))))
        steps, found = minimised(np.array(rows), np.array(found))
        self.next, self.found = (steps * steps.shape[1]).astype(np.int32).ravel(), found.astype(np.uint16).ravel()

    def ends(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, byte in it, bits of rules) of all places where matches end."""
        n = len(offsets) - 1
        total = len(data) + n
        lanes = -(-total // STEPS)
        signs = np.full(lanes * STEPS, self.end, np.uint8)
        inside = np.ones(total, bool)
        closes = offsets[1:] + np.arange(n)
        inside[closes] = False
        signs[:total][inside] = self.kinds[data]
        signs = np.ascontiguousarray(signs.reshape(lanes, STEPS).T)
        seen = np.empty((STEPS, lanes), np.int32)
        last = np.zeros(lanes, np.int32)
        for t in range(STEPS):
            np.add(last, signs[t], out=seen[t])
            np.take(self.next, seen[t], out=last, mode="clip")
        began = np.zeros(lanes, np.int32)
        while len(wrong := np.flatnonzero(began[1:] != last[:-1]) + 1):
            state = began[wrong] = last[wrong - 1]
            for t in range(STEPS):
                at = state + signs[t, wrong]
                other = at != seen[t, wrong]
                wrong, at = wrong[other], at[other]
                seen[t, wrong] = at
                state = self.next[at]
                if not len(wrong):
                    break
            last[wrong] = state
        bits = self.found[seen.T.ravel()[:total]]
        places = np.flatnonzero(bits)
        rows = np.searchsorted(closes, places)
        return rows, places - rows - offsets[rows], bits[places]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of all matches of each row that has some, by start, then rule."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        last: dict[tuple[int, int], int] = {}
        for row, end, bits in zip(*(x.tolist() for x in self.ends(data, offsets)), strict=True):
            base = int(offsets[row])
            for i in range(len(self.rules)):
                if bits >> i & 1:
                    start = self.start(i, data, base + last.get((row, i), 0), base + end) - base
                    last[row, i] = end
                    pattern, has_value, least = self.checks[i]
                    size = end - start
                    if has_value:
                        size = len(pattern.fullmatch(data[base + start : base + end].tobytes())["value"])
                    if size >= least:
                        found.setdefault(row, []).append((start, i, end))
        return {row: sorted(x) for row, x in found.items()}

    def start(self, rule: int, data: np.ndarray, first: int, end: int) -> int:
        """The earliest place from first on where a match of a rule that ends at end can begin."""
        steps, accepts, dead = self.back[rule]
        state, best, at, size = 0, end, end, 64
        while at > first:
            low, size = max(first, at - size), min(2 * size, 1 << 16)
            for c in self.kinds[data[low:at]][::-1].tolist():
                state, at = steps[state][c], at - 1
                if accepts[state]:
                    best = at
                elif dead[state]:
                    return best
        return best


# ---- on Spark


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...], *keep: str) -> DataFrame:
    """The columns keep of docs, and spans: array of (kind, start, end) in column text by start, then in the rules' order.

    Places count code points, the end excluded.  A rule's matches are leftmost and don't overlap; those of two rules may.
    A null text is empty; empty and very long texts, repeated rows and null ids give a row each; an empty table none.
    A column of keep named spans gets an underscore more.  One narrow pass, so no key is hot and a lost task is run again
    alone; the automaton (some 100 kB) is built on the driver.
    """
    ship(docs.sparkSession)
    kept = docs.select(*keep)
    names = [unused(["spans"], n) for n in kept.columns]
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(rules))
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        automaton = sent.value
        kinds = np.array([r.kind for r in automaton.rules], object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts, rows = np.zeros(batch.num_rows + 1, np.int32), []
            for a, _, data, offsets in T.chunks(texts):
                found = automaton.spans(data, offsets)
                if found:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for row in sorted(found):
                        base = offsets[row]
                        counts[a + row + 1] = len(found[row])
                        rows += [(i, int(points[base + s] - points[base]), int(points[base + e] - points[base])) for s, i, e in found[row]]
            items = np.array(rows, np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(kinds[items[:, 0]], pa.string()), pa.array(items[:, 1]), pa.array(items[:, 2])], fields=list(one))
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spans], names=[*names, "spans"])

    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)), StructField("spans", ArrayType(span))])
    return docs.select(*keep, F.col("text").cast("binary").alias(unused(kept.columns, "text_to_scan"))).mapInArrow(run, schema)
