"""Repair of conversations: the cheapest edits that make roles alternate, found row by row as rows stream in turn order.

Rows are dealt by conversation and sorted by turn; a task goes over them once and carries the state of the open
conversation from batch to batch: for each of four places in the pattern of roles the least cost so far and how its
edits sort among the four.  Four bytes a row say how each place was reached; they and the texts, which the repaired
conversation needs again once its end is known, go to a temporary file when a conversation is large.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an edit costs, what keeping a truncated row adds, and white space.
REROLE, DELETE, INSERT, TRUNCATED, SPACE = 2, 3, 2, 1, " \t\n\x0b\x0c\r"
#: Bytes of one conversation in memory, and digests of its rows, before they go to files.
IN_MEMORY, DIGESTS = 1 << 22, 1 << 17

# Places in ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a.  Where the next u or a leads, and what may be kept.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: No place that costs so much more than the cheapest can become the best one: two inserts and a deletion lead to any other.
_HOPELESS = 2 * INSERT + DELETE + 1
_START = ((0, 0), None, None, None)
_ENDS = {0: 0, 3: 0, 2: 1, 1: 2}


class Steps(dict):
    """(places, role's initial, fault) to (next places, cost that all share, four back pointers); there are few such keys.

    places: for each place (cost over the cheapest, rank of its edits among the places), or None.
    """

    def __missing__(self, key: tuple) -> tuple:
        places, role, fault = key
        best: dict[int, tuple] = {}
        for source, known in enumerate(places):
            if known is None:
                continue
            at = source
            for inserts in range(3):
                moves = [("D", at, DELETE)]
                if fault in ("", "truncated"):
                    extra = TRUNCATED if fault else 0
                    moves.append(("R", _NEXT[at], REROLE + extra))
                    if (role, at) in _KEEP:
                        moves.append(("K", _KEEP[role, at], extra))
                for letter, to, cost in moves:
                    found = (known[0] + INSERT * inserts + cost, known[1], "I" * inserts + letter, source)
                    best[to] = min(best.get(to, found), found)
                at = _NEXT[at]
        least = min(b[0] for b in best.values())
        best = {to: b for to, b in best.items() if b[0] - least <= _HOPELESS}
        ranks = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        after = tuple((best[p][0] - least, ranks[p]) if p in best else None for p in range(4))
        pointers = bytes(best[p][3] << 4 | (len(best[p][2]) - 1) << 2 | "DKR".index(best[p][2][-1]) if p in best else 0xFF for p in range(4))
        self[key] = after, least, pointers
        return self[key]


class Seen:
    """Which 16-byte digests were there before; above DIGESTS they go to sorted files, of sizes that double."""

    def __init__(self) -> None:
        self.now: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def __call__(self, digest: bytes) -> bool:
        if digest in self.now:
            return True
        for run in self.runs:
            at = np.searchsorted(run, np.bytes_(digest))
            if at < len(run) and run[at] == np.bytes_(digest):
                return True
        self.now.add(digest)
        if len(self.now) >= DIGESTS:
            run = np.sort(np.array(list(self.now), "S16"))
            while self.runs and len(self.runs[-1]) <= len(run):
                run = np.sort(np.concatenate([self.runs.pop(), run]))
            with tempfile.TemporaryFile() as file:
                file.write(run.tobytes())
                file.flush()
                self.runs.append(np.memmap(file, "S16", "r"))
            self.now.clear()
        return False


class Conversation:
    """One conversation as its rows come."""

    def __init__(self, steps: Steps) -> None:
        self.steps, self.places, self.cost, self.n = steps, _START, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.role = None
        self.seen = Seen()
        self.texts, self.pointers = (tempfile.SpooledTemporaryFile(max_size=IN_MEMORY) for _ in range(2))

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.role is not None and self.role + initial not in ("su", "ua", "au")
        self.role = initial
        a, b = role.encode(), text.encode()
        head = struct.pack("<qq", len(a), len(b))
        again = self.seen(hashlib.blake2b(head + a + b, digest_size=16).digest())
        end = text.rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if again else "truncated" if end not in ".!?" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.places, cost, pointers = self.steps[self.places, initial if initial in ("s", "u", "a") else "", fault]
        self.cost += cost
        self.n += 1
        self.texts.write(head + a + b)
        self.pointers.write(pointers)

    def edits(self) -> tuple[int, np.ndarray, int]:
        """The least cost, of its edits (inserts before a row times 4 plus the row's own, D, K or R) the least ones, and the
        number of inserts at the end."""
        cost, _, tail, at = min((p[0] + INSERT * _ENDS[at], p[1], _ENDS[at], at) for at, p in enumerate(self.places) if p)
        edits = np.empty(self.n, np.uint8)
        for high in range(self.n, 0, -(1 << 16)):
            low = max(0, high - (1 << 16))
            self.pointers.seek(4 * low)
            block = self.pointers.read(4 * (high - low))
            for i in range(high - 1, low - 1, -1):
                pointer = block[4 * (i - low) + at]
                at, edits[i] = pointer >> 4, pointer & 15
        return self.cost + cost, edits, tail

    def repaired(self, edits: np.ndarray, tail: int) -> Iterator[tuple[str, bytes, bytes]]:
        """(letter, role, text) of all edits in order; deleted rows have their letter only."""
        at = 0
        self.texts.seek(0)
        for edit in edits.tolist():
            for _ in range(edit >> 2):
                yield "I", b"assistant" if at == 2 else b"user", b""
                at = _NEXT[at]
            a, b = struct.unpack("<qq", self.texts.read(16))
            role, text, letter = self.texts.read(a), self.texts.read(b), "DKR"[edit & 3]
            if letter == "R":
                role = b"assistant" if at == 2 else b"user"
            yield letter, role, text
            if letter != "D":
                at = _KEEP[role[:1].decode(), at] if letter == "K" else _NEXT[at]
        for _ in range(tail):
            yield "I", b"assistant" if at == 2 else b"user", b""
            at = _NEXT[at]


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conversation's id, what its rows gave) of sorted rows, one conversation after another over all batches."""
    steps, now, open_ = Steps(), None, None
    for pdf in frames:
        for conv, here, turn, role, text in zip(*(pdf[c].tolist() for c in ("conv_id", "here", "turn", "role", "text")), strict=True):
            if open_ is None or conv != now:
                if open_ is not None:
                    yield now, open_
                now, open_ = conv, Conversation(steps)
            if here:
                open_.add(turn, role, text)
    if open_ is not None:
        yield now, open_


def _sorted(turns: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.coalesce("here", F.lit(True)).alias("here"), F.col("turn").cast("string").alias("turn"), F.col("turn").alias("order"), blank("role").alias("role"), blank("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("order"), "role", "text").drop("order")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of turns (conv_id, turn, role, text, here).

    A row's fault is the first that holds: blank (nothing but white space), duplicate (role and text of an earlier row),
    truncated (its last sign isn't one of ``.!?``).  Edits: Keep (0), Rerole to user or assistant (2), Delete (3; a must for
    blank and duplicate rows), Insert an empty user or assistant row (2); a truncated row that stays adds 1.  audit has the
    initials of the cheapest edits after which the roles' initials are ``(s?(ua)+)?``, of equally cheap ones the least in ASCII;
    illegal counts neighbours that aren't su, ua or au; gaps are numbers missing between the least and the largest turn.

    Rows go by turn (nulls first), then role and text, so that ties and repeated rows have one order.  A null role or text
    is one space, and a row whose role is empty can't be kept; a null conv_id is a conversation of its own.  here is false for a row that only says that there is such
    a conversation: one without other rows has zeros, an empty audit and the hash of an empty string.  Empty tables give no
    rows; more columns don't matter.  All rows of a conversation go through one task, which holds of them what the module
    says.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for conv, c in _streamed(frames):
            cost, edits, tail = c.edits()
            whole, audit, first = hashlib.sha256(), [], True
            for letter, role, text in c.repaired(edits, tail):
                audit.append(letter)
                if letter != "D":
                    whole.update((b"" if first else b"\n") + role + b":" + text)
                    first = False
            gaps = 0 if c.first is None else int(c.last) - int(c.first) + 1 - c.turns
            out.append((conv, gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(audit), whole.hexdigest()))
            size += len(audit) + 200
            if size > 1 << 20:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = _sorted(turns).mapInPandas(run, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the repaired conversations, turns numbered from 0; like ``repair_conversations`` otherwise."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for conv, c in _streamed(frames):
            _, edits, tail = c.edits()
            for i, (_, role, text) in enumerate(x for x in c.repaired(edits, tail) if x[0] != "D"):
                out.append((conv, i, role.decode(), text.decode()))
                size += len(text) + 100
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _sorted(turns).mapInPandas(run, "conv_id string, turn long, role string, text string").withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here of conversations with faults, chosen by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", k.alias("k"), part("role").alias("role"), part("text").alias("text"))
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("here"), F.when(F.col("k") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "here", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
