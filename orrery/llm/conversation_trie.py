"""A trie of the prefixes that conversations share, by ternary search trees over ranges of their sequences.

Turns are numbered by a dictionary, a conversation is the array of its turns' numbers, and conversations are dealt by
ranges of (sequence, id), so that copies of one sequence are spread over shards, too.  Every shard puts its distinct
sequences into a ternary search tree, the middle one of each stretch first, so that the trees of siblings are balanced,
and sums up members, leaves and savings from the deepest nodes on.  Only nodes on the way to a shard's first or last
sequence can have members elsewhere; these open nodes are merged for 64 neighbouring shards at a time until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.cut import cut

#: Turns of a shard, about, and shards that are merged in one task.
SHARD_TURNS, NEIGHBOURS = 1 << 17, 64
_SEQUENCES = "conv_id long, ids array<long>, chars array<int>"
_NODES = "kind int, shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, is_first boolean, is_last boolean, ends binary"
_NAMES = [x.split()[0] for x in _NODES.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _NODES.split(", "))])
#: Kinds of rows: a finished node, an open one with what is finished below it, and ids of conversations that end at one.
DONE, OPEN, ENDS = 0, 1, 2


class TernaryTree:
    """Sequences of numbers with their members; node 0 is the root, and a node's number is larger than its parent's."""

    def __init__(self) -> None:
        self.sign, self.low, self.same, self.high = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.chars, self.members, self.least = [-1], [0], [0], [0], [None]

    def _new(self, parent: int, sign: int, chars: int) -> int:
        for column, x in ((self.sign, sign), (self.low, -1), (self.same, -1), (self.high, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.members, 0), (self.least, None)):
            column.append(x)
        return len(self.sign) - 1

    def path(self, sequence: list[int], chars: list[int] | None = None) -> list[int]:
        """The nodes of a sequence from the root on; with chars, those that are missing are made."""
        sign, low, same, high = self.sign, self.low, self.same, self.high
        at, nodes = 0, [0]
        for i, t in enumerate(sequence):
            side, place, to = same, at, same[at]
            while to >= 0 and sign[to] != t:
                side = low if t < sign[to] else high
                place, to = to, side[to]
            if to < 0:
                to = self._new(at, t, chars[i])
                side[place] = to
            at = to
            nodes.append(at)
        return nodes

    def add(self, sequence: list[int], chars: list[int], members: int, least: int) -> int:
        """The node at a sequence's end, once its members are counted at every node of it."""
        nodes = self.path(sequence, chars)
        for x in nodes:
            self.members[x] += members
            self.least[x] = least if self.least[x] is None else min(self.least[x], least)
        return nodes[-1]


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle of every stretch before what is on both of its sides."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            yield (a + b) // 2
            todo += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def path_keys(sequence: list[int]) -> list[bytes]:
    """A name of 16 bytes for each prefix; the root's is empty."""
    keys = [b""]
    for t in sequence:
        keys.append(hashlib.blake2b(keys[-1] + t.to_bytes(8, "little", signed=True), digest_size=16).digest())
    return keys


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _NODES for the sequences (shard, conv_id, ids, chars) of one shard, which come sorted."""
    sequences: list[tuple[list[int], list[int]]] = []
    members: list[list[int]] = []
    number, last = 0, None
    for batch in batches:
        shard, conv, ids, chars = (batch.column(n) for n in ("shard", "conv_id", "ids", "chars"))
        for i in range(batch.num_rows):
            number, now = shard[0].as_py(), ids[i].values.to_numpy()
            if last is None or len(now) != len(last) or (now != last).any():
                last = now.copy()
                sequences.append((now.tolist(), chars[i].as_py()))
                members.append([])
            members[-1].append(conv[i].as_py())
    if not sequences:
        return
    tree, ending = TernaryTree(), {}
    for k in medians(len(sequences)):
        ending[tree.add(*sequences[k], len(members[k]), members[k][0])] = k
    n = len(tree.sign)
    key: dict[int, bytes] = {}
    ends: list[set[int]] = []
    for sequence, _ in (sequences[0], sequences[-1]):
        nodes = tree.path(sequence)
        key.update(zip(nodes, path_keys(sequence), strict=True))
        ends.append(set(nodes))
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for x in range(n - 1, -1, -1):
        if x not in key:
            leaves[x] = leaves[x] or 1
            saved[x] += (tree.members[x] - 1) * tree.chars[x]
            p = tree.parent[x]
            children[p] += 1
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    rows, empty = [], hashlib.sha256().hexdigest().encode()
    for x in range(n):
        own = members[ending[x]] if x in ending else None
        ids = ",".join(map(str, own)).encode() if own else b""
        p = tree.parent[x]
        known = (tree.members[x], children[x], leaves[x], saved[x], tree.chars[x])
        if x in key:
            rows.append((OPEN, number, key[x], key.get(p), tree.least[x], tree.depth[x], None, *known, x in ends[0], x in ends[1], None))
            if own:
                rows.append((ENDS, number, key[x], *[None] * 11, ids))
        else:
            rows.append((DONE, number, None, key.get(p), tree.least[x], tree.depth[x], None if p in key else tree.least[p], *known, None, None, hashlib.sha256(ids).hexdigest().encode() if own else empty))
        if len(rows) >= 1 << 14:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _merged(final: bool):
    """Open nodes of neighbouring shards as one shard's; with final nothing is open any more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[bytes, dict] = {}
        ends = pdf.shard.min(), pdf.shard.max()
        sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
        for r in pdf.to_dict("records"):
            r["key"] = bytes(r["key"])
            r["parent_key"] = None if r["parent_key"] is None else bytes(r["parent_key"])
            r["is_first"], r["is_last"] = bool(r["is_first"]) and r["shard"] == ends[0], bool(r["is_last"]) and r["shard"] == ends[1]
            x = nodes.setdefault(r["key"], r)
            if x is not r:
                x.update({c: x[c] + r[c] for c in sums}, conv_id=min(x["conv_id"], r["conv_id"]), is_first=x["is_first"] or r["is_first"], is_last=x["is_last"] or r["is_last"])
        for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
            x["kind"] = OPEN if not final and (x["is_first"] or x["is_last"]) else DONE
            x["shard"] = int(ends[0]) // NEIGHBOURS
            if x["kind"] == DONE:
                x["n_leaves"] = x["n_leaves"] or 1
                x["saved_tokens"] += (x["n_convs"] - 1) * x["chars"]
                if x["parent_key"] is not None:
                    p = nodes[x["parent_key"]]
                    p.update(n_children=p["n_children"] + 1, n_leaves=p["n_leaves"] + x["n_leaves"], saved_tokens=p["saved_tokens"] + x["saved_tokens"])
        out = pd.DataFrame(list(nodes.values()), columns=_NAMES)
        return out.assign(parent_conv_id=pd.array([None] * len(out), "Int64"))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sha of the ids (key, ends) that come sorted by key and place."""
    now, whole, out = None, None, []
    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now or whole is None:
                if whole is not None:
                    out.append((now, whole.hexdigest()))
                now, whole = key, hashlib.sha256(ends)
            else:
                whole.update(b"," + ends)
    if whole is not None:
        out.append((now, whole.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["end_key", "ends_sha256"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of rows (conv_id, id, chars) that come sorted by conversation and turn; a null id adds no turn."""
    kept: list[tuple[int, list[np.ndarray], list[np.ndarray]]] = []

    def flush(rows):
        whole = [(c, np.concatenate(i), np.concatenate(n)) for c, i, n in rows]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for _, i, _ in whole])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in whole]), t)) for k, t in ((1, pa.int64()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in whole], pa.int64()), *lists], names=["conv_id", "ids", "chars"])

    turns = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, some = batch.column("conv_id").to_numpy(), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        ids, chars = (batch.column(n).fill_null(0).to_numpy() for n in ("id", "chars"))
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(conv)], strict=True):
            use = some[a:b]
            if not kept or kept[-1][0] != conv[a]:
                if turns >= 1 << 20 or len(kept) >= 1 << 14:
                    yield flush(kept)
                    kept, turns = [], 0
                kept.append((int(conv[a]), [], []))
            kept[-1][1].append(ids[a:b][use].copy())
            kept[-1][2].append(chars[a:b][use].copy())
            turns += b - a
    if kept:
        yield flush(kept)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the trie.

    turns: conv_id, turn (the order), role, text, here.  A node is a distinct sequence of first turns (role and text), from
    the root without turns; its members are the conversations that begin with it.  conv_id is its smallest member,
    saved_tokens what its subtree saves when each node's last text is kept once: code points times members less one.
    ends_sha256 is the SHA-256 of the ids of members that have no further turn, ascending, with commas between.

    A null role or text is empty; turns of one number go by role, then text, and repeated rows count again.  Rows without a
    conv_id are left out.  here is false for a row that only says that there is such a conversation.  An empty table has no
    nodes; more columns don't matter.  A conversation is one row of 12 bytes a turn; the ids that end at one node are hashed
    by one task, as SHA-256 goes over them in order, but as they stream and in long pieces made by the shards.
    """
    here = F.coalesce("here", F.lit(True))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text"), here.alias("here"))
    name = F.when(F.col("here"), F.unhex(F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary"))))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    coded = cut(rows.select("conv_id", place.alias("place"), name.alias("name"), F.char_length("text").alias("chars")))
    numbers = cut(coded.where("name is not null").select("name").distinct().select("name", F.monotonically_increasing_id().alias("id")))
    numbered = coded.join(numbers, "name", "left").select("conv_id", "place", "id", "chars")
    sequences = cut(numbered.repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place").mapInArrow(_assembled, _SEQUENCES))
    n = max(1, -(-(sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0) // SHARD_TURNS))
    sorted_ = sequences.repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    found = cut(sorted_.withColumn("shard", F.spark_partition_id()).mapInArrow(_shard, _NODES))
    left = (found.agg(F.max("shard")).first()[0] or 0) + 1
    open_, merged = found.where(F.col("kind") == OPEN), None
    while merged is None or left > 1:
        left = -(-left // NEIGHBOURS)
        step = cut(open_.groupBy(F.floor(F.col("shard") / NEIGHBOURS)).applyInPandas(_merged(left == 1), _NODES))
        open_, now = step.where(F.col("kind") == OPEN), step.where(F.col("kind") == DONE)
        merged = now if merged is None else merged.union(now)
    pieces = found.where(F.col("kind") == ENDS).select("key", "shard", "ends")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashed, "end_key binary, ends_sha256 string")
    own = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    empty = hashlib.sha256().hexdigest()
    tops = merged.join(hashes, F.col("key") == F.col("end_key"), "left").select(*own, "parent_key", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    below = found.where(F.col("kind") == DONE).select(*own, "parent_key", F.col("ends").cast("string").alias("ends_sha256"))
    # Only nodes below open ones don't know yet who their parent's smallest member is.
    asking = tops.union(below.where("parent_key is not null")).drop("parent_conv_id")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return asking.join(parents, "parent_key", "left").select(*own, "ends_sha256").union(below.where("parent_key is null").select(*own, "ends_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here of conversations that share their first turns with others.

    Conversation c has the first h turns of conversation c - c % 100 and its own after its first h; h is the CRC-32 of c as
    text modulo 6.  Every conv_id also has a row with here false, as it may have no turn.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1).cast("long")
    known = conversations.where("conv_id is not null")
    rows = known.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text")).select("conv_id", place.alias("turn"), "role", "text")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    ids = known.select("conv_id").distinct()
    heads = rows.where("turn < 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    asked = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", shared)
    taken = asked.join(heads, "base").where("turn < h").select("conv_id", "turn", "role", "text")
    nothing = ids.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("here"))
    return rows.where(F.col("turn") >= shared).union(taken).withColumn("here", F.lit(True)).union(nothing)
