"""N-gram Jaccard join by adaptive multi-match prefixes.

Two sets are similar when ``den * |intersection| >= num * |union|``; then they share at least num/den of the
larger one.  Order all shingles by rarity.  If similar, the first ``n - ceil(n * num / den) + l`` shingles of
both sets have l in common, for every l up to ``ceil(n * num / den)``.  Each document picks its own l: a longer prefix brings more
candidates but asks for more shared shingles, and the l with the least estimated number of candidates wins.
Two documents are verified when they share min(l, l') shingles of their prefixes.

How it runs:

1. Documents with equal sets become one node (named by a 64-bit signature of the set).
2. Shingles are dealt by their hash to buckets (packed, one row for a bucket and about ``UNIT`` shingles).  A
   bucket finds the shingles that more than one node has.  A shingle of ``COMMON`` nodes or more within a
   unit goes as a count, not as a list, so that no bucket gathers the nodes of a very common shingle.
3. A node gets its repeated shingles back.  Shingles of one node come first in the order and match nothing:
   a node with more of them than the prefix holds is done, which most are.
4. Nodes that share a prefix shingle form candidate clusters (connected components).  A cluster is joined in
   one task; a cluster over ``BLOCK`` nodes is split, and each task joins two parts.  Pairs that are already
   connected aren't verified again: the result is a spanning forest of the links, never all pairs of a group.
5. Components of the links, with all copies.

Defined results: a null or blank text has an empty set (n_shingles 0) and is linked with nothing; a text of
1 to k-1 words has its whole sequence as its one shingle; repeated rows and repeated doc_ids are documents of
their own; a null doc_id is kept (a component of only such rows has a null id); an empty table gives no rows.
Equality of shingles is equality of 54-bit hashes, of sets that of 64-bit sums of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.llm import text as T
from orrery.llm.columns import unused
from orrery.llm.components import components
from orrery.llm.cut import cut
from orrery.llm.packed import batches, joined, packed, runs
from orrery.shipping import ship

UNIT, COMMON, BLOCK, PER_BUCKET, MOST_MATCHES = 1 << 21, 64, 4096, 1 << 21, 8
#: Bytes of text whose words are looked at together, so that a worker's arrays are of a few MB.
AT_ONCE = 1 << 18
#: Bits of a shingle's hash that are kept, bits of it that are sent to its bucket, and where its rarity stands in a key.
_TOKEN, _SENT, _CLASS = 54, 48, 56


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles sorted by row and value, bounds of the rows, signature of each row)."""
    for at, to, data, offsets in T.chunks(texts, AT_ONCE):
        starts, stops, counts = T.words(data, offsets)
        hashes, rows = T.shingle_hashes(T.word_hashes(data, starts, stops, lower=True), counts, k)
        values, bounds = T.distinct_by_row(hashes, rows, to - at)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(T.mix(values ^ np.uint64(0xA0761D6478BD642F)), out=total[1:])
        yield at, to, values, bounds, (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def shingle_sets(docs: DataFrame, k: int, *keep: str) -> DataFrame:
    """doc_id, the columns keep, n_shingles and node (null for an empty set) of docs (doc_id, text)."""
    kept = docs.select("doc_id", *keep)
    names = [*kept.columns, "n_shingles", "node"]

    def run(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, to, _, bounds, marks in _sets(batch.column(batch.num_columns - 1), k):
                n[at:to], node[at:to] = np.diff(bounds), marks
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(node, mask=n == 0)], names=names)

    schema = StructType([*kept.schema.fields, StructField("n_shingles", LongType()), StructField("node", LongType())])
    return docs.select("doc_id", *keep, F.col("text").alias(unused(names, "text_to_join"))).mapInArrow(run, schema)


_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("nodes", pa.binary()), ("keys", pa.binary())])


def _place(n: int) -> np.dtype:
    return np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)


def _shingles(nodes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, low bits of their shingles) of one packed row."""
    nodes = np.frombuffer(nodes, np.int64)
    n = len(body) // (_SENT // 8 + _place(len(nodes)).itemsize)
    low = np.zeros((n, 8), np.uint8)
    low[:, : _SENT // 8] = np.frombuffer(body, np.uint8, n * _SENT // 8).reshape(n, -1)
    return nodes[np.frombuffer(body, _place(len(nodes)), n, n * _SENT // 8)], low.view(np.int64).ravel()


def _dealt(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows bucket, kind, nodes, keys: of shingles (kind 0), their counts (1), and what goes on to nodes (2)."""

    def unit(*held: list):
        n, nodes, values = map(np.concatenate, held)
        # What isn't needed any more goes at once: these arrays are a worker's largest.
        for x in held:
            x.clear()
        rows = np.repeat(np.arange(len(n), dtype=np.int32), n)
        _, first = np.unique(nodes, return_index=True)
        keep = np.zeros(len(n), bool)
        keep[first] = True
        keep &= n > 0
        here = keep[rows]
        tokens, rows = (values[here] >> np.uint64(64 - _TOKEN)).view(np.int64), rows[here]
        del values, here
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        del order
        new = np.flatnonzero(np.diff(tokens, prepend=-1))
        count = np.diff(np.append(new, len(tokens)))
        common = np.repeat(count >= COMMON, count)
        some, row = tokens[~common], rows[~common]
        bucket = some >> (_TOKEN - bits)
        for a, length in zip(*runs(bucket), strict=True):
            used, at = np.unique(row[a : a + length], return_inverse=True)
            low = some[a : a + length].view(np.uint8).reshape(-1, 8)[:, : _SENT // 8]
            yield int(bucket[a]), 0, nodes[used].tobytes(), low.tobytes() + at.astype(_place(len(used))).tobytes()
        heavy = count >= COMMON
        for bucket, a, b in packed(tokens[new][heavy] >> (_TOKEN - bits), count[heavy], tokens[new][heavy]):
            yield bucket, 1, a, b
        to = np.concatenate([nodes[keep], nodes[rows[common]]])
        key = np.concatenate([n[keep], tokens[common] | COMMON << _CLASS])
        for at in range(0, len(to), 1 << 16):
            yield int(to[at]) & ((1 << bits) - 1), 2, to[at : at + (1 << 16)].tobytes(), key[at : at + (1 << 16)].tobytes()

    def run(frames):
        def rows():
            n, nodes, values, held = [], [], [], 0
            for batch in frames:
                for _, _, v, bounds, marks in _sets(batch.column("text"), k):
                    n.append(np.diff(bounds))
                    nodes.append(marks)
                    values.append(v)
                    held += len(v)
                    if held >= UNIT:
                        yield from unit(n, nodes, values)
                        n, nodes, values, held = [], [], [], 0
            if held:
                yield from unit(n, nodes, values)

        return batches(rows(), _DEALT)

    return docs.select("text").mapInArrow(run, "bucket int, kind int, nodes binary, keys binary")


def _repeated(bits: int, spread: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in zip(pdf.nodes[pdf.kind == 2], pdf["keys"][pdf.kind == 2], strict=True):
            out.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
        some = pdf[pdf.kind == 0]
        sent = [_shingles(*x) for x in zip(some.nodes, some["keys"], strict=True)] or [(np.empty(0, np.int64), np.empty(0, np.int64))]
        nodes, tokens = (np.concatenate(x) for x in zip(*sent, strict=True))
        del sent
        tokens = tokens | (int(pdf.bucket.iloc[0]) >> (bits - _TOKEN + _SENT)) << _SENT
        heavy = pdf[pdf.kind == 1]
        known = np.unique(joined(heavy["keys"], np.int64))
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        new = np.flatnonzero(np.diff(tokens, prepend=-1))
        count = np.diff(np.append(new, len(tokens)))
        also = np.isin(tokens[new], known)
        keep = np.repeat((count > 1) | also, count)
        order = np.lexsort((nodes[keep], tokens[keep]))
        tokens, nodes = tokens[keep][order], nodes[keep][order]
        del keep, order
        one = (np.diff(tokens, prepend=-1) != 0) | (np.diff(nodes, prepend=0) != 0)
        if len(one):
            one[0] = True
        tokens, nodes = tokens[one], nodes[one]
        new = np.flatnonzero(np.diff(tokens, prepend=-1))
        count = np.diff(np.append(new, len(tokens)))
        level = np.minimum(np.where(np.isin(tokens[new], known), COMMON, count), COMMON)
        keep = np.repeat(level > 1, count)
        out.append((nodes[keep], (tokens | np.repeat(level, count) << _CLASS)[keep]))
        to, key = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(to & (spread - 1), kind="stable")
        return pd.DataFrame(list(packed((to & (spread - 1))[order], to[order], key[order])), columns=["part", "nodes", "keys"])

    return run


def prefix_matches(n: int, single: int, levels: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(l, how many repeated shingles its prefix holds) of a set of n, by the numbers of nodes of each repeated one.

    The estimate for l: nodes met in the prefix, of which those that meet it l times at most a l-th remain, and
    one unit for each further shingle to look up.  No more shared shingles may be asked for than a similar set must have.
    """
    needed = -(-n * num // den)
    spare = n - needed - single
    met = np.concatenate([[0], np.cumsum(levels - 1)])
    l = np.arange(1, min(MOST_MATCHES, needed) + 1)
    held = np.minimum(spare + l, len(levels))
    best = int(np.argmin(met[held] / l + l))
    return int(l[best]), int(held[best])


def _survivors(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, keys = joined(pdf.nodes, np.int64), joined(pdf["keys"], np.int64)
        order = np.lexsort((keys, nodes))
        nodes, keys = nodes[order], keys[order]
        one = np.ones(len(nodes), bool)
        one[1:] = (nodes[1:] != nodes[:-1]) | (keys[1:] != keys[:-1])
        nodes, keys = nodes[one], keys[one]
        new = np.append(np.flatnonzero(np.diff(nodes, prepend=~nodes[:1])), len(nodes))
        rows = []
        for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            n, single = int(keys[a]), int(keys[a]) - (b - a - 1)
            if single <= n - -(-n * num // den):
                matches, held = prefix_matches(n, single, keys[a + 1 : b] >> _CLASS, num, den)
                rows.append((int(nodes[a]), n, matches, held, keys[a + 1 : b]))
        return pd.DataFrame(rows, columns=["node", "n", "matches", "held", "keys"])

    return run


def linked(n: np.ndarray, matches: np.ndarray, held: np.ndarray, keys: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of each set the least index of the sets it is connected with; sides of 0 and 1 are compared with each other only."""
    m = len(keys)
    above = np.arange(m)

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    sizes = np.array([len(x) for x in keys])
    owner = np.repeat(np.arange(m), sizes)
    _, ids = np.unique(np.concatenate(keys), return_inverse=True)
    inside = np.concatenate([np.arange(s) for s in sizes]) < np.repeat(held, sizes)

    def index(ids, owner):
        order = np.argsort(ids, kind="stable")
        return owner[order], np.searchsorted(ids[order], np.arange(top_id + 2))

    top_id, start = int(ids.max()), np.concatenate([[0], np.cumsum(sizes)])
    (some, at), (every, all_at) = index(ids[inside], owner[inside]), index(ids, owner)
    for x in range(m):
        mine = ids[start[x] : start[x + 1]]
        shared = np.bincount(np.concatenate([some[at[i] : at[i + 1]] for i in mine[: held[x]]]), minlength=m)
        ok = (shared >= np.minimum(matches, matches[x])) & (np.minimum(n, n[x]) * den >= np.maximum(n, n[x]) * num)
        ok[: x + 1] = False
        if side[0] != side[-1]:
            ok &= side != side[x]
        found = np.flatnonzero(ok)
        if not len(found):
            continue
        own = top(x)
        found = np.array([y for y in found.tolist() if top(y) != own], np.int64)
        if len(found) > 24:
            both = np.bincount(np.concatenate([every[all_at[i] : all_at[i + 1]] for i in mine]), minlength=m)[found]
        else:
            both = np.array([len(np.intersect1d(keys[x], keys[y], assume_unique=True)) for y in found])
        for y in found[den * both >= num * (n[found] + n[x] - both)] if len(found) else ():
            a, b = sorted((top(x), top(int(y))))
            above[b] = a
    return np.array([top(x) for x in range(m)])


def _join_cluster(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "n", "node"], ignore_index=True)
        node = pdf.node.to_numpy()
        tops = linked(pdf.n.to_numpy(), pdf.matches.to_numpy(), pdf.held.to_numpy(), [np.asarray(x) for x in pdf["keys"]], pdf.side.to_numpy(), num, den)
        joined = tops != np.arange(len(tops))
        return pd.DataFrame({"a": node[joined], "b": node[tops[joined]]})

    return run


def similar_sets(docs: DataFrame, total: int, *, k: int, num: int, den: int) -> DataFrame:
    """Links a, b between nodes: a spanning forest of all similar pairs; total: about how many shingles docs have."""
    bits = max(_TOKEN - _SENT, math.ceil(math.log2(max(1, total) / PER_BUCKET)))
    spread = 1 << max(6, bits - 2)
    dealt = _dealt(docs, k, bits).groupBy("bucket").applyInPandas(_repeated(bits, spread), "part int, nodes binary, keys binary")
    sets = cut(dealt.groupBy("part").applyInPandas(_survivors(num, den), "node long, n long, matches int, held int, keys array<long>"))
    met = sets.select("node", F.explode(F.slice("keys", 1, F.col("held"))).alias("key"))
    first = met.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    clusters = components(met.join(first, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))
    clusters = cut(clusters)
    parts = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sets = sets.join(clusters, "node").join(parts, "root")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "n", "matches", "held", "keys")
    return sets.groupBy("root", "i", "j").applyInPandas(_join_cluster(num, den), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, *keep: str, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, the columns keep, n_shingles, node, root (the node that names its component, null for an empty set) and
    component_id (least doc_id that links reach) for docs of doc_id, text; keep may not name any of these."""
    ship(docs.sparkSession)
    members = cut(shingle_sets(docs, k, *keep))
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    roots = cut(components(similar_sets(docs.select("text"), total, k=k, num=num, den=den)))
    # Both small sides are cut, so that Spark can split what one text or one group has most rows of.
    some = members.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(some.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    some = some.join(least, "root", "left").select(*members.columns, "root", "component_id")
    alone = members.where("node is null").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return some.unionByName(alone)
