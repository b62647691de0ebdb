"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform (vectors are padded to a power
of two).  One hash of a vector is the signed axis nearest to the rotated unit vector; a table's code is made of one or two
such axes.  A query looks in each table at its ``probes`` best codes, those with the largest sums of coordinates; all
it meets is ranked by the exact Euclidean distance of the original vectors.

How many axes and probes: ``fit_index`` finds the true neighbours of ``SAMPLE`` queries among all rows, and counts how many
probes it takes to meet the wanted share of them, so width and norms of the vectors are seen.  Of one and two axes those
are taken that look at fewer rows, by a sample of ``16 * SAMPLE`` rows.

Codes are dealt by hash to blocks, and a block with more than ``ROWS`` rows (equal vectors, say) or ``QUERIES`` queries
is split, so that each task compares bounded numbers and returns each query's k nearest ids, not the pairs.
Queries that met fewer than k rows look again at all rows, which is exact.

Defined results: vectors that are null, empty, all zero, or that hold a null or non-finite component take no
part, as rows or as queries; vectors of different length aren't compared; equal distances are ordered by the
smaller id; rows that repeat an id count once, by their nearest vector; a query isn't its own neighbour; an
empty table, or one without queries, gives no rows; queries of a length that the sample lacks look at all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.cut import cut
from orrery.llm.text import mix
from orrery.shipping import ship

ROWS, QUERIES, SAMPLE = 8192, 1024, 64


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(-1, n)


def rotations(vectors: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """The rotated unit vectors of each table."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / peak
    unit = np.pad(unit / np.linalg.norm(unit, axis=1, keepdims=True), ((0, 0), (0, width - vectors.shape[1])))
    for table in range(tables):
        signs = np.random.Generator(np.random.PCG64([seed, table, width])).integers(0, 2, (3, width)) * 2 - 1
        x = unit
        for s in signs:
            x = hadamard(x * s) / np.sqrt(width)
        yield x


def signed(rotated: np.ndarray) -> np.ndarray:
    """Coordinates on the signed axes: 2 i + 1 for axis i, 2 i for its opposite."""
    return np.stack([-rotated, rotated], axis=2).reshape(len(rotated), -1)


def coordinates(vectors: np.ndarray, tables: int, depth: int, seed: int) -> Iterator[list[np.ndarray]]:
    """For each table the coordinates on the signed axes of its ``depth`` rotations."""
    found = map(signed, rotations(vectors, tables * depth, seed))
    return (list(islice(found, depth)) for _ in range(tables))


def codes(own: list[np.ndarray]) -> np.ndarray:
    """The code of each row: the nearest axis of each rotation."""
    code = np.zeros(len(own[0]), np.int64)
    for x in own:
        code = code * x.shape[1] + x.argmax(axis=1)
    return code


def probe_codes(own: list[np.ndarray], probes: int) -> np.ndarray:
    """The codes with the largest sums of coordinates of each row."""
    width = own[0].shape[1]
    if len(own) == 1:
        return np.argsort(-own[0], axis=1, kind="stable")[:, :probes]
    # The i-th best axis and the j-th best of the other are among the best pairs only if (i + 1) (j + 1) <= probes.
    i, j = (x.ravel() for x in np.meshgrid(*[np.arange(min(width, probes))] * 2, indexing="ij"))
    i, j = i[few := (i + 1) * (j + 1) <= probes], j[few]
    first, second = (np.argsort(-x, axis=1, kind="stable")[:, :probes] for x in own)
    a, b = first[:, i], second[:, j]
    best = np.argsort(-(np.take_along_axis(own[0], a, 1) + np.take_along_axis(own[1], b, 1)), axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(a * width + b, best, 1)


def probes_needed(own: list[np.ndarray], row: int, code: np.ndarray) -> np.ndarray:
    """How many probes a query (a row of own) needs to look at codes: how many codes are as good or better, up to rounding."""
    width = own[0].shape[1]
    if len(own) == 1:
        return (own[0][row] > own[0][row][code][:, None]).sum(axis=1) + 1
    x, y = own[0][row], np.sort(own[1][row])
    sums = x[code // width] + own[1][row][code % width]
    return width * width - np.searchsorted(y, sums[:, None] - x - 1e-12, "right").sum(axis=1)


def _exact(vectors: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """Vectors of the k nearest rows of a bounded number of queries, by place of the query and by length."""

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            for size, ids, x in _by_size(batch):
                for i, (own, q) in enumerate(asked):
                    if len(q) == size:
                        have = best.get(i, (np.empty(0, np.int64), np.empty((0, size)), np.empty(0)))
                        some = ids != own
                        ids_, x_ = np.concatenate([have[0], ids[some]]), np.concatenate([have[1], x[some]])
                        d = np.concatenate([have[2], ((x[some] - q) ** 2).sum(axis=1)])
                        order = np.lexsort((ids_, d))
                        keep = order[np.sort(np.unique(ids_[order], return_index=True)[1])[:k]]
                        best[i] = ids_[keep], x_[keep], d[keep]
        rows = [(i, float(d), int(n), v.tolist()) for i, (ids, x, far) in best.items() for n, v, d in zip(ids, x, far, strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(("i", "d", "id", "v"), r, strict=True)) for r in rows], schema=pa.schema([("i", pa.int32()), ("d", pa.float64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))]))

    found = vectors.mapInArrow(run, "i int, d double, id long, v array<double>").groupBy("i", "id").agg(F.min_by("v", "d").alias("v"), F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "id"))
    out: dict[int, list[np.ndarray]] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # at most k for each of the sampled queries
        out.setdefault(r.i, []).append(np.array(r.v))
    return out


def fit_index(vectors: DataFrame, queries: DataFrame, *, k: int, tables: int, recall: float, seed: int, sample: int = SAMPLE) -> dict[int, tuple[int, int]]:
    """(axes, probes) for each length of the sampled queries; vectors and queries: id, v without odd ones."""
    chosen = lambda df, n: [(r.id, np.array(r.v, float)) for r in df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()]
    asked, rows = chosen(queries, sample), chosen(vectors, 16 * sample)
    near, plans = _exact(vectors, asked, k) if asked else {}, {}
    for size in sorted({len(q) for _, q in asked}):
        own = [i for i, (_, q) in enumerate(asked) if len(q) == size and i in near]
        if not own:
            continue
        q, others = np.stack([asked[i][1] for i in own]), np.stack([v for _, v in rows if len(v) == size] or [asked[own[0]][1]])
        tries = []
        for depth in (1, 2):
            need = [np.full(len(near[i]), 1 << 62) for i in own]
            looks = []
            both = (coordinates(x, tables, depth, seed) for x in (q, np.concatenate([np.stack(near[i]) for i in own]), others))
            ends = np.cumsum([len(near[i]) for i in own])[:-1]
            for mine, theirs, rest in zip(*both, strict=True):
                for row, code in enumerate(np.split(codes(theirs), ends)):
                    need[row] = np.minimum(need[row], probes_needed(mine, row, code))
                looks.append(np.stack([probes_needed(mine, row, codes(rest)) for row in range(len(own))]))
            probes = int(np.sort(np.concatenate(need))[max(0, math.ceil(recall * sum(map(len, need))) - 1)])
            tries.append((float(np.mean([(x <= probes).mean() for x in looks])), depth, probes))
        plans[size] = min(tries)[1:]
    return plans


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors in double precision) of up to 1,024 rows of id, v."""
    ids, lists = batch.column("id").to_numpy(), batch.column("v")
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), 1024):
            rows = own[at : at + 1024]
            yield int(size), ids[rows], flat[(ends[rows] - size)[:, None] + np.arange(size)].astype(float)


def _hashed(vectors: DataFrame, plans: dict[int, tuple[int, int]], tables: int, seed: int, n_blocks: int, asked: bool) -> DataFrame:
    """id, v -> size, t, b, id, v, codes: a row for each table, and for each block where a query has codes.

    A length without a plan has one table and one code.
    """
    kind = vectors.schema["v"].dataType.simpleString()
    number = pa.float32() if kind == "array<float>" else pa.float64()

    def run(batches):
        for batch in batches:
            for size, ids, x in _by_size(batch):
                depth, probes = plans.get(size, (1, 0))
                for t, own in enumerate(coordinates(x, tables if probes else 1, depth, seed)):
                    found = probe_codes(own, probes) if asked and probes else codes(own)[:, None] * bool(probes)
                    block = (mix(found.astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)
                    order = np.argsort(block, axis=1, kind="stable")
                    block, found = np.take_along_axis(block, order, 1), np.take_along_axis(found, order, 1)
                    new = np.ones(block.shape, bool)
                    new[:, 1:] = block[:, 1:] != block[:, :-1]
                    row, _ = np.nonzero(new)
                    begin = np.append(np.flatnonzero(new), found.size).astype(np.int32)
                    n = len(row)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x[row].ravel(), number))
                    held = pa.ListArray.from_arrays(pa.array(begin), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(block[new].astype(np.int32)), pa.array(ids[row]), v, held], names=["size", "t", "b", "id", "v", "codes"])

    return vectors.mapInArrow(run, f"size int, t int, b int, id long, v {kind}, codes array<long>")


def blocks(rows: DataFrame, queries: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Rows and queries of a key, dealt to blocks (key, i, j); is_query tells them apart."""
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("of_rows"))
    asked = queries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("of_queries"))
    parts = cut(parts.join(asked, key))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.join(parts, key).withColumn("i", part(F.col("of_rows"))).withColumn("j", each(F.col("of_queries")))
    queries = queries.join(parts, key).withColumn("j", part(F.col("of_queries"))).withColumn("i", each(F.col("of_rows")))
    names = [*key, "i", "j", "id", "v", *more]
    return rows.select(*names, F.lit(False).alias("is_query")).unionByName(queries.select(*names, F.lit(True).alias("is_query")))


def nearest(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k other ids nearest to q; rough: squared distances that may be off by rounding."""
    others, rough = ids != query, np.where(ids == query, np.inf, rough)
    some, take = np.flatnonzero(others), k
    while take < len(rough):
        limit = np.partition(rough, take - 1)[take - 1]
        if not np.isfinite(limit):
            break
        if len(np.unique(ids[rough <= limit])) >= k:
            some = np.flatnonzero(others & (rough <= limit + 1e-9 * (abs(limit) + (q * q).sum())))
            break
        take *= 4
    exact = np.sqrt(((x[some] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[some], exact))
    _, first = np.unique(ids[some][order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[some][order], exact[order]


def _nearest_of_block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf.is_query.to_numpy()
        found = []
        if ask.any() and not ask.all():
            rows = pdf[~ask]
            code = np.concatenate(rows.codes.to_numpy())
            order = np.argsort(code, kind="stable")
            code, ids, x = code[order], rows.id.to_numpy()[order], np.stack(rows.v.to_numpy())[order].astype(float)
            square = (x**2).sum(axis=1)
            for query, q, wanted in zip(pdf.id[ask].tolist(), pdf.v[ask], pdf.codes[ask], strict=True):
                q = q.astype(float)
                some = np.sort(wanted)
                begin, end = np.searchsorted(code, some, "left"), np.searchsorted(code, some, "right")
                size = end - begin
                to = np.cumsum(size)
                if not to[-1]:
                    continue
                met = np.repeat(begin - (to - size), size) + np.arange(to[-1])
                near, score = nearest(ids[met], x[met], query, q, square[met] + q @ q - 2 * x[met] @ q, k)
                found.append(pd.DataFrame({"query_id": query, "vec_id": near, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def _search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = blocks(rows, queries, ["size", "t", "b"], "codes").groupBy("size", "t", "b", "i", "j").applyInPandas(_nearest_of_block(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 10, tables: int = 8, recall: float = 0.97, seed: int = 7, plans: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for vectors and queries of id (long), v (array of numbers).

    plans: what ``fit_index`` gave; else it is fitted here, for a recall of about ``recall``.  Rows and queries without an id
    take no part.
    """
    ship(vectors.sparkSession)
    kept = lambda x: F.col("v") if dict(x.dtypes)["v"] == "array<float>" else F.col("v").cast("array<double>").alias("v")
    vectors, queries = (x.where(usable(F.col("v")) & F.col("id").isNotNull()).select("id", kept(x)) for x in (vectors, queries))
    plans = fit_index(vectors, queries, k=k, tables=tables, recall=recall, seed=seed) if plans is None else plans
    n_blocks = max(1, -(-vectors.count() // ROWS))
    found = cut(_search(_hashed(vectors, plans, tables, seed, n_blocks, False), _hashed(queries, plans, tables, seed, n_blocks, True), k))
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    again = cut(queries.join(enough, "id", "left_anti"))
    if again.isEmpty():
        return found
    whole = _search(*(_hashed(x, {}, 1, seed, 1, False) for x in (vectors, again)), k)
    return found.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)
