"""Exact top-k by three-phase uniform threshold over vertical fragments of integer vectors.

The dimensions are split into ``lists`` fragments; a query's score list of a fragment has, for each row, the
inner product of that fragment alone.  A row's score is the sum over its lists.

1. Every list gives its k best entries.  The exact scores of the rows met so have a k-th best, t: a safe cutoff.
2. t goes to all lists, and each gives its entries of t / lists and more.  A row with no such entry scores
   below t.  Rows met in all lists are known exactly; with t they give a better cutoff, t'.
3. Of the other rows those whose upper bound (what is known, and t / lists for each missing list) reaches t'
   are resolved exactly from their vectors.

Lists are computed in blocks of at most ``ROWS`` rows and ``QUERIES`` queries.  Cutoffs reach the blocks by a
join, since there are as many as queries; cutoffs are compared as whole numbers, ``score >= ceil(t / lists)``.

Defined results: vectors that are null or that hold a null or non-finite component, and rows without an id, take no part; vectors of
different length aren't compared; empty vectors score 0 with one another; equal scores are ordered by the
smaller id; rows that repeat an id count once, by their best vector; an empty table gives no rows.  Components,
and ``lists`` times scores, have to fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.cross_polytope import blocks
from orrery.llm.cut import cut
from orrery.shipping import ship


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _fragments(vectors: DataFrame, lists: int, *more: str) -> DataFrame:
    """id, v -> size, f, id, v for each fragment f of v."""
    size, f = F.size("v"), F.col("f")
    begin = lambda f: F.floor(f * size / lists).cast("int")
    x = vectors.select(size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("f"), "id", "v", *more)
    return x.withColumn("v", F.slice("v", begin(f) + 1, begin(f + 1) - begin(f)))


def _entries(k: int, lists: int):
    """Each query's entries of a block: its k best, or (k is 0) those that reach its cutoff, where it has one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf.is_query.to_numpy()
        found = []
        if ask.any() and not ask.all():
            x, ids = np.stack(pdf.v.to_numpy()).astype(np.int64), pdf.id.to_numpy()
            order = np.flatnonzero(~ask)[np.argsort(ids[~ask], kind="stable")]
            rows, row_ids = x[order], ids[order]
            scores = products(x[ask], rows)
            # Neither column has nulls: whole numbers over 2**53 would come as doubles.
            for query, s, cutoff, bound in zip(ids[ask].tolist(), scores, pdf.cutoff[ask].tolist(), pdf.bound[ask].tolist(), strict=True):
                if k:
                    least = np.partition(s, -k - 1)[-k - 1] if len(s) > k + 1 else s.min()
                    some = np.flatnonzero(s >= least)
                    some = some[row_ids[some] != query]
                    some = some[np.argsort(-s[some], kind="stable")[:k]]
                else:
                    # s >= cutoff / lists, in numbers that can't overflow
                    some = np.flatnonzero((row_ids != query) & ((s >= -(-cutoff // lists)) | (not bound)))
                found.append(pd.DataFrame({"f": pdf.f.iloc[0], "query_id": query, "vec_id": row_ids[some], "score": s[some]}))
        return pd.concat(found) if found else pd.DataFrame({"f": [], "query_id": [], "vec_id": [], "score": []})

    return run


def _best(scored: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, lists: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score for vectors and queries of id (long), v (array<long>; null: takes no part)."""
    ship(vectors.sparkSession)
    vectors, queries = (x.where("v is not null and id is not null").select("id", "v") for x in (vectors, queries))
    rows, asked = _fragments(vectors, lists), _fragments(queries, lists)
    key, entry = ["size", "f"], "f int, query_id long, vec_id long, score long"

    def gathered(asked: DataFrame, k: int) -> DataFrame:
        """asked: id, v, bound (whether there is a cutoff) and cutoff of each fragment of a query."""
        dealt = blocks(rows, asked, key)
        cutoffs = asked.select("id", "bound", "cutoff").distinct()
        none = dealt.where("not is_query").withColumn("bound", F.lit(False)).withColumn("cutoff", F.lit(0).cast("long"))
        dealt = none.unionByName(dealt.where("is_query").join(cutoffs, "id"))
        return dealt.groupBy(*key, "i", "j").applyInPandas(_entries(k, lists), entry)

    def resolved(pairs: DataFrame) -> DataFrame:
        """Exact scores of query_id, vec_id."""
        x = pairs.join(vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id")
        x = x.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").where(F.size("x") == F.size("q"))
        return x.groupBy("query_id", "vec_id").agg(F.max(inner(F.col("x"), F.col("q"))).alias("score"))

    first = gathered(asked.withColumn("bound", F.lit(False)).withColumn("cutoff", F.lit(0).cast("long")), k)
    met = cut(resolved(_best(first, k, "query_id", "f").select("query_id", "vec_id").distinct()))
    safe = cut(_best(met, k, "query_id").where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")))
    bounds = asked.join(safe, "id", "left").withColumn("bound", F.col("cutoff").isNotNull()).withColumn("cutoff", F.coalesce("cutoff", F.lit(0)))
    entries = gathered(bounds, 0)
    entries = entries.groupBy("query_id", "vec_id", "f").agg(F.max("score").alias("score"))
    known = cut(entries.groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")))
    exact = met.unionByName(known.where(F.col("n") == lists).select("query_id", "vec_id", "score"))
    exact = exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    exact = cut(_best(exact, k, "query_id"))
    better = exact.where(F.col("rank") == k).select("query_id", F.col("score").alias("better"))
    open_ = known.where(F.col("n") < lists).join(better, "query_id", "left").join(safe.withColumnRenamed("id", "query_id"), "query_id", "left")
    upper = lists * F.col("score") + (lists - F.col("n")) * F.col("cutoff")
    open_ = open_.where(F.col("cutoff").isNull() | F.col("better").isNull() | (upper >= lists * F.col("better")))
    late = resolved(open_.select("query_id", "vec_id"))
    scored = exact.select("query_id", "vec_id", "score").unionByName(late).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best(scored, k, "query_id").select("query_id", "rank", "vec_id", "score")
