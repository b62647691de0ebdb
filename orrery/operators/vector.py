"""Exact vector search, self-calibrating collections and statistics of a vector index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How many rows of a block meet another block at once.
AT_ONCE = 256

#: How many collections are scored at once.
MOST_SPECS = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def content_is(is_video: Column, content: str | Column) -> Column:
    """images: stills only; videos: videos only; anything else: all."""
    content = F.lit(content) if isinstance(content, str) else content
    return F.when(content == "images", ~is_video).when(content == "videos", is_video).otherwise(F.lit(True))


def best_per_media(scored: DataFrame, *by: str) -> DataFrame:
    """The best-scoring row of each media item, the first stored on ties."""
    order = Window.partitionBy(*by, "media_key").orderBy(F.desc("score"), "ord")
    return scored.withColumn("best", F.row_number().over(order)).where("best = 1").drop("best")


def knn(index: DataFrame, query: DataFrame, k: int, content: str = "all", keys: DataFrame | None = None) -> DataFrame:
    """ord, media_key, score of the k best media for the one row ``q`` of query; keys: only these media_keys."""
    rows = index.where(content_is(F.col("is_video"), content))
    if keys is not None:
        rows = rows.join(keys.select("media_key").distinct(), "media_key", "left_semi")
    one = F.broadcast(query.select("q").limit(1))
    rows = rows.crossJoin(one).where(F.size("embedding") == F.size("q"))
    rows = rows.select("ord", "media_key", dot(F.col("embedding"), F.col("q")).alias("score"))
    return best_per_media(rows).orderBy(F.desc("score"), "ord").limit(max(k, 0))


def block_join(left: DataFrame, right: DataFrame, meet: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, size: int = 4096) -> DataFrame:
    """What meet(left ids, left vectors, right ids, right vectors) gives for all blocks of ``size`` rows of both sides (id, v).

    Every task holds two blocks, however many rows there are, of which AT_ONCE left rows meet all right ones at a time, so its
    products are small; meet sees each left row once for a block of right ones.  Vectors of other lengths than a block's left ones aren't met.
    """
    parts = [max(1, -(-x.count() // size)) for x in (left, right)]
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("v").alias("length")
    left = left.select("id", "v", length, part(parts[0]).alias("i"), each(parts[1]).alias("j"), F.lit(True).alias("is_left"))
    right = right.select("id", "v", length, each(parts[0]).alias("i"), part(parts[1]).alias("j"), F.lit(False).alias("is_left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.is_left.to_numpy(bool)
        if not own.any() or own.all():
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        ids, x = pdf.id.to_numpy(), np.stack(pdf.v.to_numpy()).astype(np.float64)
        left_ids, left, right_ids, right = ids[own], x[own], ids[~own], x[~own]
        return pd.concat([meet(left_ids[k : k + AT_ONCE], left[k : k + AT_ONCE], right_ids, right) for k in range(0, len(left), AT_ONCE)], ignore_index=True)

    return left.unionByName(right).groupBy("length", "i", "j").applyInPandas(run, schema)


def knn_many(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, ord, score: the k best rows of the index for each of any number of queries (query, q)."""

    def best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        order = np.argsort(ids, kind="stable")
        s = q @ x[order].T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query": np.repeat(asked, top.shape[1]), "ord": ids[order][top.ravel()], "score": np.take_along_axis(s, top, 1).ravel()})

    asked = queries.select(F.col("query").cast("long").alias("id"), F.col("q").alias("v"))
    found = block_join(asked, index.select(F.col("ord").alias("id"), F.col("embedding").alias("v")), best, "query long, ord long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def similar(index: DataFrame, ord_: int, most: int = 13, take: int = 10) -> DataFrame:
    """Media like a stored row: the best ``most`` without the row's own media, of which ``take`` are kept."""
    row = index.where(F.col("ord") == ord_)
    found = knn(index, row.select(F.col("embedding").alias("q")), most)
    return found.join(row.select("media_key"), "media_key", "left_anti").orderBy(F.desc("score"), "ord").limit(take)


def collection_members(index: DataFrame, specs: DataFrame) -> DataFrame:
    """Members of collections: spec_id, ord, media_key, score.

    specs (at most MOST_SPECS rows): spec_id, q, k, content, and unlimited (true: no threshold).  A row belongs when its
    score is mean + k * deviation or more, taken over the rows (frames) that pass the content filter; fewer than two rows
    or a deviation below 1e-6 give no members.  Membership is of media: the best row of each.  The index is read twice, each
    time with one matrix product for a batch: for the sums, and for the members; scores are never kept.
    """
    rows = specs.select("spec_id", "q", "k", "content", "unlimited").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} collections at once")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int, np.ndarray, np.ndarray]]:
        """(batch, place of the spec, rows that it looks at, their scores)."""
        for pdf in frames:
            sizes = pdf.embedding.map(lambda v: -1 if v is None else len(v)).to_numpy()
            for size in {len(r.q) for r in rows}:
                own, some = np.flatnonzero(sizes == size), [i for i, r in enumerate(rows) if len(r.q) == size]
                if not len(own):
                    continue
                s = np.stack(pdf.embedding.to_numpy()[own]).astype(np.float64) @ np.array([rows[i].q for i in some], np.float64).T
                video = pdf.is_video.to_numpy(bool)[own]
                for i, column in zip(some, s.T, strict=True):
                    looks = {"images": ~video, "videos": video}.get(rows[i].content, np.ones(len(own), bool))
                    yield pdf, i, own[looks], column[looks]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, i, _, s in scored(frames):
            yield pd.DataFrame({"spec": [i], "n": [len(s)], "total": [s.sum()], "squares": [(s * s).sum()]})

    source = index.select("ord", "media_key", "is_video", "embedding")
    found = source.mapInPandas(sums, "spec int, n long, total double, squares double").groupBy("spec").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    least = dict.fromkeys(range(len(rows)), math.inf)
    for r in found.collect():  # a row for each spec
        mean = r.total / r.n if r.n else 0.0
        deviation = math.sqrt(max(0.0, r.squares / r.n - mean * mean)) if r.n else 0.0
        if r.n >= 2 and deviation >= 1e-6:
            least[r.spec] = mean + rows[r.spec].k * deviation
    least |= {i: -math.inf for i, r in enumerate(rows) if r.unlimited}

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, i, own, s in scored(frames):
            keep = s >= least[i]
            yield pd.DataFrame({"spec_id": rows[i].spec_id, "ord": pdf.ord.to_numpy()[own[keep]], "media_key": pdf.media_key.to_numpy()[own[keep]], "score": s[keep]})

    return best_per_media(source.mapInPandas(members, f"spec_id {specs.schema['spec_id'].dataType.simpleString()}, ord long, media_key long, score double"), "spec_id")


def collection_summary(members: DataFrame, covers: int = 6) -> DataFrame:
    """spec_id, members and covers, the ords of its best members, best first."""
    order = Window.partitionBy("spec_id").orderBy(F.desc("score"), "ord")
    ranked = members.withColumn("place", F.row_number().over(order))
    best = F.sort_array(F.collect_list(F.when(F.col("place") <= covers, F.struct("place", "ord"))))
    return ranked.groupBy("spec_id").agg(F.count(F.lit(1)).alias("members"), F.transform(best, lambda x: x["ord"]).alias("covers"))


def centroid(vectors: DataFrame, by: str, v: str = "embedding") -> DataFrame:
    """by, centroid: normalised sum of normalised vectors of each group, component by component."""
    parts = vectors.select(by, F.posexplode(normalised(F.col(v))).alias("at", "x")).groupBy(by, "at").agg(F.sum("x").alias("x"))
    whole = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("parts"))
    return whole.select(by, normalised(F.transform("parts", lambda p: p["x"])).alias("centroid"))


def word_scores(index: DataFrame, ord_: int, words: DataFrame, top: int = 3) -> DataFrame:
    """word, score, bar of the words (word, q) that fit a stored row best; bar is relative to the best, from 0 to 1."""
    row = F.broadcast(index.where(F.col("ord") == ord_).select("embedding").limit(1))
    scored = words.crossJoin(row).where(F.size("embedding") == F.size("q")).select("word", dot(F.col("embedding"), F.col("q")).alias("score"))
    best = scored.orderBy(F.desc("score"), "word").limit(top)
    most = F.max("score").over(Window.partitionBy())
    return best.withColumn("bar", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(most > 0, F.col("score") / most).otherwise(0.0))))


def library_stats(index: DataFrame) -> DataFrame:
    still = F.when(~F.col("is_video"), F.col("media_key"))
    video = F.when(F.col("is_video"), F.col("media_key"))
    return index.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(still).alias("images"), F.countDistinct(video).alias("videos"))


def folder_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_video").alias("frames"))


def new_files(listed: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Listed files whose content hash isn't stored."""
    return listed.join(existing.select(key).distinct(), key, "left_anti")


def first_by(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("first_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("first_ = 1").drop("first_")


def new_first(items: DataFrame, fresh: DataFrame, key: str = "media_key") -> DataFrame:
    """Items with those of the latest scan in front, each part in its own order (column ord)."""
    mark = fresh.select(key).distinct().withColumn("fresh", F.lit(True))
    items = items.join(mark, key, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return items.orderBy(F.desc("fresh"), "ord")
