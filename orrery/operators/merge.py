"""Merging like people of a whole library, whatever blocks they were found in, and naming the faces of a frame.

People are merged in rounds: of all pairs that may be one, those merge where each is the other's best partner.  The best
pair of all is always such a pair, so rounds go on until none is left; a pair that shares a photo, also by what either
has taken in, stays apart.  Only pairs with a person that changed are compared anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.cluster import BEFORE_LINK, CLEAREST, Groups, Thresholds, unit
from orrery.operators.vector import AT_ONCE, block_join
from orrery.shared import written

#: Bytes of vectors in a block of people.
BLOCK_BYTES = 1 << 23
_PROFILE = "person long, n long, looks array<array<double>>, clear array<struct<rank:double,e:array<double>>>"


def profiles(faces: DataFrame, limits: Thresholds) -> DataFrame:
    """person, n, looks (sums of like vectors) and clear (the clearest faces) of good faces (person, id, rank, good, embedding).

    A person's faces come sorted, the clearest first, and are gone through as they come: a task holds their looks only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, groups = None, None

        def done() -> pd.DataFrame:
            looks = [x.tolist() for x in groups.sums[: groups.looks]]
            clear = [{"rank": float(r), "e": e.tolist()} for r, e in groups.clear[now]]
            return pd.DataFrame({"person": [now], "n": [groups.count[now]], "looks": [looks], "clear": [clear]})

        for pdf in frames:
            vectors = unit(np.stack(pdf.embedding.to_numpy()).astype(np.float64)) if len(pdf) else ()
            for person, rank, e in zip(pdf.person.tolist(), pdf["rank"].tolist(), vectors, strict=True):
                if person != now:
                    if groups:
                        yield done()
                    now, groups = person, Groups(len(e), limits)
                groups.learn(person, e, rank)
        if groups:
            yield done()

    rows = faces.where("good and person is not null and size(embedding) > 0").select("person", "rank", "id", "embedding")
    return rows.repartition("person").sortWithinPartitions("person", F.desc("rank"), "id").select("person", "rank", "embedding").mapInPandas(run, _PROFILE)


def like_pairs(changed: DataFrame, people: DataFrame, limits: Thresholds) -> DataFrame:
    """a, b (a < b), near: pairs of a changed and any person that are alike enough; near: of their most alike looks.

    Alike enough: looks at ``merge``, or looks at BEFORE_LINK and of three pairs of clear faces and more the best three at ``link``
    on average.  A task holds two blocks of about BLOCK_BYTES of vectors, of which AT_ONCE faces of whole people meet all others
    at a time, and only the like pairs leave it.
    """
    vectors = (F.flatten("looks").alias("looks"), F.flatten(F.transform("clear", lambda c: c["e"])).alias("faces"))
    sides = [x.select("person", F.size(F.col("looks")[0]).alias("length"), *vectors) for x in (changed, people)]
    parts = [max(1, -(-8 * (x.agg(F.sum(F.size("looks") + F.size("faces"))).first()[0] or 0) // BLOCK_BYTES)) for x in sides]
    part = lambda n: F.pmod(F.xxhash64("person"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].select("*", part(parts[0]).alias("i"), each(parts[1]).alias("j"), F.lit(True).alias("is_left"))
    right = sides[1].select("*", each(parts[0]).alias("i"), part(parts[1]).alias("j"), F.lit(False).alias("is_left"))

    def run(table: pa.Table) -> pa.Table:
        own = table["is_left"].to_numpy()
        n, found = table["length"][0].as_py(), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

        def side(some: np.ndarray) -> tuple[np.ndarray, ...]:
            rows = table.filter(pa.array(some))
            out = [rows["person"].to_numpy()]
            for c in ("looks", "faces"):
                lists = rows[c].combine_chunks()
                out += [lists.flatten().to_numpy().reshape(-1, n), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy() // n)])]
            out[1] = unit(out[1])
            return tuple(out)

        def places(ends: np.ndarray, none: int) -> np.ndarray:
            """Where each person's clear faces are, none for those that they lack."""
            at = ends[:-1, None] + np.arange(CLEAREST)
            return np.where(at < ends[1:, None], at, none)

        def meet(a: tuple, b: tuple, low: int, high: int) -> None:
            ids, looks, ends, faces, face_ends = a
            others, other_looks, other_ends, other_faces, other_face_ends = b
            near = looks[ends[low] : ends[high]] @ other_looks.T
            near = np.maximum.reduceat(np.maximum.reduceat(near, other_ends[:-1], axis=1), ends[low:high] - ends[low], axis=0)
            like = near >= limits.merge
            # The best three can be at ``link`` on average only where the best is.
            face = np.full((face_ends[high] - face_ends[low] + 1, len(other_faces) + 1), -9.0)
            face[:-1, :-1] = faces[face_ends[low] : face_ends[high]] @ other_faces.T
            i, j = np.nonzero(face >= limits.link - 1e-9)
            may = np.zeros_like(like)
            may[np.searchsorted(face_ends[low : high + 1] - face_ends[low], i, "right") - 1, np.searchsorted(other_face_ends, j, "right") - 1] = True
            may &= ~like & (near >= BEFORE_LINK) & (np.diff(face_ends[low : high + 1])[:, None] * np.diff(other_face_ends) >= 3)
            i, j = np.nonzero(may)
            rows, cols = places(face_ends[low : high + 1] - face_ends[low], len(face) - 1), places(other_face_ends, len(other_faces))
            for k in range(0, len(i), 1 << 14):
                p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                best = np.partition(face[rows[p][:, :, None], cols[q][:, None, :]].reshape(len(p), -1), (-3, -2, -1), axis=1)[:, -3:]
                like[p, q] = (best[:, 2] + best[:, 1] + best[:, 0]) / 3 >= limits.link
            i, j = np.nonzero(like)
            other = ids[low:high][i] != others[j]
            found.append((ids[low:high][i[other]], others[j[other]], near[i[other], j[other]]))

        if own.any() and not own.all():
            a, b = side(own), side(~own)
            step = max(1, AT_ONCE // CLEAREST)
            for low in range(0, len(a[0]), step):
                meet(a, b, low, min(low + step, len(a[0])))
        return pa.table(dict(zip(("a", "b", "near"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    met = left.unionByName(right).groupBy("length", "i", "j").applyInArrow(run, "a long, b long, near double")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("near").alias("near"))


def allowed(pairs: DataFrame, people: DataFrame, rejected: DataFrame) -> DataFrame:
    """a, b, near of the pairs that may be one: not both pinned or both named, not rejected."""
    side = lambda p: people.select(F.col("person").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("pinned", "named")))
    x = pairs.join(rejected.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    return x.where(~(F.col("pinned_a") & F.col("pinned_b")) & ~(F.col("named_a") & F.col("named_b"))).select("a", "b", "near")


def apart(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) without those that share a photo of photos (person, media_key)."""
    x = pairs.select("a", "b").join(photos.select(F.col("person").alias("a"), "media_key"), "a")
    both = x.join(photos.select(F.col("person").alias("b"), "media_key"), ["b", "media_key"], "left_semi").select("a", "b").distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def mutual(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, near) in which each is the other's best partner; of equally near ones that of smaller ids is best."""
    both = pairs.select(F.col("a").alias("own"), "a", "b", "near").union(pairs.select("b", "a", "b", "near"))
    best = both.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("near"), "a", "b"))).where("place = 1")
    return best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sides"), F.max("near").alias("near")).where("sides = 2").select("a", "b", "near")


def _absorbed(limits: Thresholds):
    """One profile of two: looks of both, the two most alike made one while there are too many, and the clearest faces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            looks, clear = [], []
            for r in pdf.itertuples():
                groups = Groups(len(r.looks[0]), limits)
                for look in [*r.looks, *r.other_looks]:
                    groups.put(groups.looks, 0, np.asarray(look))
                    groups.looks += 1
                groups.bound(0)
                looks.append([x.tolist() for x in groups.sums[: groups.looks]])
                faces = sorted([*r.clear, *r.other_clear], key=lambda c: -c["rank"])[:CLEAREST]
                clear.append([{"rank": c["rank"], "e": list(c["e"])} for c in faces])
            yield pd.DataFrame({"person": pdf.person, "n": pdf.n, "looks": looks, "clear": clear, "pinned": pdf.pinned, "named": pdf.named})

    return run


def merge_people(faces: DataFrame, people: DataFrame, rejected: DataFrame, limits: Thresholds) -> DataFrame:
    """person, into: everybody who merges, and who they are then.

    faces: person, id, media_key, rank, good, embedding; people: person, pinned, named (both may be missing for new ones);
    rejected: a, b with a < b.  Of two that merge the named one stays, else the pinned one, else the one with more good faces,
    else the larger id.  What a round leaves is written to the shared folder.
    """
    flags = people.select("person", "pinned", "named")
    own = profiles(faces, limits).join(flags, "person", "left")
    own = written(own.select("person", "n", "looks", "clear", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("pinned", "named"))))
    photos = written(faces.where("person is not null").select("person", "media_key").distinct())
    no = written(rejected.select("a", "b"))
    into = written(own.select("person", F.col("person").alias("into")))
    pairs = written(apart(allowed(like_pairs(own, own, limits), own, no), photos))
    while not pairs.isEmpty():
        side = lambda p: own.select(F.col("person").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("n", "pinned", "named")))
        first = lambda p, q: F.struct(F.col(f"named_{p}"), F.col(f"pinned_{p}"), F.col(f"n_{p}"), F.col(p)) > F.struct(F.col(f"named_{q}"), F.col(f"pinned_{q}"), F.col(f"n_{q}"), F.col(q))
        now = mutual(pairs).join(side("a"), "a").join(side("b"), "b").withColumn("a_stays", first("a", "b"))
        moved = written(now.select(F.when(F.col("a_stays"), F.col("a")).otherwise(F.col("b")).alias("kept"), F.when(F.col("a_stays"), F.col("b")).otherwise(F.col("a")).alias("gone")))
        named = moved.withColumnRenamed("gone", "person")
        photos = written(photos.join(named, "person", "left").select(F.coalesce("kept", "person").alias("person"), "media_key").distinct())
        into = written(into.join(moved.select(F.col("gone").alias("into"), "kept"), "into", "left").select("person", F.coalesce("kept", "into").alias("into")))
        both = own.join(moved.withColumnRenamed("kept", "person"), "person").join(own.select(F.col("person").alias("gone"), *(F.col(c).alias(f"other_{c}") for c in ("n", "looks", "clear", "pinned", "named"))), "gone")
        both = both.select("person", (F.col("n") + F.col("other_n")).alias("n"), "looks", "clear", "other_looks", "other_clear", *((F.col(c) | F.col(f"other_{c}")).alias(c) for c in ("pinned", "named")))
        changed = written(both.mapInPandas(_absorbed(limits), f"{_PROFILE}, pinned boolean, named boolean"))
        touched = moved.select(F.explode(F.array("kept", "gone")).alias("person"))
        own = written(own.join(touched, "person", "left_anti").unionByName(changed))
        # A rejected pair stays one when either of both has gone on into another.
        for c in ("a", "b"):
            no = no.join(moved.select(F.col("gone").alias(c), "kept"), c, "left").withColumn(c, F.coalesce("kept", c)).select("a", "b")
        no = written(no.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        old = pairs
        for c in ("a", "b"):
            old = old.join(touched.withColumnRenamed("person", c), c, "left_anti")
        pairs = written(old.select("a", "b", "near").unionByName(apart(allowed(like_pairs(changed, own, limits), own, no), photos)))
    return into.where("person <> into")


def regroup_all(faces: DataFrame, placed: DataFrame, people: DataFrame, rejected: DataFrame, limits: Thresholds) -> DataFrame:
    """id, person: faces that were placed block by block (placed: id, person), once people that are one in several blocks are merged."""
    rows = faces.drop("person").join(placed.select("id", "person"), "id")
    into = merge_people(rows, people, rejected, limits)
    return placed.join(into, "person", "left").select("id", F.coalesce("into", "person").alias("person"))


def name_frames(faces: DataFrame, looks: DataFrame, least: float) -> DataFrame:
    """frame, id, person, score: the faces of frames (frame, id, rank, embedding) that are somebody of looks (person, embedding).

    The clearest face of a frame chooses first; each takes the nearest person, by their nearest look at ``least`` or above,
    whom no face of its frame has taken before.  At the n-th face n-1 people are taken at most, so its n nearest are all that
    it needs.  Equal scores go to the smaller person.
    """
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("rank"), "id"))
    asked = faces.where("embedding is not null").select("frame", "id", "embedding", place.alias("place"))

    def meet(ids: np.ndarray, x: np.ndarray, people: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        near = x @ y.T
        i, j = np.nonzero(near >= least)
        return pd.DataFrame({"id": ids[i], "person": people[j], "score": near[i, j]}).groupby(["id", "person"], as_index=False).score.max()

    met = block_join(asked.select("id", F.col("embedding").alias("v")), looks.select(F.col("person").alias("id"), F.col("embedding").alias("v")), meet, "id long, person long, score double")
    best = met.groupBy("id", "person").agg(F.max("score").alias("score")).join(asked.select("frame", "id", "place"), "id")
    best = best.withColumn("order", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "person"))).where(F.col("order") <= F.col("place"))
    wants = best.groupBy("frame", "place", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "person", "score"))), lambda w: F.struct(w["person"].alias("person"), w["score"].alias("score"))).alias("wants"))
    queue = F.sort_array(F.collect_list(F.struct("place", "id", "wants")))

    def choose(taken: Column, face: Column) -> Column:
        free = F.filter(face["wants"], lambda w: ~F.exists(taken, lambda t: t["person"] == w["person"]))
        one = F.struct(face["id"].alias("id"), free[0]["person"].alias("person"), free[0]["score"].alias("score"))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(one))).otherwise(taken)

    start = F.expr("cast(array() as array<struct<id:bigint,person:bigint,score:double>>)")
    named = wants.groupBy("frame").agg(F.aggregate(queue, start, choose).alias("named"))
    return named.select("frame", F.inline("named"))

