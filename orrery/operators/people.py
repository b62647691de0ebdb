"""People in media: summaries, searches by who is in a picture, covers, pairs and merge suggestions.

faces: id, media_key, person_id, rank, good, locked, box_l/t/r/b, deferred; people: id, name, hidden, pinned;
photos: hash, uri, is_video, ts_ms; dates: key, taken_ms, src, junk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vector import block_join, first_by


#: People of moments that one batch of results holds, about.
PEOPLE_AT_ONCE = 1 << 18


def is_confident() -> Column:
    """Locked by hand, or good and not tiny."""
    wide = (F.col("box_r") - F.col("box_l") >= 0.04) | (F.col("box_b") - F.col("box_t") >= 0.04)
    return F.col("locked") | (F.col("good") & wide)


def confident(faces: DataFrame) -> DataFrame:
    return faces.where(is_confident())


def listed(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People that are shown: not hidden, and in two media or more."""
    often = faces.groupBy("person_id").agg(F.countDistinct("media_key").alias("n")).where("n >= 2")
    return people.where("not hidden").join(often, people["id"] == often["person_id"], "left_semi")


def reliable(dates: DataFrame) -> DataFrame:
    return dates.where(F.col("src").isin(1, 2, 3) & ~F.col("junk"))


def person_counts(people: DataFrame, faces: DataFrame) -> DataFrame:
    """id, name, n_faces, n_media of everyone with a face."""
    counts = faces.where("person_id is not null").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"), F.countDistinct("media_key").alias("n_media"))
    return people.join(counts, people["id"] == counts["person_id"]).select("id", "name", "hidden", "n_faces", "n_media")


def list_people(people: DataFrame, faces: DataFrame, hidden: bool = False) -> DataFrame:
    found = person_counts(people, faces).where((F.col("hidden") == hidden) & (F.col("n_media") >= 2))
    return found.select("id", "name", "n_faces", "n_media").orderBy(F.desc("n_media"), "id")


def person_summary(people: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    """One person, shown or not."""
    return person_counts(people.where(F.col("id") == person), faces.where(F.col("person_id") == person)).drop("hidden")


def sort_people(found: DataFrame, order: str) -> DataFrame:
    """most: by media; named: named ones first; name: A to Z without case, the unnamed last."""
    unnamed, most = F.col("name").isNull(), [F.desc("n_media"), "id"]
    return found.orderBy(*{"most": most, "named": [unnamed, *most], "name": [unnamed, F.lower("name"), *most]}[order])


def person_media(faces: DataFrame, person: int) -> DataFrame:
    """Best face of each of a person's media, clearest first."""
    best = first_by(faces.where(F.col("person_id") == person), ["media_key"], F.desc("rank"), "id")
    return best.select("media_key", "id", "rank").orderBy(F.desc("rank"), "id")


def media_hits(faces: DataFrame, chosen: list[int]) -> DataFrame:
    """media_key, rank, any, together, only for media with one of the chosen people.

    A repeated id makes together and only impossible, as the list is longer than the set of people found.
    """
    own = F.col("person_id").isin(chosen)
    hits = faces.groupBy("media_key").agg(F.countDistinct(F.when(own, F.col("person_id"))).alias("n"), F.count_if(~F.coalesce(own, F.lit(False))).alias("others"), F.max(F.when(own, F.col("rank"))).alias("rank"))
    together = F.col("n") == len(chosen)
    return hits.where("n > 0").select("media_key", "rank", F.lit(True).alias("any"), together.alias("together"), (together & (F.col("others") == 0)).alias("only"))


def people_media(faces: DataFrame, chosen: list[int], mode: str) -> DataFrame:
    """Media in the given mode (any, together, only; others find nothing), clearest first."""
    hits = media_hits(faces, chosen)
    found = hits.where(F.col(mode) if mode in ("any", "together", "only") else F.lit(False))
    return found.select("media_key", "rank").orderBy(F.desc("rank"), "media_key")


def people_counts(faces: DataFrame, chosen: list[int]) -> DataFrame:
    return media_hits(faces, chosen).agg(*(F.count_if(m).alias(f"n_{m}") for m in ("any", "together", "only")))


def together_within(seen: DataFrame, window_ms: int = 3000) -> DataFrame:
    """seen: video, ts_ms, person -> video, ts_ms, people seen in it from then until window_ms later.

    A stretch of a video as long as the window meets itself and the next one, so a long video is many groups.  Both come
    sorted to one task, which gives each moment its people at once; pairs of moment and person are never kept or dealt out.
    """
    stretch = F.floor(F.col("ts_ms") / window_ms)
    rows = seen.where("video is not null and ts_ms is not null").select("video", F.col("ts_ms").cast("long").alias("ts_ms"), "person", stretch.alias("own"))
    rows = rows.select("video", F.explode(F.array("own", F.col("own") - 1)).alias("stretch"), "ts_ms", "person", "own")

    def people(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The moments of one stretch, in batches of bounded size; rows are sorted by time."""
        ts, own = rows["ts_ms"].to_numpy(), (rows["own"].to_numpy() == rows["stretch"][0].as_py())
        known = pc.is_valid(rows["person"]).to_numpy(zero_copy_only=False)
        at, person = ts[known], rows["person"].drop_null().to_numpy()
        starts, found, held = [], [], 0

        def batch() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), rows.schema.field("person").type))
            return pa.RecordBatch.from_arrays([pa.array([rows["video"][0].as_py()] * len(starts), rows.schema.field("video").type), pa.array(starts, pa.int64()), lists], ["video", "ts_ms", "people"])

        moments = np.unique(ts[own])
        for start, i, j in zip(moments.tolist(), np.searchsorted(at, moments).tolist(), np.searchsorted(at, moments + window_ms, "right").tolist(), strict=True):
            starts.append(start)
            found.append(np.unique(person[i:j]))
            held += len(found[-1])
            if held > PEOPLE_AT_ONCE:
                yield batch()
                starts, found, held = [], [], 0
        if starts:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        now = None
        for rows in batches:
            keys = list(zip(rows["video"].to_pylist(), rows["stretch"].to_pylist(), strict=True))
            begins = [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else now)]
            for n, (k, end) in enumerate(zip([0, *begins], [*begins, len(keys)], strict=True)):
                if n and waiting:
                    yield from people(pa.Table.from_batches(waiting))
                    waiting = []
                if end > k:
                    waiting.append(rows.slice(k, end - k))
            now = keys[-1] if keys else now
        if waiting:
            yield from people(pa.Table.from_batches(waiting))

    kinds = {c: seen.schema[c].dataType.simpleString() for c in ("video", "person")}
    return rows.repartition("video", "stretch").sortWithinPartitions("video", "stretch", "ts_ms").mapInArrow(run, f"video {kinds['video']}, ts_ms long, people array<{kinds['person']}>")


def pair_photos(faces: DataFrame, photos: DataFrame, dates: DataFrame, a: int, b: int) -> DataFrame:
    """Still photos with reliable dates that show both people for sure, and how many faces they hold, by time."""
    own = F.col("person_id").isin(a, b)
    both = confident(faces).where(own).groupBy("media_key").agg(F.countDistinct("person_id").alias("n")).where(F.col("n") == len({a, b})).select("media_key")
    found = both.join(photos.where("not is_video"), F.col("media_key") == F.col("hash")).join(reliable(dates), F.col("media_key") == F.col("key"))
    counts = faces.join(both, "media_key", "left_semi").groupBy("media_key").agg(F.count(F.lit(1)).alias("n_faces"))
    return found.join(counts, "media_key").select("media_key", "uri", "taken_ms", "n_faces").orderBy("taken_ms", "media_key")


def person_stats(people: DataFrame, faces: DataFrame, photos: DataFrame, dates: DataFrame) -> DataFrame:
    """id, n_media, first_ms, last_ms of named, listed people over sure faces in dated still photos."""
    named = listed(people, faces).where("name is not null").select("id")
    rows = confident(faces).join(named, F.col("person_id") == named["id"], "left_semi").join(photos.where("not is_video"), F.col("media_key") == F.col("hash"), "left_semi")
    rows = rows.join(reliable(dates), F.col("media_key") == F.col("key"))
    return rows.groupBy(F.col("person_id").alias("id")).agg(F.countDistinct("media_key").alias("n_media"), F.min("taken_ms").alias("first_ms"), F.max("taken_ms").alias("last_ms"))


def face_scores(faces: DataFrame) -> DataFrame:
    """media_key, score: the three best ranks of a media item, of unsure faces 0.3 of it."""
    weight = F.col("rank") * F.when(is_confident(), 1.0).otherwise(0.3)
    rows = faces.where("person_id is not null").select("media_key", weight.alias("weight"))
    place = F.row_number().over(Window.partitionBy("media_key").orderBy(F.desc("weight")))
    return rows.withColumn("place", place).where("place <= 3").groupBy("media_key").agg(F.sum("weight").alias("score"))


def best_faces(faces: DataFrame) -> DataFrame:
    """person_id, id of each person's best face: good ones first, then the clearest."""
    return first_by(faces.where("person_id is not null"), ["person_id"], F.desc("good"), F.desc("rank"), "id").select("person_id", "id")


def stack_faces(faces: DataFrame, covers: DataFrame) -> DataFrame:
    """The two clearest faces of each person besides the cover (person_id, id)."""
    rows = faces.where("person_id is not null").join(covers, ["person_id", "id"], "left_anti")
    order = Window.partitionBy("person_id").orderBy(F.desc("rank"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 2").select("person_id", "id", "place")


def next_covers(faces: DataFrame, covers: DataFrame) -> DataFrame:
    """covers: person_id, cover, cover_count -> the same after a look at today's faces.

    A cover stays unless it is no longer the person's or max(5, a sixth) more faces came; then it is the newest id
    among the eight best faces other than the old cover.
    """
    order = Window.partitionBy("person_id").orderBy(F.desc("good"), F.desc("rank"), "id")
    own = faces.where("person_id is not null").join(covers, "person_id", "left")
    counted = own.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id") == F.col("cover")).alias("valid"), F.first("cover").alias("cover"), F.first("cover_count").alias("had"))
    pool = own.where(F.col("cover").isNull() | (F.col("id") != F.col("cover"))).withColumn("place", F.row_number().over(order)).where("place <= 8")
    newest = pool.groupBy("person_id").agg(F.max("id").alias("newest"))
    stays = F.coalesce(F.col("valid"), F.lit(False)) & (F.col("n") - F.col("had") < F.greatest(F.lit(5), F.floor(F.col("had") / 6)))
    x = counted.join(newest, "person_id", "left")
    return x.select("person_id", F.when(stays, F.col("cover")).otherwise(F.coalesce("newest", "cover")).alias("cover"), F.when(stays, F.col("had")).otherwise(F.col("n")).alias("cover_count"))


def deferred_photos(faces: DataFrame) -> DataFrame:
    """Media with faces that wait to be recognised, and how many."""
    return faces.where("deferred").groupBy("media_key").agg(F.count(F.lit(1)).alias("n"))


def missing_dates(faces: DataFrame, photos: DataFrame, dates: DataFrame) -> DataFrame:
    """media_key, uri of media with people whose date nobody has looked up."""
    rows = faces.where("person_id is not null").select("media_key").distinct().join(photos, F.col("media_key") == F.col("hash"))
    return rows.join(dates, F.col("media_key") == F.col("key"), "left_anti").select("media_key", "uri")


def date_progress(faces: DataFrame, dates: DataFrame) -> DataFrame:
    media = faces.where("person_id is not null").select("media_key").distinct()
    found = media.join(dates, F.col("media_key") == F.col("key"), "left")
    return found.agg(F.count(F.lit(1)).alias("n_media"), F.count_if(F.col("key").isNull()).alias("n_missing"))


def names_in(people: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """media_key, names of listed, named people who are surely in each still photo, clearest first."""
    named = listed(people, faces).where("name is not null")
    rows = confident(faces).join(named.select(F.col("id").alias("person_id"), "name"), "person_id").join(photos.where("not is_video"), F.col("media_key") == F.col("hash"), "left_semi")
    once = first_by(rows, ["media_key", "person_id"], F.desc("rank"), "id")
    names = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "id", "name")))
    return once.groupBy("media_key").agg(names.alias("x")).select("media_key", F.transform("x", lambda x: x["name"]).alias("names"))


def person_photos_between(faces: DataFrame, dates: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Each person's best dated media item in [start_ms, end_ms); unsure faces count 0.3."""
    rows = faces.where("person_id is not null").join(reliable(dates), F.col("media_key") == F.col("key")).where(F.col("taken_ms").between(start_ms, end_ms - 1))
    rows = rows.withColumn("weight", F.col("rank") * F.when(is_confident(), 1.0).otherwise(0.3))
    return first_by(rows, ["person_id"], F.desc("weight"), "taken_ms", "id").select("person_id", "media_key", "weight")


def merge_suggestions(centroids: DataFrame, rejected: DataFrame, together: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of pairs of groups (id, centroid) that may be one person, best first.

    All groups are compared with all, in blocks that give pairs at ``least`` or above.  Pairs that were rejected, or that
    appear in one picture (both tables: a < b), are left out.
    """

    def near(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        s = x @ y.T
        i, j = np.nonzero((s >= least) & (a[:, None] < b))
        return pd.DataFrame({"a": a[i], "b": b[j], "similarity": s[i, j]})

    groups = centroids.select("id", F.col("centroid").alias("v"))
    pairs = block_join(groups, groups, near, "a long, b long, similarity double")
    pairs = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs.join(rejected, ["a", "b"], "left_anti").join(together, ["a", "b"], "left_anti").orderBy(F.desc("similarity"), "a", "b")
