"""The library's tables as they change: photos, frames and videos with their faces, what was seen, key-value state.

Like ``state``, every function gives a new version of the tables.  Batches are as large as a user's scan, tables as large
as the library: ids are numbered in two levels, and deletions are anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.people import listed
from orrery.operators.state import insert_missing, upsert

#: How many blocks the hashes of media are dealt to when new faces are numbered.
BLOCKS = 4096
#: Fixed value: what a photo has in the columns that an insert doesn't name.
PHOTO_DEFAULTS = {"complete": False, "deferred": 0}


def delete_where(table: DataFrame, gone: Column) -> DataFrame:
    """Rows for which the predicate isn't true (a null doesn't delete)."""
    return table.where(~F.coalesce(gone, F.lit(False)))


def emptied(*tables: DataFrame) -> list[DataFrame]:
    return [t.where(F.lit(False)) for t in tables]


def numbered(faces: DataFrame, last: DataFrame, key: str = "media_key", place: str = "place") -> DataFrame:
    """faces with id: after the largest id of ``last`` (one row, column id), in the order of blocks, keys and places."""
    faces = faces.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(BLOCKS)))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = faces.groupBy("block_").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("block_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))  # at most BLOCKS rows
    rank = F.row_number().over(Window.partitionBy("block_").orderBy(key, place))
    faces = faces.withColumn("rank_", rank).join(F.broadcast(base), "block_").crossJoin(F.broadcast(last.select(F.coalesce("id", F.lit(0)).alias("last_")).limit(1)))
    return faces.withColumn("id", F.col("last_") + F.col("base_") + F.col("rank_")).drop("block_", "base_", "rank_", "last_")


def insert_photos(photos: DataFrame, faces: DataFrame, new: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """photos and faces with new photos (hash and others) and the faces found in them (media_key, place, ...).

    A photo of a known hash is replaced, its unnamed columns by defaults; old faces stay until they are deleted.
    """
    for name, value in PHOTO_DEFAULTS.items():
        if name in photos.columns and name not in new.columns:
            new = new.withColumn(name, F.lit(value).cast(photos.schema[name].dataType))
    own = numbered(found, faces.agg(F.max("id").alias("id"))).drop("place")
    return upsert(photos, new, ["hash"]), faces.unionByName(own, allowMissingColumns=True)


def delete_inside(frames: DataFrame, faces: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames (hash, video_hash) and faces (media_key) without what belongs to videos (video_hash)."""
    gone = frames.join(videos.select("video_hash").distinct(), "video_hash", "left_semi").select(F.col("hash").alias("media_key"))
    kept = frames.join(videos.select("video_hash").distinct(), "video_hash", "left_anti")
    return kept, faces.join(gone, "media_key", "left_anti")


def insert_videos(videos: DataFrame, frames: DataFrame, faces: DataFrame, new: DataFrame, new_frames: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables with new videos (video_hash, uri) instead of what was known of them; they are exact from now on."""
    kept_frames, kept_faces = delete_inside(frames, faces, new)
    kept_frames, kept_faces = insert_photos(kept_frames, kept_faces, new_frames, found)
    return upsert(videos, new.withColumn("exact", F.lit(1)), ["video_hash"]), kept_frames, kept_faces


def store_looked_frames(videos: DataFrame, frames: DataFrame, faces: DataFrame, new: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames somebody looked at (hash, video_hash, uri): their video is added if it isn't known (exact 2), they are complete."""
    seen = new.select("video_hash", "uri").withColumn("exact", F.lit(2))
    frames, faces = insert_photos(frames, faces, new.withColumn("complete", F.lit(True)), found)
    return insert_missing(videos, seen, ["video_hash"]), frames, faces


def mark_scanned(videos: DataFrame, done: DataFrame) -> DataFrame:
    """videos with those of done (video_hash, uri) exact; unknown ones are added."""
    added = insert_missing(videos, done.withColumn("exact", F.lit(1)), ["video_hash"])
    mine = done.select("video_hash").distinct().withColumn("done_", F.lit(True))
    return added.join(mine, "video_hash", "left").withColumn("exact", F.when(F.col("done_"), 1).otherwise(F.col("exact"))).drop("done_")


def mark_complete(photos: DataFrame, done: DataFrame) -> DataFrame:
    mine = done.select("hash").distinct().withColumn("done_", F.lit(True))
    return photos.join(mine, "hash", "left").withColumn("complete", F.coalesce("done_", "complete")).drop("done_")


def fill_vectors(faces: DataFrame, found: DataFrame) -> DataFrame:
    """faces with the vectors of found (id, embedding): these faces are recognised now, and wait no longer."""
    own = found.select("id", F.col("embedding").alias("found_")).dropDuplicates(["id"])
    rows = faces.join(own, "id", "left").withColumn("embedding", F.coalesce("found_", "embedding"))
    return rows.withColumn("deferred", F.when(F.col("found_").isNotNull(), False).otherwise(F.col("deferred"))).drop("found_")


def record_seen(seen: DataFrame, new: DataFrame) -> DataFrame:
    """Who was seen when (uri, ts_ms, person), each once."""
    return insert_missing(seen, new, ["uri", "ts_ms", "person"])


def latest_scan(before: DataFrame, scanned: DataFrame) -> DataFrame:
    """uri, at: the scanned uris in the order in which they came first; an empty scan leaves the one before."""
    own = scanned.groupBy("uri").agg(F.min("at").alias("at"))
    some = own.agg((F.count(F.lit(1)) > 0).alias("some"))
    old = before.select("uri", "at").crossJoin(F.broadcast(some)).where("not some").drop("some")
    return own.unionByName(old)


def stats(photos: DataFrame, people: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: photos, faces, people that are shown."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(photos, "photos").crossJoin(one(faces, "faces")).crossJoin(one(listed(people, faces), "people"))


def frame_rows(faces: DataFrame, chosen: list[int]) -> DataFrame:
    """media_key, people (of the chosen ones), others (faces of anybody else), rank: best of the chosen, for media that show one."""
    own = F.coalesce(F.col("person_id").isin(chosen), F.lit(False))
    x = faces.groupBy("media_key").agg(F.sort_array(F.collect_set(F.when(own, F.col("person_id")))).alias("people"), F.count_if(~own).alias("others"), F.max(F.when(own, F.col("rank"))).alias("rank"))
    return x.where("size(people) > 0")


def has_work(index: DataFrame, processed: DataFrame, waiting: DataFrame, key: str = "media_key") -> DataFrame:
    """One row: work, whether media of the index aren't processed, or faces wait."""
    new = index.select(key).join(processed.select(key), key, "left_anti").limit(1)
    return new.select(F.lit(1).alias("x")).unionByName(waiting.limit(1).select(F.lit(1).alias("x"))).agg((F.count(F.lit(1)) > 0).alias("work"))


def get_meta(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, value of the wanted keys; null without one."""
    return wanted.select("key").join(meta, "key", "left")


def set_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(meta, new, ["key"])


def wiped_meta(meta: DataFrame) -> DataFrame:
    """What stays of key-value state when everything is looked through again."""
    return meta.where(~F.col("key").startswith("video_relax_") & ~F.col("key").startswith("video_fail_"))


def resolve_dates(pending: DataFrame, known: DataFrame, read: DataFrame, batch: int) -> DataFrame:
    """key, taken_ms, src of the first ``batch`` pending keys: known dates, else those read from the files, else (0, 0)."""
    own = pending.select("key").orderBy("key").limit(batch)
    rename = lambda df, n: df.select("key", F.struct("taken_ms", "src").alias(n))
    x = own.join(rename(known, "a"), "key", "left").join(rename(read, "b"), "key", "left")
    found = F.coalesce("a", "b", F.struct(F.lit(0).cast("long").alias("taken_ms"), F.lit(0).alias("src")))
    return x.select("key", found.alias("f")).select("key", "f.taken_ms", "f.src")


def scan_path(uri: Column) -> Column:
    """The relative path by which a folder can be scanned from the media index: on the main volume and not under Android/;
    null where its files have to be walked."""
    tree = F.url_decode(F.regexp_extract(uri, "/tree/([^/]*)", 1))
    path = F.regexp_replace(F.substring(tree, F.instr(tree, ":") + 1, 1 << 20), "^/+|/+$", "")
    fine = (F.substring_index(tree, ":", 1) == "primary") & (path != "") & ~F.lower(F.concat(path, F.lit("/"))).startswith("android/")
    return F.when(fine, F.concat(path, F.lit("/")))
