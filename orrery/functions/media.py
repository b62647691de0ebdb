"""Columns about files: metadata, paths, signatures, JSON forms, and progress of scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from orrery.functions.dates import local

#: Pixels, score, yaw and sharpness that faces of videos need, as the scan gets less strict.
RELAXED = ((44, 0.5, 0.65, 14), (36, 0.4, 0.85, 6), (28, 0.3, 1.5, 0))


def exif_date(original: Column, digitized: Column, changed: Column) -> Column:
    """Ms of the first that is a date like 2019:08:12 10:15:00, else 0."""
    tried = [F.try_to_timestamp(x, F.lit("yyyy:MM:dd HH:mm:ss")) for x in (original, digitized, changed)]
    return F.coalesce(F.unix_millis(F.coalesce(*tried)), F.lit(0))


def file_info(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """uri, name, size, readable of files (uri) by metadata (uri, name, size): a missing size can't be read, a missing or
    blank name is the last part of the uri."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.substring_index("uri", "/", -1), F.lit("")), F.lit("file"))
    found = files.select("uri").join(metadata, "uri", "left")
    return found.select("uri", name.alias("name"), F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce(F.col("size") >= 0, F.lit(False)).alias("readable"))


def display_path(uri: Column) -> Column:
    """storage/relative path of a folder's tree uri."""
    tree = F.url_decode(F.substring_index(uri, "/tree/", -1))
    volume, path = F.substring_index(tree, ":", 1), F.substring(tree, F.instr(tree, ":") + 1, 1 << 20)
    return F.concat_ws("/", F.when(volume == "primary", "Internal storage").otherwise(volume), F.nullif(path, F.lit("")))


def under_folder(path: Column, folder: str) -> Column:
    return path.startswith(folder.rstrip("/") + "/")


def signature(model: Column, prompts: Column) -> Column:
    """What a stored query vector is valid for."""
    return F.concat_ws("|", model, prompts)


def cover_key(uri: Column, is_video: Column, ts_ms: Column) -> Column:
    return F.when(is_video, F.concat(uri, F.lit("@"), ts_ms)).otherwise(uri)


def collection_to_row(collections: DataFrame) -> DataFrame:
    """prompts, seed and person_ids as JSON texts."""
    return collections.select("id", F.to_json("prompts").alias("prompts"), F.to_json("seed").alias("seed"), F.to_json("person_ids").alias("person_ids"))


def collection_from_row(rows: DataFrame) -> DataFrame:
    """The reverse; texts that don't parse are null."""
    seed = "embedding array<double>, uri string, timestamp_ms bigint"
    return rows.select("id", F.from_json("prompts", "array<string>").alias("prompts"), F.from_json("seed", seed).alias("seed"), F.from_json("person_ids", "array<bigint>").alias("person_ids"))


def good_when_relaxed(level: int, size: Column, score: Column, yaw: Column, sharpness: Column) -> Column:
    a, b, c, d = RELAXED[min(max(level, 0), 2)]
    return (size >= a) & (score >= b) & (yaw <= c) & (sharpness >= d)


def top_per(df: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group: clearest faces of a frame, a video's candidates, and so on."""
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place_") <= n).drop("place_")


def consecutive_days(photos: DataFrame, zone: str = "UTC") -> DataFrame:
    """day, n, keys of photos (key, ms), in order of time within each day of a zone."""
    day = local(F.col("ms"), zone).cast("date")
    x = photos.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ms", "key"))).alias("x"))
    return x.select("day", "n", F.transform("x", lambda p: p["key"]).alias("keys"))


def scan_totals(events: DataFrame) -> DataFrame:
    """total, processed, embedded, skipped, failed of events (status, frames): failures are skipped, too; a video embeds its
    frames but is processed once."""
    done, status = F.col("status") == "embedded", F.col("status")
    return events.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status != "waiting").alias("processed"), F.coalesce(F.sum(F.when(done, F.greatest("frames", F.lit(1)))), F.lit(0)).alias("embedded"),
        F.count_if(status.isin("skipped", "failed")).alias("skipped"), F.count_if(status == "failed").alias("failed"),
    )


def throughput(ticks: DataFrame) -> DataFrame:
    """key, ms, rate of ticks (key, ms, n): items a second since the tick before; null within 200 ms or without items."""
    w = Window.partitionBy("key").orderBy("ms")
    dt, dn = F.col("ms") - F.lag("ms").over(w), F.col("n") - F.lag("n").over(w)
    return ticks.select("key", "ms", F.when((dt > 200) & (dn > 0), dn * 1000 / dt).alias("rate"))


def time_left(ms: Column, done: Column, total: Column) -> Column:
    """Ms to go at the pace so far; null before 20 items and 8 seconds."""
    return F.when((done >= 20) & (ms >= 8000), F.round(ms / done * (total - done)).cast("long"))


@F.pandas_udf(BinaryType())
def blob_of(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def floats_of(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
