"""The append-only vector log: big-endian records behind a short head, read and written with DataFrames.

A record: length and UTF-8 bytes of the path, the same of the folder, hash (long), the same of the video's path (empty:
a photo), time (long), dim floats.  A half-written record at the end is left for the next reading.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The log's first bytes and version.
MAGIC, VERSION, LONGEST = b"EMBD", 2, 1 << 20
SCHEMA = "file string, ord long, next_offset long, image_path string, folder_id string, hash long, video_uri string, timestamp_ms long, embedding array<float>"


def head(dim: int) -> bytes:
    return MAGIC + struct.pack(">ii", VERSION, dim)


def record(path: str, folder: str, hash_: int, video: str | None, ts_ms: int, vector: list[float]) -> bytes:
    texts = [x.encode() for x in (path, folder, video or "")]
    a, b, c = (struct.pack(">i", len(x)) + x for x in texts)
    return a + b + struct.pack(">q", hash_) + c + struct.pack(">q", ts_ms) + np.asarray(vector, ">f4").tobytes()


def records(data: bytes, offset: int, dim: int, vectors: bool = True) -> Iterator[tuple]:
    """(next offset, path, folder, hash, video, ts, vector or None) from a boundary on.

    Ends where a record is half-written, or where a length can't be one: what comes before it is given.
    """

    def text(at: int) -> tuple[str | None, int]:
        if at + 4 > len(data):
            return None, at
        (n,) = struct.unpack_from(">i", data, at)
        return (data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n) if 0 <= n <= LONGEST and at + 4 + n <= len(data) else (None, at)

    while offset < len(data):
        path, at = text(offset)
        folder, at = text(at) if path is not None else (None, at)
        if folder is None or at + 8 > len(data):
            return
        (hash_,) = struct.unpack_from(">q", data, at)
        video, at = text(at + 8)
        if video is None or at + 8 + 4 * dim > len(data):
            return
        (ts,) = struct.unpack_from(">q", data, at)
        vector = np.frombuffer(data, ">f4", dim, at + 8).astype(np.float32) if vectors else None
        offset = at + 8 + 4 * dim
        yield offset, path, folder, hash_, video or None, ts, vector


def _streamed(path: str, offset: int, vectors: bool, most: int) -> Iterator[tuple]:
    """Records of one log, read from offset on in ranges of about ``most`` bytes; none behind another head."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as log:
        start = log.read(12)
        if len(start) < 12 or start[:8] != MAGIC + struct.pack(">i", VERSION):
            return
        (dim,) = struct.unpack_from(">i", start, 8)
        at, ask = max(offset, 12), most
        while True:
            log.seek(at)
            data, used = log.read(ask), 0
            for r in records(data, 0, dim, vectors):
                used = r[0]
                yield at + r[0], *r[1:]
            if len(data) < ask or (not used and ask >= 4 * (LONGEST + 4 + dim) + 16):
                return
            at, ask = at + used, most if used else 2 * ask  # a record longer than the range: a wider one


def read_log(spark: SparkSession, path: str, offset: int | None = None, vectors: bool = True, most: int = 1 << 24) -> DataFrame:
    """Rows of all logs under path, from a byte offset on; vectors=False leaves the vectors undecoded.

    A task reads a log in ranges of about ``most`` bytes, starting at the offset, so logs of any length are read in bounded
    memory.  A file with another head gives no rows (see ``bad_logs``).
    """
    names = ["file", "ord", "next_offset", "image_path", "folder_id", "hash", "video_uri", "timestamp_ms", "embedding"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf.path:
                held = []
                for i, r in enumerate(_streamed(name, offset or 12, vectors, most)):
                    held.append((name, i, *r))
                    if len(held) == 1024:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    # Only names are listed here; contents are read in the tasks, one file or more each.
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return files.repartition(max(1, min(files.count(), 4096))).mapInPandas(run, SCHEMA)


def bad_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs whose head isn't one, to be set aside: path, length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[[not _has_head(p) for p in pdf.path]]

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    return files.mapInPandas(run, "path string, length long")


def _has_head(path: str) -> bool:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as log:
        start = log.read(12)
    return len(start) == 12 and start[:8] == MAGIC + struct.pack(">i", VERSION)


def without_folder(log: DataFrame, folder: str) -> DataFrame:
    """Rows of a log that stay when a folder is deleted, to be written beside the old one and swapped in."""
    return log.where(F.col("folder_id") != folder)


def media_files(spark: SparkSession, path: str, pattern: str = r"(?i)\.(jpe?g|png|webp)$") -> DataFrame:
    """path, size, modified of files under a folder whose names fit; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")).where(F.col("path").rlike(pattern))
