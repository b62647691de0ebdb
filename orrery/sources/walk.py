"""Walking a tree of folders in rounds: the folders of one depth are listed in tasks, and their subfolders are the next round."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.shared import written

_FOUND = "folder string, kind string, path string, real string, size long, modified_ms long"
#: Seconds before a folder that couldn't be listed is tried once more.
AGAIN_S = 0.05


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in each folder: rows of kind file and folder, or one of kind failed."""
    for pdf in frames:
        for folder in pdf.path.tolist():
            fs, name = pafs.FileSystem.from_uri(folder)
            top = folder[: len(folder) - len(name.rstrip("/"))] if folder.rstrip("/").endswith(name.rstrip("/")) else ""
            local = isinstance(fs, pafs.LocalFileSystem)
            rows = None
            for attempt in (0, 1):
                try:
                    infos = fs.get_file_info(pafs.FileSelector(name))
                    rows = [(folder, "folder" if i.type == pafs.FileType.Directory else "file", top + i.path, os.path.realpath(i.path) if local else i.path, i.size or 0, int(i.mtime_ns // 1_000_000) if i.mtime_ns else 0) for i in infos]
                    break
                except OSError:
                    time.sleep(0 if attempt else AGAIN_S)
            yield pd.DataFrame([(folder, "failed", folder, folder, 0, 0)] if rows is None else rows, columns=[x.split()[0] for x in _FOUND.split(", ")])


def walk(spark: SparkSession, root: str, pattern: str = r"(?i)\.(jpe?g|png|webp)$", tasks: int = 64) -> tuple[DataFrame, DataFrame]:
    """(files, failed): path, size, modified_ms of all files under root whose names fit, and the folders that can't be listed.

    There are as many rounds as the tree is deep.  A folder that was listed already, as a link leads back to it or two lead to it,
    isn't listed again; one that can't be listed is tried twice and counted, and the rest goes on.  Each round's list is written
    to the shared folder, so a lost task lists its folders again.
    """
    fs, name = pafs.FileSystem.from_uri(root)
    real = os.path.realpath(name) if isinstance(fs, pafs.LocalFileSystem) else name
    frontier = spark.createDataFrame([(root.rstrip("/"), real)], "path string, real string")
    seen, found = frontier.select("real"), None
    while not frontier.isEmpty():
        listed = written(frontier.select("path").repartition(tasks).mapInPandas(_list, _FOUND))
        found = listed if found is None else found.unionByName(listed)
        folders = listed.where("kind = 'folder'").groupBy("real").agg(F.min("path").alias("path"))
        frontier = written(folders.join(seen, "real", "left_anti").select("path", "real"))
        seen = seen.unionByName(frontier.select("real"))
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    # A file that two folders have, by a link, is there under both names; one folder is listed once.
    files = found.where("kind = 'file'").where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return files.select("path", "size", "modified_ms"), found.where("kind = 'failed'").select("path")
