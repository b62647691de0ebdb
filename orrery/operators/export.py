"""Exports: names and parts of archives, their manifests, and writing them."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kept free in each part, and where the 64-bit archive format begins.
RESERVE, LARGE_BYTES, LARGE_FILES = 256 * 1024, 3_000_000_000, 60_000


def repeated_files(items: DataFrame) -> DataFrame:
    """extra, extra_bytes: what files (uri, size) in several albums add."""
    x = items.groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n > 1")
    return x.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("extra_bytes"))


def totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(~F.col("is_video")).alias("images"), F.count_if("is_video").alias("videos"), F.sum("size").alias("n_bytes"))


#: A number that a name got already, before its ending.
_NUMBERED = r" \([0-9]+\)(\.[^.]*)?$"


def unique_names(items: DataFrame) -> DataFrame:
    """items (folder, name, ord) with path: names taken already, whatever the case, get " (n)" before the ending.

    Names can only meet when they are equal but for such numbers.  Where no name of such a group has a number yet, its rows
    are counted; else the group is gone through in order, as a numbered name may be taken, too.
    """
    names = items.columns
    bare = F.lower(F.regexp_replace("name", _NUMBERED, "$1"))
    key = ["folder", "bare_"]
    rows = items.withColumn("bare_", bare).withColumn("some_", F.max(F.col("name").rlike(_NUMBERED)).over(Window.partitionBy("folder", bare)))
    ending = F.regexp_extract("name", r"^.+(\.[^.]*)$", 1)
    stem = F.expr("left(name, length(name) - length(ending_))")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    plain = rows.where("not some_").withColumn("ending_", ending).withColumn("n_", place)
    own = F.when(F.col("n_") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), "n_", F.lit(")"), "ending_"))
    plain = plain.withColumn("path", F.concat("folder", F.lit("/"), own)).select(*items.columns, "path")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        last: dict[str, int] = {}
        paths = []
        pdf = pdf.sort_values("ord")
        for folder, name in zip(pdf.folder, pdf.name, strict=True):
            dot = name.rfind(".")
            stem, ending = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            own, n = name, last.get(name.lower(), 2)
            while own.lower() in taken:
                own, n = f"{stem} ({n}){ending}", n + 1
            last[name.lower()] = n
            taken.add(own.lower())
            paths.append(f"{folder}/{own}")
        return pdf.assign(path=paths)[[*names, "path"]]

    schema = items.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", path string"
    return plain.unionByName(rows.where("some_").groupBy(*key).applyInPandas(run, schema))


def entry_cost(size: Column, path: Column, listed: bool) -> Column:
    size = F.greatest(size, F.lit(0))
    return size + 5 * (F.floor(size / 65535) + 1) + 2 * F.length(path) + 200 + (300 if listed else 0)


def parts(entries: DataFrame, limit: int) -> DataFrame:
    """job, ord, part of entries (job, ord, cost): the next part begins where one more would pass limit - RESERVE.

    limit 0: one part.  A job's entries come sorted to their task and are gone through as they come, with the room used and
    the number of the part as all that is kept.  A job is one user's export, and ord numbers its entries.
    """
    room = limit - RESERVE if limit else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, part = (), 0, 0
        for batch in batches:
            found = []
            for job, cost in zip(batch["job"].to_pylist(), batch["cost"].to_pylist(), strict=True):
                if (job,) != now:
                    now, used, part = (job,), 0, 0
                # A sum with an unknown cost stays unknown, as in SQL.
                total = None if used is None or cost is None else used + cost
                if total is not None and room > 0 and used > 0 and total > room:
                    part, total = part + 1, cost
                used = total
                found.append(part)
            yield pa.RecordBatch.from_arrays([batch["job"], batch["ord"], pa.array(found, pa.int32())], ["job", "ord", "part"])

    rows = entries.select("job", F.col("ord").cast("long").alias("ord"), F.col("cost").cast("long").alias("cost"))
    kind = rows.schema["job"].dataType.simpleString()
    return rows.repartition("job").sortWithinPartitions("job", "ord", "cost").mapInArrow(run, f"job {kind}, ord long, part int")


def part_name(base: Column, part: Column, n: Column) -> Column:
    return F.when(n == 1, F.concat(base, F.lit(".zip"))).otherwise(F.concat(base, F.lit(" - part "), part + 1, F.lit(" of "), n, F.lit(".zip")))


def manifest(entries: DataFrame) -> DataFrame:
    """job, part, manifest (JSON) of entries (job, part, album, kind, path, name, is_video, taken_ms, modified_ms, size, ord)."""
    date = lambda c: F.when(F.col(c) > 0, F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    kind = F.when(F.col("is_video"), "video").otherwise("image")
    file = F.struct("ord", "path", "name", kind.alias("type"), date("taken_ms").alias("dateTaken"), date("modified_ms").alias("modified"), "size")
    albums = entries.groupBy("job", "part", "album", "kind").agg(F.sort_array(F.collect_list(file)).alias("files"), F.min("ord").alias("ord"))
    files = F.transform("files", lambda f: F.struct(*(f[c].alias(c) for c in ("path", "name", "type", "dateTaken", "modified", "size"))))
    album = F.struct("ord", F.col("album").alias("name"), F.col("kind").alias("type"), files.alias("files"))
    x = albums.groupBy("job", "part").agg(F.sort_array(F.collect_list(album)).alias("albums"))
    n = F.max("part").over(Window.partitionBy("job")) + 1
    whole = F.struct((F.col("part") + 1).alias("part"), n.alias("parts"), F.transform("albums", lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["files"].alias("files"))).alias("albums"))
    return x.select("job", "part", F.to_json(whole, {"ignoreNullFields": "false"}).alias("manifest"))


def write_parts(entries: DataFrame, place: Callable[[int, int], str]) -> DataFrame:
    """Write each part's stored entries (job, part, path, content) to place(job, part), one task a part.

    Entries of a part come to their task sorted and are written as they come, so none has to fit into memory but a batch.
    Returns job, part, files, skipped (content null), n_bytes.  place names files on storage that all executors see.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, count = None, None, [0, 0, 0]
        for pdf in frames:
            for job, part, path, content in zip(pdf.job.tolist(), pdf.part.tolist(), pdf.path.tolist(), pdf.content.tolist(), strict=True):
                if now != (job, part):
                    if out:
                        out.close()
                        yield pd.DataFrame([(*now, *count)], columns=["job", "part", "files", "skipped", "n_bytes"])
                    now, count = (job, part), [0, 0, 0]
                    out = zipfile.ZipFile(place(job, part), "w", zipfile.ZIP_STORED, allowZip64=True)
                if content is None:
                    count[1] += 1
                    continue
                out.writestr(zipfile.ZipInfo(path), bytes(content))
                count[0] += 1
                count[2] += len(content)
        if out:
            out.close()
            yield pd.DataFrame([(*now, *count)], columns=["job", "part", "files", "skipped", "n_bytes"])

    rows = entries.select("job", "part", "path", "content").repartition("job", "part").sortWithinPartitions("job", "part", "path")
    return rows.mapInPandas(run, "job long, part int, files long, skipped long, n_bytes long")
