"""The vector log as a data source: ``spark.read``, ``readStream`` and ``write`` with format ``vector_log``.

A log is a folder of files of records (see ``vector_log``) and small versions, JSON files ``_versions/<n>.json`` that say
which files are in it, how long each is, and at which offsets in it records begin, about every CUT bytes.  Writing adds
files and then a version, which is made by one step that fails where that version is there already; so a write is seen
as a whole or not at all, and of two that began from one version one goes first.  Whatever rewrites the log (a folder is
deleted, all is cleared) raises its generation, after which places in it from before mean nothing.

A single file of records is a log, too, of the generation in ``<file>.generation`` (none: 0).  It has no cuts: they are
found by going from record to record over lengths alone, which leaves the vectors unread.  A half-written record at its
end isn't read before it is whole.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from orrery.sources.vector_log import LONGEST, MAGIC, VERSION, head, record, records

#: Bytes between two cuts, and bytes that a task reads at once.
CUT, AT_ONCE = 1 << 24, 1 << 22
SCHEMA = "file string, generation long, start long, next_offset long, image_path string, folder_id string, hash long, video_uri string, timestamp_ms long, embedding array<float>"
_FIELDS = [("file", pa.string()), ("generation", pa.int64()), ("start", pa.int64()), ("next_offset", pa.int64()), ("image_path", pa.string()), ("folder_id", pa.string()), ("hash", pa.int64()), ("video_uri", pa.string()), ("timestamp_ms", pa.int64()), ("embedding", pa.list_(pa.float32()))]
_ARROW = pa.schema(_FIELDS)
#: What a writer takes of a row.
WRITTEN = ("image_path", "folder_id", "hash", "video_uri", "timestamp_ms", "embedding")


class Changed(RuntimeError):
    """The log has another version than the one a rewrite began from."""


def whole_records(log, offset: int, dim: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the whole records of an open file from a boundary on, by lengths; ends where one is cut off.

    A length that can't be one is a ValueError: the offset wasn't where a record begins.
    """

    def text(at: int) -> int:
        log.seek(at)
        size = log.read(4)
        if len(size) < 4:
            return end + 1
        (n,) = struct.unpack(">i", size)
        if not 0 <= n <= LONGEST:
            raise ValueError(f"no record begins at {offset}")
        return at + 4 + n

    while offset < end:
        at = text(offset)
        at = text(at) if at <= end else at
        at = text(at + 8) if at + 8 <= end else end + 1
        at += 8 + 4 * dim
        if at > end:
            return
        yield offset, at
        offset = at


@dataclass
class Log:
    """What the driver and the tasks know of a log at a path."""

    path: str
    cut: int = CUT

    def __post_init__(self) -> None:
        self.fs, self.name = pafs.FileSystem.from_uri(self.path)
        self.name = self.name.rstrip("/")

    def single(self) -> bool:
        return self.fs.get_file_info(self.name).type == pafs.FileType.File

    def current(self, version: int | None = None) -> dict:
        """version, generation and files (name, bytes, cuts) of the newest or the given version; an empty log has version 0."""
        if self.single():
            side = self.fs.get_file_info(f"{self.name}.generation")
            generation = int(self._text(side.path)) if side.type == pafs.FileType.File else 0
            return {"version": generation, "generation": generation, "files": [{"name": self.name, "bytes": None, "cuts": None}]}
        if version is None:
            found = self.fs.get_file_info(pafs.FileSelector(f"{self.name}/_versions", allow_not_found=True))
            version = max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)
        return json.loads(self._text(self._version(version))) if version else {"version": 0, "generation": 0, "files": []}

    def _version(self, n: int) -> str:
        return f"{self.name}/_versions/{n:012}.json"

    def _text(self, name: str) -> str:
        with self.fs.open_input_file(name) as file:
            return file.read().decode()

    def file(self, name: str) -> str:
        return name if name == self.name else f"{self.name}/{name}"

    def dim(self, log) -> int:
        log.seek(0)
        start = log.read(12)
        if len(start) < 12 or start[:8] != MAGIC + struct.pack(">i", VERSION):
            raise ValueError(f"{self.path}: not a vector log of version {VERSION}")
        return struct.unpack_from(">i", start, 8)[0]

    def publish(self, version: int, generation: int, files: list[dict]) -> None:
        """Make a version that isn't there yet; Changed if it is."""
        self.fs.create_dir(f"{self.name}/_versions", recursive=True)
        there = f"{self.name}/_versions/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(there) as out:
            out.write(json.dumps({"version": version, "generation": generation, "files": files}).encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(there, self._version(version))
            elif self.fs.get_file_info(self._version(version)).type != pafs.FileType.NotFound:
                raise FileExistsError
            else:
                self.fs.move(there, self._version(version))  # other file systems don't move onto a file
                return
        except OSError as error:
            self.fs.delete_file(there)
            raise Changed(f"{self.path} has version {version} already") from error
        self.fs.delete_file(there)

    def pieces(self, file: dict, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
        """(start, end) of the pieces of a file between two record boundaries (0: the first one)."""
        if file["cuts"] is not None:
            edges = [*file["cuts"], file["bytes"]]
            return list(zip(edges[:-1], edges[1:], strict=True))
        with self.fs.open_input_file(self.file(file["name"])) as log:
            dim, out, begin, end = self.dim(log), [], max(first, 12), max(first, 12)
            for _, end in whole_records(log, begin, dim, log.size() if last is None else last):
                if end - begin >= self.cut:
                    out.append((begin, end))
                    begin = end
        return [*out, (begin, end)] if end > begin else out


@dataclass
class Piece(InputPartition):
    file: str
    generation: int
    start: int
    end: int


class _Reads:
    """Reading of pieces, for batches and streams alike."""

    def __init__(self, options: dict) -> None:
        self.log = Log(options["path"], int(options.get("cut", CUT)))
        self.vectors = options.get("vectors", "true").lower() != "false"
        self.folder: str | None = None

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Rows of a piece, AT_ONCE bytes at a time; vectors are decoded only where they are asked for."""
        with self.log.fs.open_input_file(self.log.file(piece.file)) as log:
            dim, at, ask = self.log.dim(log), piece.start, AT_ONCE
            while at < piece.end:
                log.seek(at)
                data, rows, vectors, begin, used = log.read(min(ask, piece.end - at)), [], [], 0, 0
                for end, path, folder, hash_, video, ts, vector in records(data, 0, dim, self.vectors):
                    if self.folder is None or folder == self.folder:
                        rows.append((piece.file, piece.generation, at + begin, at + end, path, folder, hash_, video, ts))
                        vectors.append(vector)
                    begin = used = end
                if not used and ask >= piece.end - at:
                    raise ValueError(f"{piece.file}: no whole record at {at}")
                at, ask = at + used, AT_ONCE if used else 2 * ask
                if rows:
                    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS[:-1], strict=True)]
                    flat = pa.array(np.concatenate(vectors), pa.float32()) if self.vectors else None
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), flat) if self.vectors else pa.nulls(len(rows), _FIELDS[-1][1])
                    yield pa.RecordBatch.from_arrays([*columns, lists], schema=_ARROW)


class LogReader(_Reads, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A folder is looked for before a record's vector is decoded."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("folder_id",) and self.folder is None:
                self.folder = f.value
            else:
                yield f

    def partitions(self) -> list[Piece]:
        now = self.log.current()
        found = [Piece(f["name"], now["generation"], a, b) for f in now["files"] for a, b in self.log.pieces(f)]
        return found or [Piece("", now["generation"], 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return super().read(piece) if piece.file else iter(())


class LogStreamReader(_Reads, DataSourceStreamReader):
    """Offsets are (generation, version, files, bytes): files of a folder's log, or bytes of a single file's, that are read.

    After a new generation everything in the log is read again, and its rows have the new generation; a row without a path
    says that it began, as there may be no other.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"generation": -1, "version": 0, "files": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        now = self.log.current()
        offset = {"generation": now["generation"], "version": now["version"], "files": len(now["files"]), "bytes": 0}
        if now["files"] and now["files"][0]["bytes"] is None:
            known = self.known if self.known and self.known["generation"] == now["generation"] else None
            pieces = self.log.pieces(now["files"][0], known["bytes"] if known else 0)
            offset["bytes"] = pieces[-1][1] if pieces else known["bytes"] if known else 12
        self.known = offset
        return offset

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        again = start["generation"] != end["generation"]
        now = self.log.current(end["version"] or None) if not self.log.single() else self.log.current()
        found = []
        for i, file in enumerate(now["files"][: end["files"]]):
            if file["bytes"] is None:
                if again or end["bytes"] > start["bytes"]:
                    found += [Piece(file["name"], end["generation"], a, b) for a, b in self.log.pieces(file, 0 if again else start["bytes"], end["bytes"])]
            elif again or i >= start["files"]:
                found += [Piece(file["name"], end["generation"], a, b) for a, b in self.log.pieces(file)]
        return [*found, Piece("", end["generation"], 0, int(again))]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.file:
            yield from super().read(piece)
        elif piece.end:
            yield pa.RecordBatch.from_pylist([{"generation": piece.generation}], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int
    cuts: list[int]


class LogWriter(DataSourceWriter):
    """Every task writes one file; the version that names them is made when all are there.

    Appending begins again from the newest version when another write came first.  Overwriting raises the generation, and
    is Changed when the log isn't at the version it began from any more.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.log, self.overwrite = Log(options["path"], int(options.get("cut", CUT))), overwrite
        self.dim, self.base = int(options["dim"]), int(options["base"]) if "base" in options else None
        self.places = [schema.names.index(c) for c in WRITTEN]

    def write(self, rows: Iterator) -> Written:
        name = f"part-{uuid.uuid4().hex}.log"
        self.log.fs.create_dir(self.log.name, recursive=True)
        with self.log.fs.open_output_stream(self.log.file(name)) as out:
            out.write(head(self.dim))
            at, cuts = 12, []
            for row in rows:
                path, folder, hash_, video, ts, vector = (row[i] for i in self.places)
                if vector is None or len(vector) != self.dim:
                    raise ValueError(f"a vector of {None if vector is None else len(vector)} numbers in a log of {self.dim}")
                if not cuts or at - cuts[-1] >= self.log.cut:
                    cuts.append(at)
                data = record(path, folder, hash_, video, ts, vector)
                out.write(data)
                at += len(data)
        return Written(name, at, cuts)

    def commit(self, messages: list[Written | None]) -> None:
        new = [{"name": m.name, "bytes": m.bytes, "cuts": m.cuts} for m in messages if m is not None and m.cuts]
        while True:
            now = self.log.current()
            if self.overwrite and self.base is not None and now["version"] != self.base:
                self.abort(messages)
                raise Changed(f"{self.log.path} has version {now['version']}, not {self.base}")
            try:
                self.log.publish(now["version"] + 1, now["generation"] + self.overwrite, new if self.overwrite else now["files"] + new)
                return
            except Changed:
                if self.overwrite and self.base is not None:
                    self.abort(messages)
                    raise

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                self.log.fs.delete_file(self.log.file(m.name))


class VectorLog(DataSource):
    """Options: path; vectors (false: not decoded); cut, bytes between cuts; dim and base for writing."""

    @classmethod
    def name(cls) -> str:
        return "vector_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, schema, overwrite)


# ---- what a library does with its log


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorLog)


def read_table(spark: SparkSession, path: str, vectors: bool = True, cut: int = CUT) -> DataFrame:
    """Rows of SCHEMA of a log; start tells rows of a file apart, and orders them."""
    register(spark)
    return spark.read.format("vector_log").option("vectors", str(vectors)).option("cut", cut).load(path)


def append(rows: DataFrame, path: str, dim: int, cut: int = CUT) -> None:
    """Add rows (those of WRITTEN) to a log; a vector of another length fails the whole write, and the log stays as it is."""
    register(rows.sparkSession)
    rows.select(*WRITTEN).write.format("vector_log").mode("append").option("dim", dim).option("cut", cut).save(path)


def rewrite(log: DataFrame, path: str, dim: int, base: int) -> None:
    """Put rows in the place of all that the log had at version base."""
    register(log.sparkSession)
    log.select(*WRITTEN).write.format("vector_log").mode("overwrite").option("dim", dim).option("base", base).save(path)


def delete_folder(spark: SparkSession, path: str, folder: str, dim: int) -> None:
    """A log without a folder: what stays is copied and put in its place in one step, and the generation goes up.

    Changed if the log was written to meanwhile; nothing is lost then, and one may begin again.
    """
    base = Log(path).current()["version"]
    rewrite(read_table(spark, path).where(F.col("folder_id") != folder), path, dim, base)


def clear(path: str) -> None:
    """A log without rows, of the next generation."""
    log = Log(path)
    now = log.current()
    log.publish(now["version"] + 1, now["generation"] + 1, [])


def follow_log(spark: SparkSession, path: str, vectors: bool = False) -> DataFrame:
    """A stream of a log's rows; after a rewrite all rows come again, with the new generation."""
    register(spark)
    return spark.readStream.format("vector_log").option("vectors", str(vectors)).load(path)


def synced(catalog: DataFrame | None, state: dict, batch: DataFrame) -> tuple[DataFrame, dict]:
    """A catalog (key, uri, is_video, taken_ms, src) and its state ({generation}) after a batch of a followed log.

    New keys come in as pending (src -1); after a new generation, of which the batch has all rows, keys that are gone go,
    and what is known of those that stay is kept.
    """
    generation = batch.agg(F.max("generation")).first()[0]
    row = F.col("video_uri").isNotNull()
    new = batch.where("image_path is not null").select(F.col("hash").alias("key"), F.coalesce("video_uri", "image_path").alias("uri"), row.alias("is_video"), F.lit(0).cast("long").alias("taken_ms"), F.lit(-1).alias("src")).groupBy("key").agg(*(F.min(c).alias(c) for c in ("uri", "is_video", "taken_ms", "src")))
    if catalog is None or generation is None:
        return (new if catalog is None else catalog), state if generation is None else {"generation": generation}
    kept = catalog if generation == state.get("generation") else catalog.join(new, "key", "left_semi")
    return kept.unionByName(new.join(catalog, "key", "left_anti")), {"generation": generation}
