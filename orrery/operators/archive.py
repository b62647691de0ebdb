"""Archives of files of any size: contents come in chunks that are read and checked in many tasks, and are written as they come.

An entry's CRC-32 is put together from those of its chunks: bytes that follow act on a CRC as a matrix of bits does, so
the CRC of a first piece is multiplied by the matrix of as many zero bytes as the second piece has, and the second's is
added.  That is associative, so chunks are joined in runs first and runs then, and no task holds all of an entry.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.export import LARGE_BYTES, LARGE_FILES

#: Bytes of a stored block, and the polynomial of CRC-32, lowest power in the highest bit.
BLOCK, POLYNOMIAL = 65_535, 0xEDB88320
#: Bytes of a chunk, and chunks whose CRCs are joined at once.
CHUNK, RUN = 1 << 20, 1024
_KEY = ["job", "part", "ord"]


def _times(matrix: tuple[int, ...], bits: int) -> int:
    total = 0
    for row in matrix:
        if bits & 1:
            total ^= row
        bits >>= 1
    return total


@lru_cache(maxsize=64)
def _zeros(power: int) -> tuple[int, ...]:
    """The matrix of 2**power zero bytes, by what becomes of each bit."""
    if power:
        half = _zeros(power - 1)
        return tuple(_times(half, row) for row in half)
    rows = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        rows.append(c)
    return tuple(rows)


def crc_of_both(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces in a row from their own; length: bytes of the second."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zeros(power), first)
        length, power = length >> 1, power + 1
    return first ^ second


def _joined(pieces: pd.Series) -> pd.DataFrame:
    out = []
    for own in pieces:
        crc = n = 0
        for p in own:
            crc, n = crc_of_both(crc, p["crc"], p["n"]), n + p["n"]
        out.append((crc, n))
    return pd.DataFrame(out, columns=["crc", "n"])


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """job, part, ord, chunk, data of files (job, part, ord, content); an empty file has one empty chunk, a null one a null."""
    last = F.greatest(F.ceil(F.octet_length("content") / size) - 1, F.lit(0))
    places = F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)).cast("long"))
    # Cut before they are dealt out, so that no chunk's row carries the whole content.
    pieces = F.transform(places, lambda k: F.substring(F.col("content"), (k * size + 1).cast("int"), F.lit(size)).cast("binary"))
    return files.select(*_KEY, F.posexplode(pieces).alias("chunk", "data")).withColumn("chunk", F.col("chunk").cast("long"))


def read_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """job, part, ord, chunk, data of files (job, part, ord, uri, size): every range of a file is read by a task of its own.

    A range that can't be read is null; one that ends early is short.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                try:
                    fs, name = pafs.FileSystem.from_uri(row.uri)
                    with fs.open_input_file(name) as file:
                        file.seek(min(row.chunk * size, file.size()))
                        data = file.read(size)
                except OSError:
                    data = None
                yield pd.DataFrame([(row.job, row.part, row.ord, row.chunk, data)], columns=[*_KEY, "chunk", "data"])

    last = F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("long")
    rows = files.select(*_KEY, "uri", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.repartition(*_KEY, "chunk").mapInPandas(run, "job long, part int, ord long, chunk long, data binary")


def entries(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """job, part, ord, path, modified_ms, crc, size, chunks, state of files (job, part, ord, path, modified_ms, size).

    state: whole, truncated (fewer bytes than its size; a null size fits all), or unreadable (a chunk is null or there is none).
    """
    own = chunks.select(*_KEY, "chunk", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("n"))
    join = F.pandas_udf(_joined, "crc long, n long")

    def joined(rows: DataFrame, *by: str) -> DataFrame:
        pieces = F.transform(F.sort_array(F.collect_list(F.struct("chunk", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("n", F.lit(0)).alias("n")))), lambda p: F.struct(p["crc"].alias("crc"), p["n"].alias("n")))
        x = rows.groupBy(*by).agg(pieces.alias("pieces"), F.min("chunk").alias("chunk"), F.sum("count").alias("count"), F.sum("bad").alias("bad"))
        return x.select(*by, "chunk", "count", "bad", join("pieces").alias("j")).select(*by, "chunk", "count", "bad", "j.crc", "j.n")

    marked = own.withColumn("count", F.lit(1)).withColumn("bad", F.when(F.col("crc").isNull(), 1).otherwise(0)).withColumn("run", F.floor(F.col("chunk") / RUN))
    whole = joined(joined(marked, *_KEY, "run").drop("run"), *_KEY).select(*_KEY, "crc", "n", "count", "bad")
    x = files.select(*_KEY, "path", "modified_ms", F.col("size").alias("wanted")).join(whole, _KEY, "left")
    state = F.when(F.col("count").isNull() | (F.col("bad") > 0), "unreadable").when(F.col("n") < F.col("wanted"), "truncated").otherwise("whole")
    return x.select(*_KEY, "path", "modified_ms", "crc", F.col("n").alias("size"), F.col("count").alias("chunks"), state.alias("state"))


class ArchiveWriter:
    """One archive as a stream of bytes: stored blocks, a description behind each entry, the directory at the end."""

    def __init__(self, out, large: bool) -> None:
        self.out, self.large, self.at, self.directory = out, large, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, path: str, modified_ms: int | None) -> None:
        t = pd.Timestamp(max(modified_ms or 0, 315_532_800_000), unit="ms")
        self.name, self.start, self.packed = path.encode(), self.at, 0
        self.time = t.hour << 11 | t.minute << 5 | t.second // 2, (t.year - 1980) << 9 | t.month << 5 | t.day
        more, size = (struct.pack("<HHQQ", 1, 16, 0, 0), 0xFFFFFFFF) if self.large else (b"", 0)
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if self.large else 20, 0x0808, 8, *self.time, 0, size, size, len(self.name), len(more)) + self.name + more)

    def data(self, data: bytes, last: bool) -> None:
        """More of the entry, in blocks of up to BLOCK bytes."""
        for at in range(0, max(1, len(data)), BLOCK):
            piece = data[at : at + BLOCK]
            self.put(struct.pack("<BHH", int(last and at + BLOCK >= len(data)), len(piece), len(piece) ^ 0xFFFF) + piece)
            self.packed += 5 + len(piece)

    def end(self, crc: int, size: int) -> None:
        self.put(struct.pack("<IIQQ" if self.large else "<IIII", 0x08074B50, crc, self.packed, size))
        self.directory.append((self.name, self.time, crc, self.packed, size, self.start))

    def finish(self) -> None:
        first, full = self.at, 0xFFFFFFFF
        for name, time, crc, packed, size, start in self.directory:
            more = struct.pack("<HHQQQ", 1, 24, size, packed, start) if self.large else b""
            shown = (full, full, full) if self.large else (packed, size, start)
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45 if self.large else 20, 45 if self.large else 20, 0x0808, 8, *time, crc, *shown[:2], len(name), len(more), 0, 0, 0, 0, shown[2]) + name + more)
        size, n, record = self.at - first, len(self.directory), self.at
        if self.large:
            self.put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, first) + struct.pack("<IIQI", 0x07064B50, 0, record, 1))
            n, size, first = 0xFFFF, full, full
        self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, first, 0))


def write_archives(found: DataFrame, chunks: DataFrame, place: Callable[[int, int], str], truncated: str = "skip") -> DataFrame:
    """job, part, files, skipped, n_bytes: an archive for each part of entries (see ``entries``), written to place(job, part).

    A task takes a part's chunks sorted and writes them as they come, first beside the archive, which is moved to its place
    when it is whole; so a task that is run again begins anew.  Unreadable entries are skipped and counted; truncated ones, too,
    or with truncated="keep" they are written as far as they go and counted.  From LARGE_BYTES or LARGE_FILES on the archive has
    64-bit records.
    """
    good = F.col("state") == "whole" if truncated == "skip" else F.col("state") != "unreadable"
    part = Window.partitionBy("job", "part")
    x = found.withColumn("use", good).withColumn("skipped", F.count_if(F.col("state") != "whole").over(part))
    large = (F.sum(F.when(F.col("use"), F.col("size") + 1024)).over(part) > LARGE_BYTES) | (F.count_if("use").over(part) > LARGE_FILES)
    x = x.withColumn("large", F.coalesce(large, F.lit(False)))
    none = x.groupBy("job", "part").agg(F.max("skipped").alias("skipped"), F.max("large").alias("large"))
    none = none.select("job", "part", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("modified_ms"), F.lit(None).cast("long").alias("crc"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("chunks"), "skipped", "large")
    rows = x.where("use").select(*_KEY, "path", "modified_ms", "crc", "size", "chunks", "skipped", "large").join(chunks.select(*_KEY, "chunk", "data"), _KEY).select(none.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = writer = None

        def close() -> pd.DataFrame:
            writer.finish()
            file.close()
            fs.move(there, name)
            return pd.DataFrame([(*now, len(writer.directory), skipped, writer.at)], columns=["job", "part", "files", "skipped", "n_bytes"])

        for pdf in frames:
            for job, part_, chunk, data, path, modified, crc, size, n, skip, big in zip(*(pdf[c].tolist() for c in ("job", "part", "chunk", "data", "path", "modified_ms", "crc", "size", "chunks", "skipped", "large")), strict=True):
                if now != (job, part_):
                    if writer:
                        yield close()
                    now, skipped = (job, part_), skip
                    fs, name = pafs.FileSystem.from_uri(place(job, part_))
                    there = f"{name}.{uuid.uuid4().hex}"
                    file = fs.open_output_stream(there)
                    writer = ArchiveWriter(file, bool(big))
                if path is None:
                    continue
                if chunk == 0:
                    writer.begin(path, None if pd.isna(modified) else int(modified))
                writer.data(bytes(data), chunk == n - 1)
                if chunk == n - 1:
                    writer.end(int(crc), int(size))
        if writer:
            yield close()

    dealt = none.unionByName(rows).repartition("job", "part").sortWithinPartitions("job", "part", F.asc_nulls_first("ord"), "chunk")
    return dealt.mapInPandas(run, "job long, part int, files long, skipped long, n_bytes long")
