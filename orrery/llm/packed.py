"""Numbers packed into binary columns, so that Spark moves thousands of them as one row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return new, np.diff(np.append(new, len(values)))


def packed(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(group, bytes of each column) for rows that are in the order of group."""
    for a, n in zip(*runs(group), strict=True):
        yield int(group[a]), *(c[a : a + n].tobytes() for c in columns)


def joined(blobs: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of equal length of whole numbers from 0, compressed by planes of their bytes; small numbers take little."""
    planes, parts = [], []
    for c in columns:
        data = np.ascontiguousarray(c).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        planes.append((int(c.max(initial=0)).bit_length() + 7) // 8)
        parts.append(np.ascontiguousarray(data[:, : planes[-1]].T).tobytes())
    head = np.array([len(columns), len(columns[0]), *planes], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unsqueezed(bodies: Iterable[bytes]) -> list[np.ndarray]:
    """The columns of some bodies with as many columns, as unsigned 64-bit numbers one body after another."""
    found = []
    for body in bodies:
        data = zstandard.ZstdDecompressor().decompress(body)
        k, n = np.frombuffer(data, "<u4", 2).tolist()
        at, own = 8 + 4 * k, []
        for planes in np.frombuffer(data, "<u4", k, 8).tolist():
            out = np.zeros((n, 8), np.uint8)
            out[:, :planes] = np.frombuffer(data, np.uint8, n * planes, at).reshape(planes, n).T
            own.append(out.view("<u8").ravel())
            at += n * planes
        found.append(own)
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about most bytes."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 32
        if size > most:
            yield _batch(kept, schema)
            kept, size = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
