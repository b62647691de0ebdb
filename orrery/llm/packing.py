"""Token ids packed into rows of fixed length, best fit decreasing.

A text's ids are cut into pieces of at most ``length`` ids.  Pieces are dealt by hash to groups of about ``GROUP``
bytes of text, which are no fewer than its ids; inside a group they are placed in the order of decreasing length, each into
the fullest row that still has room.  A segment tree over the room left (0 to length) finds that row in log2(length) steps.

A row has the ids of its pieces one after another and padding; cu_seqlens, the cumulative lengths of its
segments from 0; position_ids, which begin at 0 in each segment; and doc_ids, text_keys (hashes of the texts) and the
number of each piece, from which every document can be put together again.

Defined results: a null or empty text has no ids and is in no row; repeated rows are packed each, and spread over groups;
texts that share an id are told apart by text_keys; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import content_key
from orrery.llm.kneser_ney import Store
from orrery.llm.token_counts import read_ranks
from orrery.shipping import ship

GROUP, REMEMBERED = 1 << 22, 500_000
#: Fixed value: how this vocabulary family cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNITS = re.compile(r"[ \n]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,:;!?#%&*$|])|[^ \n]+)|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


class _Units(dict):
    """Packed ids of units of a text: the pattern never reaches from a sign across a following space or line end, or from
    a letter to a following punctuation mark."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = array("i", self.encode(unit)).tobytes()
        if len(unit) <= 64:
            self[unit] = ids
        return ids


def encoder(vocabulary: bytes):
    """A function from texts to ids as int32, for a ranks file."""
    import tiktoken

    ranks = {x: i for i, x in enumerate(read_ranks(vocabulary))}
    whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    units = _Units(whole)

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in _OTHER_ASCII_SPACE) or not text.isascii() and _OTHER_SPACE.search(text):
            return np.array(whole(text), np.int32)
        return np.frombuffer(b"".join(map(units.__getitem__, _UNITS.findall(text))), np.int32)

    return encode


class RoomTree:
    """How many open rows have each amount of room, as a segment tree of which leaves are taken."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.some = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room that is enough."""
        i = self.size + room
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        found = i - self.size
        row = self.rows[found].pop()
        if not self.rows[found]:
            self.some[i] = False
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
                i >>= 1
        return found, row


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of indices of lengths; the lengths of a row add up to at most ``most``."""
    tree, rows = RoomTree(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = most, len(rows)
            rows.append([])
        rows[found[1]].append(i)
        tree.add(found[0] - lengths[i], found[1])
    return rows


def token_pieces(docs: DataFrame, vocabulary: bytes, length: int) -> DataFrame:
    """doc_id, text_key, piece, copy, ids (little-endian int32) of docs (doc_id, text).

    copy numbers the equal rows that one task meets.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, met = encoder(sent.value), Counter()
        for batch in batches:
            doc_ids, keys, texts = (batch.column(c) for c in ("doc_id", "text_key", "text"))
            for at in range(0, batch.num_rows, 256):
                rows, pieces, copies, blobs = [], [], [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    ids = encode(texts[i].as_py() or "")
                    met[own := hash((doc_ids[i].as_py(), keys[i].as_py()))] += 1
                    for k, first in enumerate(range(0, len(ids), length)):
                        rows.append(i)
                        pieces.append(k)
                        copies.append(met[own])
                        blobs.append(ids[first : first + length].tobytes())
                taken = pa.array(rows, pa.int64())
                columns = [doc_ids.take(taken), keys.take(taken), pa.array(pieces, pa.int32()), pa.array(copies, pa.int32()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "piece", "copy", "ids"])

    return docs.select("doc_id", content_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, piece int, copy int, ids binary")


def pack(pieces: DataFrame, groups: int, *, length: int, pad: int) -> DataFrame:
    """Packed rows of pieces (doc_id, text_key, piece, copy, ids): pack_group, pack_row, n_ids, input_ids, position_ids
    (little-endian int32, ``length`` of each), cu_seqlens, doc_ids, text_keys, pieces."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text_key", "piece"])
        blobs, keys, pieces, group = pdf.ids.tolist(), pdf.text_key.tolist(), pdf.piece.tolist(), int(pdf.pack_group.iloc[0])
        names = [None if pd.isna(x) else x for x in pdf.doc_id.tolist()]
        sizes, out = [len(x) // 4 for x in blobs], []
        for row, own in enumerate(best_fit_decreasing(sizes, length)):
            ends = np.cumsum([0, *(sizes[i] for i in own)]).astype(np.int32)
            ids, positions = np.full(length, pad, np.int32), np.zeros(length, np.int32)
            ids[: ends[-1]] = np.frombuffer(b"".join(blobs[i] for i in own), np.int32)
            positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            out.append((group, row, int(ends[-1]), ids.tobytes(), positions.tobytes(), ends, [names[i] for i in own], [keys[i] for i in own], [pieces[i] for i in own]))
        return pd.DataFrame(out, columns=["pack_group", "pack_row", "n_ids", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "text_keys", "pieces"])

    group = F.pmod(F.xxhash64("doc_id", "text_key", "piece", "copy"), F.lit(groups)).cast("int")
    schema = f"pack_group int, pack_row int, n_ids int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, text_keys array<long>, pieces array<int>"
    return pieces.withColumn("pack_group", group).groupBy("pack_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, vocabulary: bytes, *, length: int = 2048, pad: int = 50256) -> DataFrame:
    """Packed rows of docs (doc_id, text), as ``pack`` gives them."""
    ship(docs.sparkSession)
    groups = max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // GROUP))
    return pack(token_pieces(docs, vocabulary, length), groups, length=length, pad=pad)


def write_packs(packed: DataFrame, uri: str) -> DataFrame:
    """Write each group's rows as raw little-endian int32 matrices ids-N, positions-N and the flat arrays lengths-N
    (cu_seqlens) under a folder that executors share; returns pack_group, n_rows."""
    store = Store(uri)
    store.create()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, group = pdf.sort_values("pack_row"), int(pdf.pack_group.iloc[0])
        store.write(f"ids-{group}", np.frombuffer(b"".join(pdf.input_ids), np.int32))
        store.write(f"positions-{group}", np.frombuffer(b"".join(pdf.position_ids), np.int32))
        store.write(f"lengths-{group}", np.concatenate(pdf.cu_seqlens.to_list()).astype(np.int32))
        return pd.DataFrame({"pack_group": [group], "n_rows": [len(pdf)]})

    return packed.groupBy("pack_group").applyInPandas(run, "pack_group int, n_rows long")
