"""SentencePiece (merge type) encoding with seeded merge-dropout, and lossless decoding.

A text is cut before each run of spaces, around line ends and between a letter and a following sign, where no piece
of the vocabulary reaches across (checked when the vocabulary is read).  Each unit is segmented by an agenda of candidate
merges, best piece first, leftmost first.  Keyed hashes skip candidates: that of (seed, doc_id, place of the unit in the
text, k) says how many candidates of this unit are merged between its k-th skip and the next, so that each is skipped
with the same chance (``rate``), whatever was skipped before.  Each occurrence of a word is drawn for itself, while a rerun gives
the same.  Signs without a piece, and a literal U+2581, become byte pieces.  With a rate of 0 this is the usual encoding.

Texts are taken in lots of about ``AT_ONCE`` characters.  All units of a lot are segmented at once, one merge or skip
of each in a step: first each different one without skips, which says how many candidates it has, then those occurrences
whose first skip comes before that.  Units of over ``SHORT`` characters are segmented one by one, from a heap.

Defined results: a null or empty text has no pieces; every other text decodes to itself; repeated rows encode
alike; an empty table gives no rows.  The vocabulary file is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from orrery.llm.columns import unused
from orrery.llm.text import mix
from orrery.shipping import ship

SHORT, AT_ONCE = 60, 1 << 20
_LETTER, _SIGN = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,:;!?#%&*$|]"
_UNITS = re.compile(rf" *(?:{_LETTER}+(?={_SIGN})|[^ \n]+)|\n| +")
_REACHES = re.compile(rf"[^ ] |\n|{_LETTER}{_SIGN}")
_MARK = "▁"
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Bits of a place in a unit, below a candidate's rank; after all candidates; and an empty place of a table.
_PLACE, _NONE, _EMPTY = 6, np.int32(2**31 - 1), np.uint64(2**64 - 1)


class Vocabulary:
    """Pieces with their ids in order of preference, byte pieces, and the bytes of each id."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        found, self.bytes, self.of_byte = {}, [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                piece = piece.replace(_MARK, " ")
                if _REACHES.search(piece):
                    raise ValueError(f"piece {i} reaches across units")
                found[piece] = (-sp.get_score(i), i)
                self.bytes.append(piece.encode())
        if len(self.of_byte) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.rank = {piece: k for k, (piece, _) in enumerate(sorted(found.items(), key=lambda x: x[1]))}
        self.id = {piece: i for piece, (_, i) in found.items()}
        # Symbols, which are pieces by rank from 1 on, then other signs of pieces; 0 is none.
        symbols = {piece: k + 1 for piece, k in self.rank.items()}
        for sign in sorted({x for piece in found for x in piece}):
            symbols.setdefault(sign, len(symbols) + 1)
        self.of_sign = np.zeros(0x110000, np.int32)
        for sign in filter(lambda x: len(x) == 1, symbols):
            self.of_sign[ord(sign)] = symbols[sign]
        self.ids = [[], *map(self.pieces_of, symbols)]
        pairs = [(symbols[p[:k]] << 32 | symbols[p[k:]], r) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.bits = max(4, len(pairs).bit_length() + 3)
        self.pairs, self.rank_of = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, _NONE)
        spots, taken = self._spot(np.array([k for k, _ in pairs], np.uint64)), set()
        for k, at in enumerate(spots.tolist()):
            while at in taken:
                at = (at + 1) % len(self.pairs)
            taken.add(at)
            spots[k] = at
        self.pairs[spots], self.rank_of[spots] = [k for k, _ in pairs], [r << _PLACE for _, r in pairs]

    def pieces_of(self, symbol: str) -> list[int]:
        return [self.id[symbol]] if symbol in self.id else [self.of_byte[b] for b in symbol.encode()]

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Shifted ranks of what two symbols merge to."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._spot(keys)
        out = self.rank_of[at]
        there = self.pairs[at]
        some = np.flatnonzero((there != keys) & (there != _EMPTY))
        out[there != keys] = _NONE
        while len(some):
            at[some] = (at[some] + 1) % len(self.pairs)
            there = self.pairs[at[some]]
            hit = there == keys[some]
            out[some[hit]] = self.rank_of[at[some[hit]]]
            some = some[~hit & (there != _EMPTY)]
        return out

    def segment(self, unit: str, gaps: Iterable[int]) -> list[int]:
        """The pieces of one unit; gaps: how many candidates are merged before each skip."""
        return [i for s in self._long(unit, iter(gaps)) for i in self.pieces_of(s)]

    def _long(self, unit: str, gaps: Iterator[int]) -> list[str]:
        n, rank, merged, gap = len(unit), self.rank.get, 0, next(gaps, -1)
        symbols, after, before = [*unit, ""], list(range(1, n + 2)), list(range(-1, n))
        agenda = [(r, i, 2) for i, r in enumerate(map(rank, map(str.__add__, unit, unit[1:]))) if r is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left, j = symbols[i], after[i]
            right = symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            if merged == gap:
                merged, gap = 0, next(gaps, -1)
                continue
            merged += 1
            symbols[i] = left = left + right
            symbols[j] = ""
            after[i] = k = after[j]
            before[k] = i
            if (s := symbols[k]) and (r := rank(left + s)) is not None:
                heappush(agenda, (r, i, size + len(s)))
            if (h := before[i]) >= 0 and (r := rank((s := symbols[h]) + left)) is not None:
                heappush(agenda, (r, h, len(s) + size))
        return [s for s in symbols if s]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start on, ``size`` of them, one span after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts; rate: the share of candidate merges that are skipped."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int) -> None:
        self.vocabulary, self.seed, self.rate = vocabulary, seed, rate
        self.ids, self.of_sign = list(vocabulary.ids), vocabulary.of_sign.copy()
        #: A hash below the k-th largest of these means k more merges and more before the next skip.
        limits, limit = [], 1.0 - rate
        while rate and limit * 2.0**64 >= 1:
            limits.append(min(int(limit * 2.0**64), 2**64 - 1))
            limit *= 1.0 - rate
        self.limits = np.array(limits[::-1], np.uint64)

    def gaps(self, own: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """How many candidates are merged before the k-th skip (from 0, after the one before) of the units of these keys."""
        return len(self.limits) - np.searchsorted(self.limits, mix(own + _SECOND * (np.atleast_1d(k).astype(np.uint64) + np.uint64(1))), "right")

    def _of_long(self, own: np.uint64) -> Iterator[int]:
        keys = np.full(256, own)
        return chain.from_iterable(self.gaps(keys, np.arange(at, at + 256)).tolist() for at in range(0, 1 << 62, 256))

    def _symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The signs of all units as symbols, and where each unit ends; signs that no piece has become symbols, too."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        for x in np.unique(points[self.of_sign[points] == 0]).tolist():
            self.of_sign[x] = len(self.ids)
            self.ids.append(self.vocabulary.pieces_of(chr(x)))
        return self.of_sign[points], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))

    def _segment(self, signs: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all units one after another, how many each has, how many candidates it merged after its last skip).

        own: keys of the units; None: nothing is skipped.  Units of about the same length are taken together, as columns.
        """
        count, merged = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        parts, low = [], 0
        for high in (1, 4, 6, 8, 10, 12, 16, 24, 36, SHORT):
            cols = np.flatnonzero((size > low) & (size <= high))
            low = high
            for at in range(0, len(cols), 1 << 16):
                some = cols[at : at + (1 << 16)]
                found, merged[some] = self._columns(signs, start[some], size[some], None if own is None else own[some])
                column, row = np.nonzero(found)
                count[some] = np.bincount(column, minlength=len(some))
                parts.append((some, found[column, row]))
        ends = np.cumsum(count)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for some, symbols in parts:
            n = count[some]
            out[np.repeat(ends[some] - n - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, count, merged

    def _columns(self, signs: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (a row for each unit, 0 for none) and numbers of merges after the last skip."""
        n, high, ranks = len(size), int(size.max()), self.vocabulary.candidates
        # Row 0 and the row after a unit's last sign hold no symbol; flat places are row * n + column.
        rows = np.arange(high + 2)[:, None]
        inside = (rows >= 1) & (rows <= size)
        symbols = np.where(inside, signs[np.minimum(start + rows - 1, len(signs) - 1)], 0).astype(np.int32)
        after, before = np.repeat(rows + 1, n, axis=1).astype(np.int32), np.repeat(rows - 1, n, axis=1).astype(np.int32)
        agenda = np.full(symbols.shape, _NONE)
        both = np.flatnonzero((rows >= 1) & (rows < size))
        flat, agenda_flat, after_flat, before_flat = symbols.ravel(), agenda.ravel(), after.ravel(), before.ravel()
        found = ranks(flat[both], flat[both + n])
        agenda_flat[both] = np.where(found < _NONE, found | (both // n).astype(np.int32), _NONE)
        merged, skips = np.zeros(n, np.int64), np.zeros(n, np.int64)
        gap = np.full(n, -1) if own is None else self.gaps(own, 0)
        cols = np.arange(n)
        while True:
            best = agenda.min(axis=0) if len(cols) == n else agenda[:, cols].min(axis=0)
            going = best < _NONE
            if not going.all():
                cols, best = cols[going], best[going]
            if not len(cols):
                return np.ascontiguousarray(symbols.T), merged
            row = (best & ((1 << _PLACE) - 1)).astype(np.int64)
            at = row * n + cols
            skip = merged[cols] == gap[cols]
            if skip.any():
                out = cols[skip]
                agenda_flat[at[skip]] = _NONE
                merged[out] = 0
                skips[out] += 1
                gap[out] = self.gaps(own[out], skips[out])
                own_cols, at, best, row = cols[~skip], at[~skip], best[~skip], row[~skip]
            else:
                own_cols = cols
            merged[own_cols] += 1
            right = after_flat[at] * np.int64(n) + own_cols
            new = (best >> _PLACE) + 1
            flat[at], flat[right] = new, 0
            agenda_flat[right] = _NONE
            end = after_flat[right]
            after_flat[at] = end
            end = end * np.int64(n) + own_cols
            before_flat[end] = row
            for left, other, place, to in ((new, flat[end], row, at), (flat[to_left := before_flat[at] * np.int64(n) + own_cols], new, before_flat[at], to_left)):
                found = ranks(left, other)
                agenda_flat[to] = np.where(found < _NONE, found | place.astype(np.int32), _NONE)

    def encode_texts(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and where those of each end."""
        found = [_UNITS.findall(f" {t}") if t else () for t in texts]
        # Counted by an iterator of its own: by its own length it would refer to itself, and all lots would stay in memory.
        index: defaultdict[str, int] = defaultdict(count().__next__)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        unit = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64, counts.sum())
        different = list(index)
        signs, stop = self._symbols(different)
        size = np.diff(stop, prepend=0)
        start, short = stop - size, size <= SHORT
        symbols, n, merged = self._segment(signs, start, np.where(short, size, 0), None)
        ends = np.cumsum(counts)
        place = np.arange(len(unit)) - np.repeat(ends - counts, counts)
        own = mix(np.repeat(np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], np.uint64), counts) + place.astype(np.uint64) * _FIRST)
        first = (np.cumsum(n) - n)[unit]
        n = n[unit]
        if self.rate:
            some = np.flatnonzero((self.gaps(own, 0) < merged[unit]) & short[unit])
            more, n[some], _ = self._segment(signs, start[unit[some]], size[unit[some]], own[some])
            first[some] = len(symbols) + np.cumsum(n[some]) - n[some]
            symbols = np.concatenate([symbols, more])
        # Symbols become pieces: mostly one, else bytes.
        sizes = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        begin, flat = np.cumsum(sizes) - sizes, np.fromiter(chain.from_iterable(self.ids), np.int32)
        taken = symbols[_spans(first, n)]
        by_symbol = sizes[taken]
        pieces = flat[begin[taken]] if (by_symbol == 1).all() else flat[_spans(begin[taken], by_symbol)]
        total = np.concatenate([[0], np.cumsum(by_symbol)])
        to = total[np.cumsum(n)]
        if not (rest := np.flatnonzero(~short[unit])).size:
            return pieces, np.concatenate([[0], to])[ends]
        longs = [self.vocabulary.segment(different[unit[i]], self._of_long(own[i]) if self.rate else ()) for i in rest.tolist()]
        lengths = np.zeros(len(unit), np.int64)
        lengths[rest] = list(map(len, longs))
        pieces = np.insert(pieces, np.repeat(to[rest], lengths[rest]), list(chain.from_iterable(longs)))
        return pieces, np.concatenate([[0], to + np.cumsum(lengths)])[ends]

    def encode(self, text: str, key: str) -> np.ndarray:
        return self.encode_texts([text], [key])[0]


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.size = np.array([len(x) for x in vocabulary.bytes])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ids) else 0)
        return self.data[at].tobytes()[1:]

    def decode_texts(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose pieces lie between ends (from 0), without the first space of each, and where these end (from 0)."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[ends]
        some = np.diff(bounds) > 0
        return np.delete(data, bounds[:-1][some]), np.concatenate([[0], np.cumsum(np.diff(bounds) - some)])


def read_file(docs: DataFrame, path: str) -> bytes:
    """A small file, by Spark's readers."""
    return bytes(docs.sparkSession.read.format("binaryFile").load(path if ":" in path else f"file://{path}").select("content").first()[0])


def encode_documents(docs: DataFrame, model: bytes, *keep: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """The columns keep of docs (doc_id, text), pieces (array<int>), and decoded_crc32, of the text that they decode to.

    A column of keep that has one of these names is named with an underscore more.
    """
    ship(docs.sparkSession)
    kept = docs.select(*keep)
    names = [unused(("pieces", "decoded_crc32"), n) for n in kept.columns]
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)), StructField("pieces", ArrayType(IntegerType(), False)), StructField("decoded_crc32", LongType())])

    def run(batches):
        from zlib import crc32

        encoder, decoder = Encoder(sent.value, rate, seed), Decoder(sent.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                keys, texts, held = [], [], 0
                while at + len(texts) < batch.num_rows and held < AT_ONCE:
                    keys.append(str(batch.column(batch.num_columns - 2)[at + len(texts)].as_py()))
                    texts.append(batch.column(batch.num_columns - 1)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                values, ends = encoder.encode_texts(texts, keys)
                ends = np.concatenate([[0], ends])
                data, sizes = decoder.decode_texts(values, ends)
                decoded = pa.array([crc32(data[a:b]) for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)], pa.int64())
                pieces = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pieces, decoded], names=[*names, "pieces", "decoded_crc32"])
                at += len(texts)

    return docs.select(*keep, F.col("doc_id").cast("string").alias(unused(names, "key_to_encode")), F.col("text").alias(unused(names, "text_to_encode"))).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: bytes, *keep: str) -> DataFrame:
    """The columns keep of encoded and text, decoded from its column pieces; a text of keep is named with an underscore more."""
    ship(encoded.sparkSession)
    kept = encoded.select(*keep)
    names = [unused(("text",), n) for n in kept.columns]
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [decoder.decode(np.asarray(x, np.int64)).decode() for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)), StructField("text", StringType())])
    return encoded.select(*keep, F.col("pieces").alias(unused(names, "pieces_to_decode"))).mapInArrow(run, schema)
