"""Interpolated modified Kneser-Ney model of any order, counted in Spark and memory-mapped by the scoring tasks.

Tokens are lower-case words and one end token for each text, which begins with a start mark.  The grams of the highest
order have their counts, shorter ones the number of different words before them (those that begin with the start mark:
their counts).

1. Words are counted in units of about ``UNIT`` tokens, summed by bucket of their hash, and numbered: rank by count in the
   bucket, times buckets.  So frequent words have small numbers, which pack well, and what is known of a word is found
   by its number.
2. Grams of the highest order are counted in units, packed by bucket, and summed.  A bucket writes its grams as sorted
   hash arrays, and passes their ends (without the first word) on as the grams one shorter, and so on down to words.
3. The bucket of a gram is that of the last word of its context.  A word of over ``PER_BUCKET`` tokens is split by the word before
   it, and a context that may be so frequent by the word after it: counts of words, which all tasks can look up, say
   into how many parts.  Sums of split contexts go on to the next step and are written by bucket of the context.
4. Scoring tasks map these files and look up what they need, bucket by bucket; at most ``OPEN`` files are mapped at once.

A context that occurs once isn't stored: it is there when its words are, as a shorter gram.  Files are named by bucket
and put in place whole, so a task that runs again writes the same.  They lie under the checkpoint folder, which all
executors see, and go when the scores are written.

A gram is named by 30 and more bits of its hash inside a bucket; one that training lacks is taken for another about once in
10^8 times.  Defined results: a null or blank text is the end token alone; a word that training lacks gets its share of
the interpolated uniform distribution over V + 1 words; with nothing to learn from, that is all there is;
repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import text as T
from orrery.llm.cut import checkpoint_dir, cut
from orrery.llm.packed import batches, runs, squeezed, unsqueezed
from orrery.shipping import ship

UNIT, PER_BUCKET, TEXT_PER_BUCKET, OPEN, ORDER = 1 << 20, 1 << 20, 1 << 25, 192, 3
#: Numbers of the unknown word and the start mark; words begin at FIRST.  The end token is a word.
UNKNOWN, START, FIRST = 0, 1, 2
_U = np.uint64
_END = _U(0xFFFFFFFFFFFFFFFF)
_SPREAD = _U(0x9E3779B97F4A7C15)
#: Kinds of packed rows: grams with counts, sums of contexts, numbers of counts of 1 to 4 by order.
_GRAMS, _CONTEXTS, _SUMS = range(3)
_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_DDL = "part int, kind int, body binary"


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of tokens with the end tokens, how many each row has)."""
    for at, to, data, offsets in T.chunks(texts):
        starts, stops, counts = T.words(data, offsets)
        yield at, to, np.insert(T.word_hashes(data, starts, stops, lower=True), np.cumsum(counts), _END), counts + 1


def _units(frames: Iterable[pa.RecordBatch], unit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, tokens of each text) of about ``unit`` tokens each."""
    held, n = [], 0
    for batch in frames:
        for _, _, tokens, counts in _tokens(batch.column("text")):
            held.append((tokens, counts))
            n += len(tokens)
            if n >= unit:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


class Store:
    """Files of arrays under one folder that all executors see."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        self._open: OrderedDict[str, list[np.ndarray]] = OrderedDict()

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "_open": OrderedDict()}

    def _place(self) -> tuple[pafs.FileSystem, str]:
        if self.uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(self.uri) if ":" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def create(self) -> None:
        fs, path = self._place()
        fs.create_dir(path, recursive=True)

    def write(self, name: str, data: bytes | np.ndarray) -> None:
        """Put a file in place whole.  If another attempt of the same task has done so, that one stays."""
        fs, path = self._place()
        with fs.open_output_stream(part := f"{path}/.{name}-{uuid.uuid4().hex}") as out:
            out.write(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())
        try:
            fs.move(part, f"{path}/{name}")
        except OSError:
            if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
                raise
            fs.delete_file(part)

    def write_arrays(self, name: str, *arrays: np.ndarray) -> None:
        head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64).tobytes()
        self.write(name, b"".join([head, *(x for a in arrays for x in (np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)))]))

    def arrays(self, name: str) -> list[np.ndarray]:
        """The unsigned arrays of a file, mapped (from a store that isn't a local folder: read); [] if there is no file."""
        if name in self._open:
            self._open.move_to_end(name)
            return self._open[name]
        fs, path = self._place()
        data = np.empty(0, np.uint8)
        if (size := fs.get_file_info(f"{path}/{name}").size or 0) and isinstance(fs, pafs.LocalFileSystem):
            data = np.memmap(f"{path}/{name}", np.uint8, "r")
        elif size:
            with fs.open_input_file(f"{path}/{name}") as there:
                data = np.frombuffer(there.read(), np.uint8)
        out: list[np.ndarray] = []
        if size:
            n = int(data[:8].view(np.int64)[0])
            at = 8 + 16 * n
            for width, length in data[8:at].view(np.int64).reshape(n, 2).tolist():
                out.append(data[at : at + width * length].view(f"<u{width}"))
                at += width * length + -width * length % 8
        self._open[name] = out
        if len(self._open) > OPEN:
            self._open.popitem(last=False)
        return out

    def delete(self) -> None:
        fs, path = self._place()
        fs.delete_dir(path)


def shelf(keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes as (width, where each value of the first bits begins, the next ``low`` bits)."""
    width = max(0, (len(keys) // 8).bit_length())
    begin = np.searchsorted(keys >> _U(64 - width), np.arange((1 << width) + 1, dtype=np.uint64)) if width else np.array([0, len(keys)])
    return np.array([width], np.uint64), begin.astype(np.uint32), (keys << _U(width) >> _U(64 - low)).astype(np.uint32)


def on_shelf(width: np.ndarray, begin: np.ndarray, bits: np.ndarray, keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether there) of hashes; bits: those of the shelf, with 32 - low bits of something else below them."""
    width, more = int(width[0]), 32 - low
    cell = (keys >> _U(64 - width)).astype(np.int64) if width else np.zeros(len(keys), np.int64)
    part = (keys << _U(width) >> _U(64 - low)).astype(np.uint32) << np.uint32(more)
    first, end = begin[cell].astype(np.int64), begin[cell + 1].astype(np.int64)
    last = end - 1
    for _ in range(int((end - first).max(initial=0)).bit_length()):
        middle = (first + last) >> 1
        less = (bits[np.maximum(middle, 0)] < part) & (first <= last)
        first = np.where(less, middle + 1, first)
        last = np.where(less, last, middle - 1)
    place = np.minimum(first, len(bits) - 1)
    return place, (first < end) & (bits[place] >> np.uint32(more) == part >> np.uint32(more))


class Words:
    """Numbers and counts of words, from the files ``words-N``: hashes, ranks, counts of 2 and more by rank."""

    def __init__(self, store: Store, bits: int, starts: int) -> None:
        self.store, self.bits, self.starts = store, bits, starts

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of ascending hashes."""
        number, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        bucket = self.bucket(hashes)
        for a, n in zip(*runs(bucket), strict=True):
            if have := self.store.arrays(f"words-{int(bucket[a])}"):
                known, rank, often = have
                at = np.minimum(np.searchsorted(known, hashes[a : a + n]), len(known) - 1)
                there = known[at] == hashes[a : a + n]
                own = rank[at[there]].astype(np.int64)
                number[a : a + n][there] = FIRST + (own << self.bits) + bucket[a]
                count[a : a + n][there] = 1
                some = np.flatnonzero(there)[own < len(often)]
                count[a + some] = often[own[own < len(often)]]
        return number, count

    def of_texts(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, counts, place in the text) of the tokens of texts, a start mark before each text."""
        known, where = np.unique(hashes, return_inverse=True)
        number, count = self.numbers(known)
        first = np.cumsum(counts) - counts
        number, count = np.insert(number[where], first, START), np.insert(count[where], first, self.starts)
        return number, count, np.arange(len(number)) - np.repeat(first + np.arange(len(first)), counts + 1)


def _hash(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = T.mix(h * _SPREAD + c.view(np.uint64))
    return h


def buckets(words: list[np.ndarray], counts: list[np.ndarray], bits: int, per_bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether its context is split) of grams, given as columns of words and counts of their words."""
    h = _hash(words[-2])
    bound = counts[-2]
    for k in range(len(words) - 2, -1, -1):
        # What has been looked at so far occurs at most ``bound`` times; the next word splits it.
        some = np.flatnonzero(bound > per_bucket)
        by = words[k - 1] if k else words[-1]
        if len(some):
            parts = ((bound[some].astype(np.int64) + per_bucket - 1) // per_bucket).astype(np.uint64)
            h[some] = T.mix(h[some] + _SPREAD * (_U(1) + _hash(by[some]) % parts))
        if k:
            bound = np.minimum(bound, counts[k - 1])
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), bound > per_bucket


def _context_bucket(context: np.ndarray, bits: int) -> np.ndarray:
    return (T.mix(context) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(context), np.int64)


def _packed(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Packed rows of what is in the order of bucket."""
    for a, n in zip(*runs(bucket), strict=True):
        yield int(bucket[a]), kind, squeezed(*(c[a : a + n] for c in columns))


def _summed(keys: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in ascending order, one row's columns of each, and sums of counts."""
    order = np.argsort(keys)
    keys = keys[order]
    new, _ = runs(keys)
    return keys[new], [c[order[new]] for c in columns], [np.add.reduceat(c[order], new) if len(new) else c for c in counts]


class _Counter:
    """The steps of counting; words: as they are known by now."""

    def __init__(self, store: Store, order: int, words: Words, bits: int, unit: int, per_bucket: int) -> None:
        self.store, self.order, self.words, self.bits, self.unit, self.per_bucket = store, order, words, bits, unit, per_bucket

    def count_words(self, frames):
        def rows():
            for hashes, _ in _units(frames, self.unit):
                known, n = np.unique(hashes, return_counts=True)
                yield from _packed(self.words.bucket(known), _GRAMS, [known, n])

        return batches(rows(), _ROWS)

    def number_words(self, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf.part.iloc[0])
        hashes, n = unsqueezed(pdf.body)
        hashes, _, (n,) = _summed(hashes, [], [n])
        by_rank = np.lexsort((hashes, -n.astype(np.int64)))
        rank = np.empty(len(hashes), np.uint32)
        rank[by_rank] = np.arange(len(hashes), dtype=np.uint32)
        self.store.write_arrays(f"words-{bucket}", hashes, rank, n[by_rank][: (n > 1).sum()].astype(np.uint64))
        return pd.DataFrame({"types": [len(hashes)], "tokens": [int(n.sum())]})

    def _dealt(self, columns: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray) -> Iterator[tuple]:
        """Packed rows of grams, which are told apart by all their words but ordered by their context's last."""
        bucket, _ = buckets(columns, counts, self.bits, self.per_bucket)
        keys = (bucket.astype(np.uint64) << _U(40)) | (_hash(columns[-2]) >> _U(44) << _U(20)) | (_hash(*columns) >> _U(44))
        order = np.argsort(keys)
        yield from _packed(bucket[order], _GRAMS, [*(c[order] for c in columns), n[order], *(c[order] for c in counts[:-1])])

    def count_grams(self, frames):
        def rows():
            for hashes, lengths in _units(frames, self.unit):
                number, count, place = self.words.of_texts(hashes, lengths)
                for level in range(2, self.order + 1):
                    # Shorter grams than the highest order are counted here only if they begin with the start mark.
                    ends = np.flatnonzero(place >= level - 1 if level == self.order else place == level - 1)
                    keys = _hash(*(number[ends - k] for k in range(level - 1, -1, -1)))
                    order = np.argsort(keys)
                    new, n = runs(keys[order])
                    ends = ends[order[new]]
                    columns, counts = ([x[ends - k] for k in range(level - 1, -1, -1)] for x in (number, count))
                    for part, kind, body in self._dealt(columns, counts, n):
                        yield part, kind + 10 * level, body

        return batches(rows(), _ROWS)

    def _sums(self, n: np.ndarray, level: int, part: int) -> tuple:
        return part, _SUMS + 10 * level, squeezed(np.array([(n == i).sum() for i in (1, 2, 3, 4)], np.int64))

    def sum_grams(self, level: int):
        """Write a bucket's grams of one level, and pass on what the next one needs.  Rows of lower levels go by unchanged."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            bucket, out = int(pdf.part.iloc[0]), []
            for kind, own in pdf.groupby("kind"):
                if kind == _GRAMS + 10 * level:
                    out += self._write_grams(bucket, level, unsqueezed(own.body))
                elif kind == _CONTEXTS + 10 * (level + 1):
                    key, *sums = unsqueezed(own.body)
                    key, _, sums = _summed(key, [], sums)
                    self._write_contexts(f"split-{level + 1}-{bucket}", key, sums)
                else:
                    out += own.itertuples(index=False, name=None)
            return pd.DataFrame(out, columns=_ROWS.names)

        return run

    def _write_contexts(self, name: str, key: np.ndarray, sums: list[np.ndarray]) -> None:
        many = sums[0] > 1
        self.store.write_arrays(name, *self._contexts(key[many], [s[many] for s in sums]))

    @staticmethod
    def _contexts(key: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
        wide = np.uint32 if sums[0].max(initial=0) < 2**32 else np.uint64
        return [*shelf(key, 32), *(s.astype(wide) for s in sums)]

    def _write_grams(self, bucket: int, level: int, columns: list[np.ndarray]) -> list[tuple]:
        keys, own, (n,) = _summed(_hash(*columns[:level]), [*columns[:level], *columns[level + 1 :]], [columns[level]])
        words, counts = own[:level], own[level:]
        n = n.astype(np.int64)
        width, begin, bits = shelf(keys, 30)
        often = n > 3
        found = [width, begin, bits << np.uint32(2) | (np.minimum(n, 4) - 1).astype(np.uint32), *shelf(keys[often], 32), n[often].astype(np.uint64)]
        sums = [n, *(np.where(x, 1, 0) for x in (n == 1, n == 2, n > 2))]
        out = [self._sums(n, level, bucket)]
        if level > 2:
            _, split = buckets(words, [*counts, n], self.bits, self.per_bucket)
            context, (split,), sums = _summed(_hash(*words[:-1]), [split], sums)
            many = ~split & (sums[0] > 1)
            found += self._contexts(context[many], [s[many] for s in sums])
            to = _context_bucket(context[split], self.bits)
            order = np.argsort(to, kind="stable")
            out += _kinds(_packed(to[order], _CONTEXTS, [context[split][order], *(s[split][order] for s in sums)]), level)
            _, ends, (after,) = _summed(_hash(*words[1:]), [*words[1:], *counts[1:]], [np.ones(len(n), np.int64)])
            # The count of the last word isn't needed, since it is no part of a context.
            out += _kinds(self._dealt(ends[: level - 1], [*ends[level - 1 :], after], after), level - 1)
        else:
            out += self._by_word(*_summed(words[0].astype(np.uint64), [], sums)[::2], _CONTEXTS + 20)
            out += self._by_word(*_summed(words[1].astype(np.uint64), [], [np.ones(len(n), np.int64)])[::2], _GRAMS + 10)
        self.store.write_arrays(f"grams-{level}-{bucket}", *found)
        return out

    def _by_word(self, number: np.ndarray, sums: list[np.ndarray], kind: int) -> Iterator[tuple]:
        part = self._word_part(number)
        order = np.argsort(part, kind="stable")
        return _kinds(_packed(part[order], kind % 10, [number[order], *(s[order] for s in sums)]), kind // 10)

    def _word_part(self, number: np.ndarray) -> np.ndarray:
        """The bucket of a word; the start mark is in the first."""
        return np.where(number < FIRST, 0, (number - _U(FIRST)) & _U((1 << self.words.bits) - 1)).astype(np.int64)

    def finish_words(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Write what follows and precedes the words of a bucket, and give numbers of counts of all orders."""
        bucket = int(pdf.part.iloc[0]) & ((1 << self.words.bits) - 1)
        known = self.store.arrays(f"words-{bucket}")
        often = len(known[2]) if known else 0
        columns = np.zeros((5, often + 1), np.uint64)  # the last place is that of the start mark
        place = lambda number: np.where(number == START, often, (number.astype(np.int64) - FIRST) >> self.words.bits)
        levels = {k: np.zeros(4, np.int64) for k in range(1, self.order + 1)}
        types = total = 0
        for kind, own in pdf.groupby("kind"):
            if kind % 10 == _SUMS:
                for body in own.body:
                    levels[kind // 10] += unsqueezed([body])[0].astype(np.int64)
                continue
            number, *sums = unsqueezed(own.body)
            number, _, sums = _summed(number, [], sums)
            if kind == _GRAMS + 10:
                n = sums[0].astype(np.int64)
                levels[1] += [(n == i).sum() for i in (1, 2, 3, 4)]
                types, total = len(n), int(n.sum())
            at = place(number)
            some = at < often
            some |= number == START
            for row, s in zip(range(4) if kind == _CONTEXTS + 20 else (4,), sums, strict=True):
                columns[row, at[some]] = s[some]
        wide = np.uint32 if columns.max(initial=0) < 2**32 else np.uint64
        self.store.write_arrays(f"sums-{bucket}", *(c.astype(wide) for c in columns))
        return pd.DataFrame([[types, total, *(int(x) for k in levels for x in levels[k])]], columns=["types", "total", *(f"n{k}_{i}" for k in levels for i in (1, 2, 3, 4))])


def _kinds(rows: Iterable[tuple], level: int) -> Iterator[tuple]:
    return ((part, kind + 10 * level, body) for part, kind, body in rows)


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, from the numbers of counts of 1 to 4."""
    n1, n2, n3, n4 = (max(0, x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


class Model:
    """A fitted model: small numbers, and a store of arrays that is mapped where it is used.

    counts: of each order from 1 on, the numbers of counts of 1 to 4; follow: different words, and sum, of the lowest order.
    """

    def __init__(self, words: Words, order: int, bits: int, per_bucket: int, tokens: int, types: int, counts: list[list[int]], follow: tuple[int, int]) -> None:
        self.words, self.store, self.order, self.bits, self.per_bucket, self.tokens, self.types = words, words.store, order, bits, per_bucket, tokens, types
        self.off = [np.zeros(4), *map(discounts, counts)]
        more = follow[0] - counts[0][0] - counts[0][1]
        self.total = max(1, follow[1])
        self.rest = (self.off[1][1:] @ [counts[0][0], counts[0][1], more]) / self.total if follow[1] else 1.0

    def _word_sums(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of ascending numbers: sum, once, twice and more of what follows, and how many words precede."""
        out = np.zeros((5, len(number)), np.int64)
        single = (number >= FIRST) & (count == 1)
        out[0, single] = out[1, single] = out[4, single] = 1
        bits = self.words.bits
        many = np.flatnonzero((number >= FIRST) & (count > 1))
        part = (number[many] - FIRST) & ((1 << bits) - 1)
        order = np.argsort(part, kind="stable")
        for a, n in zip(*runs(part[order]), strict=True):
            own = many[order[a : a + n]]
            if have := self.store.arrays(f"sums-{int(part[order[a]])}"):
                rank = (number[own] - FIRST) >> bits
                for row, column in zip(out, have, strict=True):
                    row[own] = column[rank]
        start = np.flatnonzero(number == START)
        if len(start) and (have := self.store.arrays("sums-0")):
            out[:4, start] = np.array([c[-1] for c in have[:4]], np.int64)[:, None]
        return out

    def _grams(self, level: int, words: list[np.ndarray], counts: list[np.ndarray], ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sums) of grams, and of their contexts (sum, once, twice, more), where these are asked for and occur more than once."""
        n, sums = np.zeros(len(words[0]), np.int64), np.zeros((4, len(words[0])), np.int64)
        bucket, split = buckets(words, counts, self.bits, self.per_bucket)
        keys = _hash(*words)
        order = np.argsort((bucket.astype(np.uint64) << _U(44)) | (keys >> _U(20)))
        context = _hash(*words[:-1]) if level > 2 else None
        for a, length in zip(*runs(bucket[order]), strict=True):
            own = order[a : a + length]
            if not (have := self.store.arrays(f"grams-{level}-{int(bucket[own[0]])}")):
                continue
            width, begin, bits = have[:3]
            at, there = on_shelf(width, begin, bits, keys[own], 30)
            n[own[there]] = (bits[at[there]] & np.uint32(3)) + 1
            if len(often := own[n[own] == 4]):
                at, there = on_shelf(*have[3:6], keys[often], 32)
                n[often[there]] = have[6][at[there]]
            if level > 2 and len(have[9]):
                self._context_sums(have[7:], context, own[ask[own] & ~split[own]], sums)
        if level > 2 and len(some := np.flatnonzero(split & ask)):
            part = _context_bucket(context[some], self.bits)
            some = some[order := np.argsort(part, kind="stable")]
            for a, length in zip(*runs(part[order]), strict=True):
                if (have := self.store.arrays(f"split-{level}-{int(part[order[a]])}")) and len(have[2]):
                    self._context_sums(have, context, some[a : a + length], sums)
        return n, sums

    @staticmethod
    def _context_sums(have: list[np.ndarray], context: np.ndarray, own: np.ndarray, sums: np.ndarray) -> None:
        at, there = on_shelf(*have[:3], context[own], 32)
        for row, column in zip(sums, have[3:7], strict=True):
            row[own[there]] = column[at[there]]

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether training has it, log10 of its smoothed frequency, log10 of its probability."""
        number, count, place = self.words.of_texts(hashes, lengths)
        ids, first, where = np.unique(number, return_index=True, return_inverse=True)
        known = self._word_sums(ids, count[first])
        after = known[4]
        single = (after - self.off[1][np.minimum(after, 3)]) / self.total + self.rest / (self.types + 1)
        p, seen = single[where], np.zeros(len(number), np.int64)
        for level in range(2, self.order + 1):
            ends = np.flatnonzero(place >= level - 1)
            back = [ends - k for k in range(level - 1, -1, -1)]
            # A context of two words and more is there if it was found as a gram.
            there = seen[ends - 1] > 0 if level > 2 else np.ones(len(ends), bool)
            n, sums = self._grams(level, [number[i] for i in back], [count[i] for i in back], there)
            if level == 2:
                sums = known[:4, where[ends - 1]]
            else:
                sums[:2, there & (sums[0] == 0)] = 1
            off = self.off[level]
            left = np.maximum(n - off[np.minimum(n, 3)], 0) + (off[1] * sums[1] + off[2] * sums[2] + off[3] * sums[3]) * p[ends]
            p[ends] = np.where(sums[0] > 0, left / np.maximum(sums[0], 1), p[ends])
            seen = np.zeros(len(number), np.int64)
            seen[ends] = n
        token = place > 0
        base = np.log10((count[token] + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        return count[token] > 0, base, np.log10(p[token])


def fit(docs: DataFrame, *, order: int = ORDER, unit: int = UNIT, per_bucket: int = PER_BUCKET, text_per_bucket: int = TEXT_PER_BUCKET) -> Model:
    """A model of the column text of docs; order: the longest gram, 2 or more."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("text")
    starts, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words = Words(Store(f"{checkpoint_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"), max(0, math.ceil(math.log2(max(1, size) / text_per_bucket))), starts)
    words.store.create()
    try:
        count = _Counter(words.store, order, words, 0, unit, per_bucket)
        found = docs.mapInArrow(lambda frames: count.count_words(frames), _DDL).groupBy("part").applyInPandas(lambda pdf: count.number_words(pdf), "types long, tokens long")
        types, tokens = found.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        bits = max(4, math.ceil(math.log2(max(1, tokens) / per_bucket)))
        grams = _Counter(words.store, order, words, bits, unit, per_bucket)
        rows = docs.mapInArrow(lambda frames: grams.count_grams(frames), _DDL)
        for level in range(order, 1, -1):
            rows = rows.groupBy("part").applyInPandas(grams.sum_grams(level), _DDL)
        names = ["types", "total", *(f"n{k}_{i}" for k in range(1, order + 1) for i in (1, 2, 3, 4))]
        rows = rows.withColumn("part", F.col("part") % (1 << words.bits))
        stats = rows.groupBy("part").applyInPandas(lambda pdf: grams.finish_words(pdf), ", ".join(f"{x} long" for x in names))
        n = [int(x or 0) for x in stats.agg(*(F.sum(c) for c in names)).first()]
    except BaseException:
        words.store.delete()
        raise
    return Model(words, order, bits, per_bucket, int(tokens), int(types), [n[2 + 4 * k : 6 + 4 * k] for k in range(order)], (n[0], n[1]))


def score_documents(docs: DataFrame, model: Model, unit: int = UNIT // 2) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of docs (doc_id, text)."""

    def run(frames):
        for batch in frames:
            out = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float)]
            held, begin, n = [], 0, 0
            for _, to, tokens, counts in _tokens(batch.column("text")):
                held.append((tokens, counts))
                n += len(tokens)
                if n >= unit or to == batch.num_rows:
                    tokens, counts = map(np.concatenate, zip(*held, strict=True))
                    out[0][begin:to] = counts
                    for column, x in zip(out[1:], model.score(tokens, counts), strict=True):
                        column[begin:to] = np.add.reduceat(x, np.cumsum(counts) - counts, dtype=column.dtype)
                    held, begin, n = [], to, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def remainder_of_id(doc_id="doc_id", by: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def language_model_scores(docs: DataFrame, *, order: int = ORDER, held: int = 1, folds: int = 5, unit: int = UNIT, per_bucket: int = PER_BUCKET, text_per_bucket: int = TEXT_PER_BUCKET) -> DataFrame:
    """Scores of all docs by a model of those outside fold ``held`` (crc32 of the id's text, modulo folds)."""
    docs = docs.select("doc_id", "text")
    model = fit(docs.where(remainder_of_id(by=folds) != held), order=order, unit=unit, per_bucket=per_bucket, text_per_bucket=text_per_bucket)
    try:
        scored = score_documents(docs, model, unit // 2).withColumn("held_out", remainder_of_id(by=folds) == held).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
        return cut(scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    finally:
        model.store.delete()
