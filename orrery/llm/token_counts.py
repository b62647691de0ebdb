"""Token counts by a linear longest-match automaton.

Greedy word pieces take, at each place of a word, the longest entry of the vocabulary.  The automaton is the
vocabulary's trie with a failure link and a count for each node: when the next byte has no child, the greedy
choice of what has been read is known, so the count says how many pieces it pops and the link leads to the node
of the bytes that remain.  Each byte is read once, and no piece is built.

The vocabulary is one of byte strings in which a word begins with a space; as it has all single bytes, every
word has pieces.  Words are maximal runs other than 0x20 and 0x09-0x0D.

Defined results: a null or blank text has 0 words and 0 tokens; repeated rows count alike; an empty table gives
no rows.  Tasks remember the counts of words up to a fixed number of words.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.llm.columns import unused
from orrery.shipping import ship

REMEMBERED = 500_000


def read_ranks(data: bytes) -> list[bytes]:
    """The byte strings of a vocabulary file of lines "base64 rank"."""
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class Automaton:
    def __init__(self, entries: list[bytes]) -> None:
        self.child: list[dict[int, int]] = [{}]
        token = [False]
        for entry in entries:
            at = 0
            for b in entry:
                to = self.child[at].get(b)
                if to is None:
                    to = self.child[at][b] = len(self.child)
                    self.child.append({})
                    token.append(False)
                at = to
            token[at] = bool(entry)
        if any(b not in self.child[0] or not token[self.child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.link, self.popped = [0] * len(token), [0] * len(token)
        queue = deque((c, 0, b) for b, c in self.child[0].items())
        while queue:
            at, parent, b = queue.popleft()
            if token[at]:
                self.link[at], self.popped[at] = 0, 1
            else:
                to, n = self.link[parent], self.popped[parent]
                while b not in self.child[to]:
                    n += self.popped[to]
                    to = self.link[to]
                self.link[at], self.popped[at] = self.child[to][b], n
            queue.extend((c, at, x) for x, c in self.child[at].items())

    def count(self, word: bytes) -> int:
        """How many greedy pieces word has."""
        child, link, popped = self.child, self.link, self.popped
        at = n = 0
        for b in word:
            while (to := child[at].get(b)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at:
            n += popped[at]
            at = link[at]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: bytes, *keep: str) -> DataFrame:
    """The columns keep of docs, n_words and n_tokens of column text; vocabulary: what a ranks file holds.

    A column of keep that has one of these names is named with an underscore more.
    """
    ship(docs.sparkSession)
    kept = docs.select(*keep)
    names = kept.columns
    out_names = [*(unused(("n_words", "n_tokens"), n) for n in names), "n_words", "n_tokens"]
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counts = _Counts(Automaton(read_ranks(sent.value)))
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                own = (text.as_py() or b"").split()
                words[i], tokens[i] = len(own), sum(map(counts.__getitem__, own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words), pa.array(tokens)], names=out_names)

    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(out_names, kept.schema.fields, strict=False)), StructField("n_words", LongType()), StructField("n_tokens", LongType())])
    return docs.select(*keep, F.col("text").cast("binary").alias(unused(names, "text_to_count"))).mapInArrow(run, schema)
