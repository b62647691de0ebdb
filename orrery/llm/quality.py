"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and runs of other signs, as written; features are single words and pairs of
neighbours (two of the same word are one feature whatever the word), hashed to ``1 << BITS`` weights.  A text's feature has the value count / sqrt(number of words), and its
score is the logistic function of the sparse dot product and a bias.

An example is a document with a label; training reads at most about ``sample`` of them (all, if there are fewer; else
those with the smallest hashes of id and text), the only bounded thing here.  Tasks learn from parts of about ``PART``
examples, dealt by the same hash and the label, and their weights are averaged, so no task or driver holds more than its
part, even where all examples have one id.

Defined results: a null, empty or blank text scores the bias alone; a row without a label, or with a null one,
isn't learned from; ids with several labels, or several texts, are an example for each; repeated rows are one example;
without examples every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orrery.llm import text as T
from orrery.llm.columns import unused
from orrery.shipping import ship

BITS, PART, EPOCHS, SAMPLE = 18, 5000, 3, 20_000
#: Bytes of text whose words are looked at together, so that a worker's arrays are of a few MB.
AT_ONCE = 1 << 18
#: The feature of any word that follows itself.
_SAME = np.uint64(0x5851F42D4C957F2D)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 1.0


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, features, how many of them each row has, number of words of each row)."""
    for at, to, data, offsets in T.chunks(texts, AT_ONCE):
        starts, stops, counts = T.class_runs(data, offsets)
        one = T.word_hashes(data, starts, stops)
        rows = np.repeat(np.arange(to - at), counts)
        pair = T.mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        pair[one[1:] == one[:-1]] = _SAME
        pair = pair[rows[1:] == rows[:-1]]
        both = np.concatenate([one, pair])
        of = np.concatenate([rows, rows[1:][rows[1:] == rows[:-1]]])
        order = np.argsort(of, kind="stable")
        yield at, to, (both[order] >> np.uint64(64 - BITS)).astype(np.int32), np.bincount(of, minlength=to - at), counts


def train(examples: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the bias last, after EPOCHS passes over (label, features, values) in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, i, x in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z)))


class _Examples:
    """(label, features, values) of a part's rows in their order; values, of eight bytes, are made anew in each pass."""

    def __init__(self, part: pa.Table) -> None:
        order = pc.sort_indices(part.select(["spread", "label", "words"]), [(c, "ascending") for c in ("spread", "label", "words")]).to_pylist()
        label, words = part["label"].to_pylist(), part["words"].to_pylist()
        self.rows = [(label[k], np.sqrt(max(1, words[k])), *self.counted(part["features"][k].as_buffer())) for k in order]

    @staticmethod
    def counted(features: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        i, count = np.unique(np.frombuffer(features, np.int32), return_counts=True)
        return np.append(i, np.int32(1 << BITS)), count.astype(np.min_scalar_type(count.max(initial=0)))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for label, root, i, count in self.rows:
            yield label, i, np.append(count / root, 1.0)


def _train_part(part: pa.Table) -> pa.Table:
    return pa.table({"examples": [part.num_rows], "weights": [train(_Examples(part)).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, label)."""
    ship(docs.sparkSession)
    labels = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    # Counts of ids, so that one with many rows meets as one.
    both = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")), "doc_id")
    found = both.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    share, parts = min(1.0, sample / max(1, found)), max(1, -(-min(found, sample) // PART))
    spread = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string"), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    chosen = docs.withColumn("spread", spread).where(F.conv(F.substring("spread", 1, 8), 16, 10).cast("long") <= int(share * 2**32))
    # Broadcast: about ``sample`` rows of two short columns, so no text moves before it is features.
    rows = chosen.drop("doc_id").join(F.broadcast(chosen.select("doc_id", "spread").join(labels, "doc_id").select("spread", "label").distinct()), "spread")

    def run(batches):
        for batch in batches:
            for at, to, features, counts, n in _features(batch.column("text")):
                ends = np.cumsum(counts)
                blobs = pa.array([features[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("spread"), part.column("label"), pa.array(n, pa.int64()), blobs], names=["spread", "label", "words", "features"])

    rows = rows.select("text", "spread", F.col("label").cast("int")).mapInArrow(run, "spread string, label int, words long, features binary").dropDuplicates(["spread", "label"])
    part = F.pmod(F.xxhash64("spread", "label"), F.lit(parts))
    # One array of fixed size for each part.
    found = rows.groupBy(part.alias("part")).applyInArrow(_train_part, "examples long, weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1)
    return np.average([np.frombuffer(r.weights) for r in found], axis=0, weights=[r.examples for r in found])


def score(docs: DataFrame, weights: np.ndarray, *keep: str, name: str = "quality_score") -> DataFrame:
    """The columns keep of docs and the score of column text, under a name that keep lacks."""
    ship(docs.sparkSession)
    kept = docs.select(*keep)
    names = [*kept.columns, name]
    # A text that is kept is sent once.
    own = keep.index("text") if "text" in keep and len(keep) == len(kept.columns) else len(kept.columns)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for batch in batches:
            # Given back as it is scored, so that no whole batch is in memory again on its way.
            for at, to, features, counts, n in _features(batch.column(own)):
                total = np.concatenate([[0.0], np.cumsum(w[features])])
                ends = np.cumsum(counts)
                out = (total[ends] - total[ends - counts]) / np.sqrt(np.maximum(n, 1))
                out = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns[: len(names) - 1], pa.array(out)], names=names)

    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])
    also = [] if own < len(kept.columns) else [F.col("text").alias(unused(names, "text_to_score"))]
    return docs.select(*keep, *also).mapInArrow(run, schema)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, held: int = 0) -> DataFrame:
    """doc_id, held_out, score of docs (doc_id, text); labels (doc_id, label) outside fold ``held`` are learned."""
    docs = docs.select("doc_id", "text")
    weights = fit(docs, labels.where(fold() != held), sample)
    scored = score(docs, weights, "doc_id")
    return scored.select("doc_id", (fold() == held).alias("held_out"), F.col("quality_score").alias("score"))
