"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Only DataFrame functions run here.  Slot i of the schedule has the golden-ratio point ``i * 1327217885 mod 2**31``;
mapped through the cumulative targets it names a source.  Golden-ratio points fill every interval evenly, so any
stretch of the schedule is mixed alike.  The documents of a source, in the order of a keyed hash, form one stream of
words that is gone through again and again until its target is reached; these words are cut into as many equal blocks
(up to one word) as the source has slots, and the slot's rank among them names its block.  So every source gives its
target up to half a word, however small it is.  A source that no point meets, as only one of less than a few blocks can
be, gets a slot at the end.

Ranks and word offsets are taken in two levels (counts of parts, then a window inside each part), so that a
source with most of the rows isn't one window.  Points find their source in BINS equal bins, in order inside each, with
the last source of the bins before: that table of BINS rows is all that is broadcast.  The table of sources is the only
thing ordered as a whole.

Defined results: a null text has no words; a document without words takes 0; null is the last source;
sources of no words have target 0; an empty table gives no rows; rows with one doc_id are separate documents that are
ordered by their content and size; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.cut import cut
from orrery.shipping import ship

#: Odd integer next to 2**31 / golden ratio.
STEP = 1327217885
POINTS = 1 << 31
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BINS = 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> also weight, target and the cumulative bounds [low, high) among POINTS.

    A target is min(most * size, level * weight); the level at which they add up to share * all sizes is the
    greatest of the levels that remain when the sources that fill up first are set aside one by one.
    """
    by_name, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("place").cast("int") % len(weights) + 1).cast("double")
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w)
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    unfilled = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    x = x.withColumn("level", F.greatest(left, F.lit(0.0)) / unfilled)
    x = x.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight")))
    before = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("target").over(whole)
    x = x.withColumn("high", F.when(total > 0, F.floor(before / total * POINTS)).otherwise(0).cast("long"))
    return x.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0)).cast("long"))


def word_streams(docs: DataFrame, seed: str, per_part: int) -> DataFrame:
    """doc_id, source, size, content -> also source_size and start, the first word in the source's shuffled stream."""
    spread = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("content", F.lit(""))))
    docs = docs.withColumn("shuffle", spread).drop("content")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / per_part))
    docs = docs.join(sizes.select(F.col("source").alias("s"), parts.alias("parts"), "source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    part = F.floor(F.conv(F.substring("shuffle", 1, 7), 16, 10).cast("long") * F.col("parts") / (1 << 28))
    docs = docs.withColumn("part", part.cast("long"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("source", "part").agg(F.sum("size").alias("words"))
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    docs = docs.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return docs.withColumn("start", F.col("base") + F.col("inside")).drop("s", "p", "base", "inside", "part", "parts", "shuffle")


def schedule(targets: DataFrame, block: int, per_part: int = 1 << 16) -> DataFrame:
    """slot, place and block_no, the rank among its source's slots, of all slots in order; each source has one at least."""
    x = targets.groupBy().agg(F.ceil(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("long").alias("n"))
    chunks = x.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(per_part).cast("long"))).alias("chunk"), "n")
    slots = chunks.repartition(F.col("chunk")).select("chunk", F.explode(F.expr(f"sequence(chunk, least(chunk + {per_part}, n) - 1)")).alias("slot"))
    slots = slots.withColumn("point", (F.col("slot") % POINTS) * F.lit(STEP).cast("long") % POINTS)
    bin_ = F.floor(F.col("point") / (POINTS // BINS)).alias("bin")
    marks = targets.where("high > low").select(F.col("low").alias("point"), "place").select(bin_, "point", "place")
    every = targets.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    lasts = every.join(marks.groupBy("bin").agg(F.max_by("place", "point").alias("last")), "bin", "left")
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("bin", F.last("last", True).over(earlier).alias("earlier"))
    none = F.lit(None).cast("long")
    rows = slots.select(bin_, "point", none.alias("place"), "chunk", "slot").unionByName(marks.select("bin", "point", F.col("place").cast("long"), none.alias("chunk"), none.alias("slot")))
    so_far = Window.partitionBy("bin").orderBy("point", F.col("slot").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = rows.withColumn("own", F.last("place", True).over(so_far)).where("slot is not null").join(F.broadcast(lasts), "bin")
    slots = slots.select("chunk", "slot", F.coalesce("own", "earlier").alias("place"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n")).select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    slots = slots.withColumn("inside", inside).join(base.hint("merge"), ["place", "chunk"]).select("slot", "place", (F.col("base") + F.col("inside")).alias("block_no"))
    missed = targets.where("words > 0").select(F.col("place").cast("long").alias("place")).join(slots.select("place").distinct(), "place", "left_anti")
    number = (F.row_number().over(Window.orderBy("place")) - 1).cast("long")
    missed = missed.crossJoin(F.broadcast(x)).select((F.col("n") + number).alias("slot"), "place", F.lit(0).cast("long").alias("block_no"))
    return slots.unionByName(missed)


def mix_sources(docs: DataFrame, *, block: int = 128, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", per_part: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule) for docs of doc_id, source, size and perhaps content, a text that tells rows of one id apart.

    documents: doc_id, source, size, source_size, target and taken, the words that the schedule takes of each document with
    repeats, ``most`` times its size at most.  schedule: slot, source, block_no, first and words, the block's first word in
    the source's stream with repeats and its length (about ``block``), and pass_no, how often the stream began anew before.
    """
    ship(docs.sparkSession)
    content = F.col("content").cast("string") if "content" in docs.columns else F.lit("")
    docs = cut(word_streams(cut(docs.select("doc_id", "source", "size", content.alias("content"))), seed, per_part))
    sources = docs.groupBy("source").agg(F.max("source_size").alias("source_size"))
    targets = cut(source_targets(sources, weights, share, most).withColumn("words", F.floor(F.col("target") + 0.5)))
    slots = cut(schedule(targets, block))
    counts = slots.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    # The first ``longer`` of a source's n blocks have one word more than the others.
    plan = targets.join(counts, "place").withColumn("n", F.least("n", "words")).where("n > 0")
    plan = cut(plan.select("place", "source", "source_size", "words", "n", F.floor(F.col("words") / F.col("n")).alias("length"), (F.col("words") % F.col("n")).alias("longer")))
    first = F.col("block_no") * F.col("length") + F.least("block_no", "longer")
    blocks = slots.join(plan, "place").where(F.col("block_no") < F.col("n")).withColumn("first", first)
    blocks = blocks.withColumn("words", F.col("length") + F.when(F.col("block_no") < F.col("longer"), 1).otherwise(0))
    blocks = blocks.select("slot", "place", "source", "block_no", "first", "words", F.floor(F.col("first") / F.col("source_size")).alias("pass_no"))

    edge = F.col("longer") * (F.col("length") + 1)
    at = lambda w: F.when(w < edge, F.floor(w / (F.col("length") + 1))).otherwise(F.col("longer") + F.floor((w - edge) / F.col("length")))
    named = plan.drop("source_size", "n").withColumnRenamed("source", "s")
    pieces = docs.where("size > 0").withColumn("row", F.struct("doc_id", "size", "start")).join(named, F.col("source").eqNullSafe(F.col("s")))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size"))))
    pieces = pieces.withColumn("pass", passes).withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), "words")).where("a < b")
    pieces = pieces.select("place", "row", "a", "b", F.explode(F.sequence(at(F.col("a")), at(F.col("b") - 1))).alias("block_no"))
    met = pieces.join(blocks.select("place", "block_no", "first", "words").hint("merge"), ["place", "block_no"])
    words = F.least("b", F.col("first") + F.col("words")) - F.greatest("a", "first")
    taken = met.groupBy("place", F.col("row").alias("r")).agg(F.sum(words).alias("taken")).withColumnRenamed("place", "of")
    wanted = targets.select(F.col("source").alias("s"), "place", "target")
    docs = docs.withColumn("row", F.struct("doc_id", "size", "start")).join(wanted, F.col("source").eqNullSafe(F.col("s")))
    docs = docs.join(taken, (F.col("place") == F.col("of")) & (F.col("row") == F.col("r")), "left")
    docs = docs.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return docs, blocks.drop("place")
