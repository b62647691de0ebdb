"""Resharding by minimum-cost flow: from the old shards' sizes and the new capacities to the fewest bytes moved.

Rows of an old shard are numbered by bytes, in two levels (sums of hash blocks, then a running sum inside each
block; the hash is that of the whole row, so a repeated or null key is no hot block).  The flow between old and new shards is solved on the driver, on at most old x new numbers: a byte that
stays costs nothing, one that moves costs one.  A flow becomes a range of the old shard's bytes, what stays first;
whole blocks and, at the ends of ranges, rows of one block are transferred, a row by the place of its middle.

Rows are placed in three rounds, long ones first (over an 8th of a shard, over a 64th, the rest): each round is
split as what is left of the flow, so shorter rows level out what longer ones could not split.  A row that is longer than
an equal share of what is left beside longer ones, as fewer rows than shards can be, has a shard alone, its own old one
where that is free; the flow then levels the rest over the other shards.

Defined results: a null text has size 1 and CRC 0 like an empty one; a null shard key is an old shard of its
own; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.cut import cut
from orrery.shipping import ship

PER_BLOCK = 1 << 12
ROUNDS = (8, 64)


def least_moves(sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j: all sizes, within capacities, moving the fewest bytes (i = j stays).

    Successive cheapest augmenting paths; sizes must not add up to more than capacities.
    """
    m, n = len(sizes), len(capacities)
    flow = [[0] * n for _ in range(m)]
    left, room = list(sizes), list(capacities)
    while any(left):
        far = [0 if left[i] else math.inf for i in range(m)] + [math.inf] * n
        come = [-1] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    cost = int(i != j)
                    if far[i] + cost < far[m + j]:
                        far[m + j], come[m + j], changed = far[i] + cost, i, True
                    if flow[i][j] and far[m + j] - cost < far[i]:
                        far[i], come[i], changed = far[m + j] - cost, m + j, True
        end = min((j for j in range(n) if room[j]), key=lambda j: (far[m + j], j))
        path = [m + end]
        while come[path[-1]] >= 0:
            path.append(come[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        most = min([left[path[0]], room[end], *(flow[b][a - m] for a, b in steps if a >= m)])
        for a, b in steps:
            if a < m:
                flow[a][b - m] += most
            else:
                flow[b][a - m] -= most
        left[path[0]] -= most
        room[end] -= most
    return flow


def ranges(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, begin, end) in bytes of the old shard, what stays first."""
    found = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                found.append((i, j, at, at + row[j]))
                at += row[j]
    return found


def shares(total: int, weights: list[int]) -> list[int]:
    """total split by weights into whole numbers that add up to it."""
    whole, at, out = sum(weights), 0, []
    for k in range(len(weights)):
        to = total * sum(weights[: k + 1]) // whole
        out.append(to - at)
        at = to
    return out


def alone(longest: list[int], total: int, shards: int) -> int:
    """How many of the longest rows (sizes, in falling order) are longer than an equal share of all but those before them."""
    k = 0
    while k < len(longest) and longest[k] * (shards - k) > total:
        total, k = total - longest[k], k + 1
    return k


def reshard(rows: DataFrame, shards: int) -> DataFrame:
    """rows (size, old_shard from 0, and others) with shard and slot, gapless from 0 in each shard; columns of these two
    names are replaced."""
    ship(rows.sparkSession)
    others = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = cut(rows.select("size", "old_shard", F.struct(*others).alias("row")))
    total, n, olds = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("old_shard"), F.lit(-1)) + 1).first()
    longest = [r.size for r in rows.select("size").orderBy(F.desc("size")).limit(shards).collect()]
    giants = alone(longest, total, shards)
    share = (total - sum(longest[:giants])) / (shards - giants)
    least = longest[giants - 1] if giants else (longest[0] + 1 if longest else 1)
    level = F.when(F.col("size") >= least, 0).when(F.col("size") * ROUNDS[0] > share, 1).when(F.col("size") * ROUNDS[1] > share, 2).otherwise(3)
    rows = rows.withColumn("level", level).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(-(-n // PER_BLOCK) or 1)))
    key = ["level", "old_shard", "block"]
    before = Window.partitionBy("level", "old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.sum("size").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    inside = Window.partitionBy(*key).orderBy(F.xxhash64("row", F.lit(1)), "row")
    rows = rows.withColumn("middle", 2 * F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = cut(rows.join(blocks, key).withColumn("middle", F.col("middle") + 2 * F.col("base")).drop("base"))

    spark = rows.sparkSession
    sizes = {(r.level, r.old_shard): r.size for r in rows.groupBy("level", "old_shard").agg(F.sum("size").alias("size")).collect()}  # at most 3 x old numbers
    rounds = range(1, len(ROUNDS) + 2)
    rest = [sum(sizes.get((k, i), 0) for k in rounds) for i in range(olds)]
    free = sorted(range(shards), key=lambda j: rest[j] if j < olds else 0)
    moves: list[tuple[int, int, int, int, int]] = []
    # Fewer rows than shards: those that keep their shard first.
    single = rows.where("level = 0").select("old_shard", "middle", "size").orderBy(F.desc("size"), "old_shard", "middle").collect()
    for stays in (True, False):
        for r in list(single):
            if not stays or r.old_shard in free:
                to = r.old_shard if stays else free[0]
                free.remove(to)
                single.remove(r)
                moves.append((0, r.old_shard, to, (r.middle - r.size) // 2, (r.middle + r.size) // 2))
    equal = iter(shares(sum(rest), [1] * len(free)))
    flow = least_moves(rest, [next(equal) if j in free else 0 for j in range(shards)])
    left = [list(x) for x in flow]
    schema = "level int, old_shard int, shard int, begin long, end long"

    def placed(found: list[tuple[int, int, int, int, int]]) -> DataFrame:
        to = F.broadcast(spark.createDataFrame(found, schema))  # at most 3 x old x new rows
        return rows.join(to, ["level", "old_shard"]).where("middle >= 2 * begin and middle < 2 * end").drop("begin", "end")

    for k in rounds:
        # This round's bytes of an old shard are split as what is left of its flow.
        split = [shares(sizes.get((k, i), 0), [max(0, x) for x in left[i]] if any(x > 0 for x in left[i]) else [*flow[i][:-1], flow[i][-1] + (not sum(flow[i]))]) for i in range(olds)]
        own = [(k, *x) for x in ranges(split)]
        if own:
            moves += own
            for r in placed(own).groupBy("old_shard", "shard").agg(F.sum("size").alias("size")).collect():
                left[r.old_shard][r.shard] -= r.size
    found = placed(moves)
    before = Window.partitionBy("shard").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("shard", *key).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", *key).orderBy("middle", "row")) - 1
    found = found.withColumn("rank", rank).join(starts, ["shard", *key])
    return found.select("row.*", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def rewrite_affected(placed: DataFrame, uri: str) -> list[int]:
    """Rewrite the shards that gain or lose rows, under uri/shard=N; files of the others stay.  Returns these shards.

    placed: rows with old_shard, shard and slot; it may be read from uri itself.  New files are complete under uri/_next,
    which readers pass over, before an old one goes.  A run that is lost before that changes nothing; one that is lost
    later is ended by ``finish_rewrite``.  A shard that loses all its rows goes.
    """
    spark = placed.sparkSession
    moved = placed.where("old_shard <> shard")
    touched = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    shards = sorted(r.shard for r in touched.collect())  # at most old + new numbers
    if shards:
        found = placed.where(F.col("shard").isin(shards)).repartition("shard", F.floor(F.col("slot") / PER_BLOCK))
        found.write.mode("overwrite").partitionBy("shard").parquet(f"{uri}/_next/rows")
        written = {r.shard for r in placed.select("shard").distinct().collect()}  # at most new numbers
        spark.createDataFrame([(s, s not in written) for s in shards], "shard int, emptied boolean").coalesce(1).write.mode("overwrite").parquet(f"{uri}/_next/shards")
        finish_rewrite(spark, uri)
    return shards


def finish_rewrite(spark: SparkSession, uri: str) -> None:
    """Put the rewritten shards of uri/_next in place of the old ones; may be called again if it was lost on its way."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(f"{uri}/_next/shards/_SUCCESS")):
        return
    shards = spark.read.schema("shard int, emptied boolean").parquet(f"{uri}/_next/shards").collect()
    for r in shards:
        new, old = path(f"{uri}/_next/rows/shard={r.shard}"), path(f"{uri}/shard={r.shard}")
        if fs.exists(new) or r.emptied:  # else it has been put in place before
            fs.delete(old, True)
        if fs.exists(new):
            fs.rename(new, old)
    fs.delete(path(f"{uri}/_next"), True)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def reshard_documents(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, old_shard, grown_shard of docs (doc_id, text)."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    law = F.lit("bytes").alias("law")
    return reshard(rows, shards).select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("long").alias("slot"), "old_shard", F.lit(None).cast("int").alias("grown_shard"))
