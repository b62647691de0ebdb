import itertools
import random
import shutil
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, awkward, empty, words
from pyspark.sql import functions as F

from orrery.llm import reshard as R
from orrery.llm import source_mix as M


def test_least_moves():
    r = random.Random(8)
    for _ in range(40):
        m, n = r.randint(1, 6), r.randint(1, 6)
        sizes = [r.randint(0, 50) for _ in range(m)]
        capacities = R.shares(sum(sizes), [1] * n)
        flow = R.least_moves(sizes, capacities)
        assert [sum(x) for x in flow] == sizes and [sum(x) for x in zip(*flow, strict=True)] == capacities
        moved = sum(x for i, row in enumerate(flow) for j, x in enumerate(row) if i != j)
        assert moved == sum(max(0, s - (capacities[i] if i < n else 0)) for i, s in enumerate(sizes))


def test_reshard(spark, monkeypatch):
    monkeypatch.setattr(R, "PER_BLOCK", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = R.reshard_documents(docs, F.when(F.col("doc_id") < 120, 0).otherwise(F.col("doc_id") % 5), 8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(texts) and {r.law for r in found} == {"bytes"}
    loads, slots = Counter(), defaultdict(list)
    for r in found:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    share = sum(loads.values()) / 8
    assert max(loads.values()) < 1.1 * share and min(loads.values()) > 0.9 * share
    old = Counter()
    for r in found:
        old[r.old_shard] += r["size"]
    moved = sum(r["size"] for r in found if r.old_shard != r.shard)
    assert moved <= sum(max(0, s - share) for s in old.values()) + 0.3 * share


def test_awkward_rows_are_all_placed(spark):
    placed = R.reshard_documents(awkward(spark), F.coalesce("n_chars", F.lit(0)) % 3, 4)
    assert Counter(r.doc_id for r in placed.collect()) == Counter(r[0] for r in AWKWARD)
    assert {r.slot for r in placed.where("shard = 0").collect()} == set(range(placed.where("shard = 0").count()))
    assert R.reshard_documents(empty(spark), F.lit(0), 4).count() == 0


@pytest.mark.parametrize(("old", "new"), [(3, 2), (2, 5), (4, 4)])
def test_rewritten_shards_hold_every_row_once(spark, tmp_path, old, new):
    uri, width = str(tmp_path / "shards"), 37
    docs = spark.range(180).selectExpr("id as doc_id", f"repeat('x', cast(id % {width} as int)) as text", f"cast(id % {old} as int) as shard", "'m' as middle", "'r' as rank")
    docs.write.partitionBy("shard").parquet(uri)
    def read():
        return spark.read.parquet(uri)

    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*.parquet")}
    rows = read().select("*", R.text_size(F.col("text")).alias("size"), F.col("shard").alias("old_shard"))
    placed = R.reshard(rows, new).cache()
    want = {r.doc_id: r.shard for r in placed.collect()}
    shards = R.rewrite_affected(placed.select("doc_id", "text", "middle", "rank", "old_shard", "shard", "slot"), uri)
    assert {r.doc_id: r.shard for r in read().collect()} == want and read().count() == 180
    assert sorted(len(r.text) for r in read().collect()) == sorted(i % width for i in range(180))
    assert sorted(p.name for p in (tmp_path / "shards").glob("[!.]*") if p.is_dir()) == sorted(f"shard={s}" for s in set(want.values()))
    kept = [p for p in before if int(p.parent.name[6:]) not in shards]
    assert all(p.stat().st_mtime_ns == before[p] for p in kept)
    if old == new:
        # A second time all rows are where they should be, up to what can't be told apart by size.
        again = R.reshard(read().drop("old_shard").select("*", R.text_size(F.col("text")).alias("size"), F.col("shard").alias("old_shard")), new)
        loads = Counter()
        for r in again.collect():
            loads[r.shard] += r["size"]
        assert max(loads.values()) - min(loads.values()) <= 2 * width


def test_a_lost_swap_is_ended_later(spark, tmp_path):
    uri = str(tmp_path / "s")
    spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id int, shard int").write.partitionBy("shard").parquet(uri)
    spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "doc_id int, shard int").write.partitionBy("shard").parquet(f"{uri}/_next/rows")
    R.finish_rewrite(spark, uri)
    assert (tmp_path / "s" / "shard=1").exists()  # not complete: nothing happens
    spark.createDataFrame([(0, False), (1, True), (2, False)], "shard int, emptied boolean").write.parquet(f"{uri}/_next/shards")
    # The swap was lost after shard 2.
    shutil.rmtree(tmp_path / "s" / "shard=2")
    (tmp_path / "s" / "_next" / "rows" / "shard=2").rename(tmp_path / "s" / "shard=2")
    R.finish_rewrite(spark, uri)
    R.finish_rewrite(spark, uri)
    assert sorted((r.doc_id, r.shard) for r in spark.read.parquet(uri).collect()) == [(1, 0), (2, 0), (3, 2)] and not (tmp_path / "s" / "_next").exists()


def test_rows_of_one_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "PER_BLOCK", 10)
    rows = spark.range(400).selectExpr("cast(null as long) as doc_id", "10L + id % 3 as size", "id as x", "0 as old_shard")
    found = R.reshard(rows, 4).collect()
    assert sorted(r.x for r in found) == list(range(400))
    for shard in range(4):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_mix(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("source"), M.word_count(F.col("text")).alias("size"))
    mixed, slots = M.mix_sources(docs, block=32, per_part=64)
    rows = mixed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 5 * 32 for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.mix_sources(docs.repartition(7), block=32, per_part=64)[0].collect()), key=str)
    order = slots.orderBy("slot").collect()
    for s in list(sizes)[:4]:
        at = [r.slot for r in order if r.source == s]
        gaps = [b - a for a, b in itertools.pairwise(at)]
        assert max(gaps) <= 4 * len(order) / len(at) + 2
        own = [(r.pass_no, r.block_no) for r in order if r.source == s]
        assert own == sorted(own) and len(set(own)) == len(own)


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark).drop("size").withColumn("size", M.word_count(F.col("text")))
    rows = M.mix_sources(docs)[0].collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], len(words(r[1]))) for r in AWKWARD)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert M.mix_sources(docs.limit(0))[0].count() == 0
    none = M.mix_sources(docs.where("doc_id in (3, 4, 5)"))[0].collect()
    assert len(none) == 3 and all(r.taken == 0 and r.target == 0 for r in none)


def test_small_sources_reach_their_targets(spark):
    rng = random.Random(6)
    rows = [(i, "large", 500) for i in range(400)]
    for s in range(1000):
        left = rng.randint(1, 200)
        while left > 0:
            n = min(left, rng.randint(1, 60))
            rows.append((len(rows), f"s{s:04}", n))
            left -= n
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed, slots = M.mix_sources(docs, per_part=64)
    taken, target = Counter(), {}
    for r in mixed.collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and len(target) == 1001
    order = slots.collect()
    assert len({r.slot for r in order}) == len(order) and sum(r.words for r in order) == sum(taken.values())
    lengths = {}
    for r in order:
        lengths.setdefault(r.source, []).append(r.words)
    assert all(max(x) - min(x) <= 1 for x in lengths.values()) and set(lengths) == {s for s in target if round(target[s]) > 0}


@pytest.mark.parametrize("long", [[100_000], [100_000, 5_000, 5_000], [9_000] * 4, [400] * 3])
def test_rows_longer_than_a_share_leave_the_rest_level(spark, long):
    rng = random.Random(11)
    sizes = [*long, *(rng.randint(1, 80) for _ in range(600))]
    rows = spark.createDataFrame([(i, n, rng.randrange(5)) for i, n in enumerate(sizes)], "doc_id long, size long, old_shard int")
    found = R.reshard(rows, 16).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(sizes)))
    loads, at = Counter(), defaultdict(list)
    for r in found:
        loads[r.shard] += r["size"]
        at[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in at.values())
    alone = R.alone(sorted(sizes, reverse=True)[:16], sum(sizes), 16)
    assert alone == (len(long) if long[0] > 2000 else 0)
    single = {r.shard for r in found if r["size"] >= 5000}
    assert len(single) == alone and all(loads[s] == max(r["size"] for r in found if r.shard == s) for s in single)
    rest = [loads[s] for s in range(16) if s not in single]
    assert max(rest) - min(rest) <= 2 * 80 + (400 if not alone else 0)
