"""Findings of the third round: what each changed, on small inputs that gave another result or too much work before."""

import re
import time

import numpy as np
import pandas as pd

from orrery.operators import cluster as C
from orrery.operators import export as X
from orrery.operators import memories as M
from orrery.operators import text as Q
from orrery.operators import timeline as L
from orrery.operators import vector as V
from orrery.plans.queries import SQL

DAY = 86_400_000


def test_new_arrivals_counts_every_month(spark, tmp_path):
    """A newcomer with one photo in each of four months counts, in the query and in its SQL."""
    import duckdb

    from orrery.plans.queries import QUERIES

    spark.sql("SELECT o_orderkey, o_orderkey AS o_custkey, make_timestamp(1995 + if(o_orderkey > 14, 2, 0), 1 + cast(o_orderkey % 4 AS int), 1, 0, 0, 0) AS o_orderdate FROM VALUES (1L), (2L), (3L), (7L), (8L), (9L), (13L), (14L), (15L), (19L), (20L), (21L) AS t(o_orderkey)").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, if(o_orderkey > 14, 2L, 1L) AS l_suppkey, 5.0D AS l_quantity, 'N' AS l_returnflag, 'O' AS l_linestatus, 0.1D AS l_discount, 0.1D AS l_tax FROM VALUES (1L), (2L), (3L), (7L), (8L), (9L), (13L), (14L), (15L), (19L), (20L), (21L) AS t(o_orderkey)").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1L AS s_suppkey, 'A' AS s_name, 1.0D AS s_acctbal, 1 AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT 1L AS vec_id, array(1.0F) AS embedding, 1 AS label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01' AS ts, 1L AS user_id, 'a' AS event_type, 1.0D AS value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    for name in ("orders", "lineitem", "supplier", "embeddings", "events"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    have = [(r.year, r.n) for r in QUERIES["new_arrivals"](spark, str(tmp_path)).collect()]
    assert have == [(1997, 1)] == [row[:2] for row in duck.execute(SQL["new_arrivals"]).fetchall()]
    months = spark.createDataFrame([(1, 0, 9)] + [(2, 24 + k, 1) for k in range(4)], "person_id long, month int, n long")
    assert [(r.year, r.n, r.month) for r in L.new_arrivals(months, people=1).collect()] == [(2, 1, 24)]


def test_on_this_day_looks_at_every_photo(spark):
    """The best photo is the last of 1,600 in a day."""
    at = 1_000 * DAY
    dates = spark.range(1600).selectExpr("id AS key", f"{at} + id AS taken_ms", "1 AS src", "false AS junk")
    scores = spark.range(1600).selectExpr("id AS media_key", "if(id = 1599, 250.0D, 3.0D) AS score")
    ranges = spark.createDataFrame([(1972, at, at + DAY)], "year int, start long, end long")
    assert [(r.total, r.best) for r in M.on_this_day(dates, scores, ranges).collect()] == [(1600, 250.0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_parts_hold_no_list_of_a_job(spark):
    """A job's entries go by as they come; an unknown cost leaves the sum unknown, and equal places don't begin a part twice."""
    rows = [(1, k, 400_000) for k in range(6)] + [(2, 0, None), (2, 1, 900_000), (2, 2, 900_000), (3, 5, 700_000), (3, 5, 800_000)]
    found = X.parts(spark.createDataFrame(rows, "job long, ord long, cost long"), 1_000_000 + X.RESERVE)
    assert "collect_list" not in plan(found) and "Window" not in plan(found)
    assert sorted((r.job, r.ord, r.part) for r in found.collect()) == [(1, k, k // 2) for k in range(6)] + [(2, 0, 0), (2, 1, 0), (2, 2, 0), (3, 5, 0), (3, 5, 1)]


def test_mentions_deal_out_texts_once(spark):
    """Words meet names without their texts, which come once for an id with all of its candidates; null ids stay."""
    texts = spark.createDataFrame([(1, "Anna and Bo met Anna"), (None, "bo"), (2, "nobody")], "id long, text string")
    people = spark.createDataFrame([(1, "Anna"), (2, "Bo"), (3, "Anna Lee")], "id long, name string")
    found = Q.mentions(texts, people)
    assert sorted(((r.id or 0), r.person, r.at) for r in found.collect()) == [(0, 2, 0), (1, 1, 0), (1, 2, 9)]
    kept = re.findall(r"Generate explode\(array_distinct\(.*?\)\), \[([^\]]*)\], (?:true|false)", plan(found).split("== Physical Plan ==")[1])
    assert kept and not any("text#" in columns for columns in kept)


def test_mutual_match_keeps_no_pairs_of_faces(spark):
    """Blocks smaller than the groups give what one block gives; faces without a vector or of another length count, but meet none."""
    a = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(5)] + [(2, 9, [1.0, 0.0])], "pair long, id long, embedding array<double>")
    b = spark.createDataFrame([(1, 10 + k, [1.0, float(k)]) for k in range(4)] + [(1, 20, None), (1, 21, [1.0])], "pair long, id long, embedding array<double>")
    for size in (2, 2048):
        found = C.mutual_match(a, b, size)
        assert "zip_with" not in plan(found) and [(r.pair, round(r.score, 6)) for r in found.collect()] == [(1, 6.0)]


def test_blocks_meet_in_bounded_steps(spark):
    """A block of 700 left rows meets the right ones in steps of 256 at most, and every row once."""
    rows = spark.range(700).selectExpr("id", "array(cast(id AS double)) AS v")

    def meet(ids, x, others, y):
        return pd.DataFrame({"id": ids, "step": len(ids), "n": len(others)})

    found = V.block_join(rows, spark.range(3).selectExpr("id", "array(1.0D) AS v"), meet, "id long, step long, n long").collect()
    assert sorted(r.id for r in found) == list(range(700)) and max(r.step for r in found) <= 256 and {r.n for r in found} == {3}


def test_many_people_merge_soon():
    """1,500 people with two faces each: all pairs were gone through one by one before."""
    rng, groups = np.random.default_rng(5), C.Groups(64, C.Thresholds())
    people = C.unit(rng.normal(size=(1500, 64)))
    for k, e in enumerate(people):
        for photo in (2 * k, 2 * k + 1):
            groups.learn(k + 1, e, 1.0)
            groups.join(k + 1, photo)
    groups.learn(9001, people[7], 1.0)
    groups.join(9001, 9001)
    start = time.monotonic()
    into = groups.merged(set(), set(), set())
    assert into[9001] == 8 and len(set(into.values())) >= 1 and time.monotonic() - start < 10
    start = time.monotonic()
    assert groups.merged(set(), set(), set()) == {} or time.monotonic() - start < 10
