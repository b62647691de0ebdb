import datetime

from pyspark.sql import functions as F

from orrery.functions import media as M
from orrery.operators import cluster as C
from orrery.operators import memories as R
from orrery.operators import state as U


def test_metadata(spark):
    df = spark.createDataFrame([("2019:08:12 10:15:00", None), ("nonsense", "2020:01:01 00:00:00"), (None, None)], "a string, b string")
    ms = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp() * 1000)
    assert [r.x for r in df.select(M.exif_date(F.col("a"), F.col("b"), F.col("b")).alias("x")).collect()] == [ms(2019, 8, 12, 10, 15), ms(2020, 1, 1), 0]
    files = spark.createDataFrame([("x/a.jpg",), ("x/b.jpg",), ("x/c.jpg",)], "uri string")
    meta = spark.createDataFrame([("x/a.jpg", " ", 5), ("x/b.jpg", "B", None)], "uri string, name string, size long")
    assert [tuple(r) for r in M.file_info(files, meta).orderBy("uri").collect()] == [("x/a.jpg", "a.jpg", 5, True), ("x/b.jpg", "B", -1, False), ("x/c.jpg", "c.jpg", -1, False)]
    path = spark.range(1).select(M.display_path(F.lit("content://p/tree/primary%3ADCIM%2FCamera")).alias("x")).first().x
    assert path == "Internal storage/DCIM/Camera"


def test_json_forms(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ([0.5], "u", 7), [3])], "id int, prompts array<string>, seed struct<embedding:array<double>,uri:string,timestamp_ms:bigint>, person_ids array<bigint>")
    assert M.collection_from_row(M.collection_to_row(df)).collect() == df.collect()
    assert M.collection_from_row(spark.createDataFrame([(1, "no", "{", None)], "id int, prompts string, seed string, person_ids string")).first().prompts is None


def test_progress(spark):
    events = spark.createDataFrame([("embedded", 0), ("embedded", 5), ("failed", 0), ("skipped", 0), ("waiting", 0)], "status string, frames int")
    assert tuple(M.scan_totals(events).first()) == (5, 4, 6, 2, 1)
    ticks = spark.createDataFrame([(1, 0, 0), (1, 100, 5), (1, 1100, 15), (1, 2100, 15)], "key int, ms long, n long")
    assert [r.rate for r in M.throughput(ticks).orderBy("ms").collect()] == [None, None, 10.0, None]
    left = spark.createDataFrame([(8000, 20, 60), (7999, 20, 60)], "a long, b long, c long").select(M.time_left(F.col("a"), F.col("b"), F.col("c")).alias("x"))
    assert [r.x for r in left.collect()] == [16000, None]
    photos = spark.createDataFrame([(1, 5), (2, 3), (3, 86_400_000)], "key long, ms long")
    assert [(r.n, r["keys"]) for r in M.consecutive_days(photos).orderBy("day").collect()] == [(2, [2, 1]), (1, [3])]
    assert M.top_per(photos.withColumn("g", F.lit(1)), "g", 2, F.desc("ms")).count() == 2
    ok = spark.range(1).select(*(M.good_when_relaxed(i, F.lit(40), F.lit(0.45), F.lit(0.7), F.lit(10)) for i in range(3))).first()
    assert tuple(ok) == (False, True, True)


def test_merged_groups(spark):
    rows = [(0, 1, 9, False, True, [1, 2], [1.0, 0.0]), (0, 2, 5, False, False, [3], [0.9, 0.1]), (0, 3, 4, False, True, [4], [1.0, 0.1]), (0, 4, 3, False, False, [2], [1.0, 0.0]), (0, 5, 1, False, False, [9], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "block long, id long, n long, pinned boolean, named boolean, media array<long>, centroid array<double>")
    assert {r.id: r.into for r in C.merge_groups(df, C.Thresholds()).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_locks_and_turns(spark):
    faces = spark.createDataFrame([(1, 5, False, 9), (2, 5, False, None)], "id long, person_id long, locked boolean, blocked long")
    assert [tuple(r) for r in U.lock_face(faces, 1, None).orderBy("id").collect()] == [(1, None, True, 9), (2, 5, False, None)]
    assert U.lock_face(faces, 1, 6, 7).where("id = 1").first()[1:] == (6, True, 7)
    people = spark.createDataFrame([(1, False), (2, True)], "id long, pinned boolean")
    assert [r.pinned for r in U.set_pinned(people, 1, True).orderBy("id").collect()] == [True, True]
    kinds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "kind string, place int")
    assert [R.next_choice(kinds, i).first().kind for i in (0, 1, 2)] == ["b", "c", "a"]
