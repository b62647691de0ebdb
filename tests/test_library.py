"""Grouping of faces, tables that change, options of then and now, names: small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import dates as D
from orrery.operators import cluster as C
from orrery.operators import export as X
from orrery.operators import library as B
from orrery.operators import memories as M
from orrery.operators import notices as N

DAY = 86_400_000
FACES = "block long, id long, media_key long, video long, rank double, good boolean, person_id long, blocked long, pinned boolean, named boolean, embedding array<double>"


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


def face(id_, media, vector, rank=1.0, good=True, person=None, blocked=None, video=None, pinned=False, named=False):
    return (0, id_, media, video, rank, good, person, blocked, pinned, named, unit(*vector))


def placed(spark, rows):
    return {r.id: r.person for r in C.place_faces(spark.createDataFrame(rows, FACES), C.Thresholds()).collect()}


def grouped(spark, rows, rejected=()):
    pairs = spark.createDataFrame([(0, *p) for p in rejected], "block long, a long, b long")
    return {r.id: r.person for r in C.regroup(spark.createDataFrame(rows, FACES), pairs, C.Thresholds()).collect()}


def test_a_face_joins_the_nearest_person_of_another_photo(spark):
    rows = [face(1, 10, (1, 0), person=7), face(2, 11, (0, 1), person=8), face(3, 12, (1, -0.2)), face(4, 10, (1, 0.1)), face(5, 13, (1, 0.1), blocked=7), face(6, 14, (-1, -1)), face(7, 15, (-1, 0.2), good=False)]
    # 4 is in a photo with 7, 5 is blocked: both may only join 8, which is too far, so they start people.
    assert placed(spark, rows) == {3: 7, 4: -4, 5: -4, 6: -6, 7: -6}


def test_weak_faces_start_nobody(spark):
    assert placed(spark, [face(1, 10, (1, 0), good=False), face(2, 11, (1, 0), good=False)]) == {1: None, 2: None}


def test_a_video_shapes_a_person_twice_at_most():
    groups = C.Groups(2, C.Thresholds())
    for i, angle in enumerate((0.0, 0.3, 0.6, 0.9)):
        assert groups.place(i + 1, 100 + i, np.array([np.cos(angle), np.sin(angle)]), True, 1.0, None, 5) == -1
    assert groups.count[-1] == 2 and groups.photos[-1] == {100, 101, 102, 103}


def test_faces_that_come_next_are_placed_as_one_after_another():
    rng, limits = np.random.default_rng(8), C.Thresholds.named("strict")
    faces = C.unit(rng.normal(size=(60, 24))[rng.integers(60, size=900)] + rng.normal(size=(900, 24)) * 0.8)
    faces[500:520] = faces[7]
    plain, ahead, want, found = C.Groups(24, limits), C.Groups(24, limits), [], []
    for start in range(0, 900, 100):
        some = faces[start : start + 100]
        for k, (e, may) in enumerate(zip(some, ahead.expect(some), strict=True), start):
            face = (k + 1, k // 2, e, k % 5 != 0, float(k % 11), None, None)
            want.append(plain.place(*face))
            found.append(ahead.place(*face, may))
    assert found == want and len(set(found)) > 60 and np.array_equal(plain.sums, ahead.sums)
    assert all(np.array_equal(ahead.looks_of(p), np.flatnonzero(ahead.owner[: ahead.looks] == p)) for p in ahead.count)


def test_like_people_are_those_of_all_pairs_also_after_merging():
    rng, limits = np.random.default_rng(9), C.Thresholds.named("strict")
    groups = C.Groups(24, limits)
    for k, e in enumerate(C.unit(rng.normal(size=(40, 24))[rng.integers(40, size=600)] + rng.normal(size=(600, 24)) * 1.1)):
        groups.place(k + 1, k, e, True, float(k % 11), None, None)
    order = sorted(groups.count, key=lambda p: (-groups.count[p], -p))
    clear = C.Clear(groups.clear, order, 24)

    def like(a: int, b: int) -> bool:
        own = lambda p: groups.centres[: groups.looks][groups.owner[: groups.looks] == p]
        near = (own(a) @ own(b).T).max()
        best = np.sort((np.stack([e for _, e in groups.clear[a]]) @ np.stack([e for _, e in groups.clear[b]]).T).ravel())[-3:]
        return near >= limits.merge or (near >= C.BEFORE_LINK and len(best) == 3 and best.mean() >= limits.link)

    both = lambda pairs: {(min(p), max(p)) for p in pairs}
    assert both(groups.alike([p for p in order if groups.count[p] > 1], clear, True)) >= both((a, b) for a in order for b in order if a < b and max(groups.count[a], groups.count[b]) > 1 and like(a, b))
    for keep, gone in zip(order[:12:2], order[1:12:2], strict=True):
        clear.absorb(keep, gone)
        groups._absorb(keep, gone)
        found, want = both(groups.alike([keep], clear)), both((keep, b) for b in groups.count if b != keep and like(keep, b))
        assert found == want and np.allclose(clear.faces[clear.rows[keep]], np.stack([e for _, e in groups.clear[keep]]))


def test_looks_are_bounded_and_the_most_alike_become_one():
    groups = C.Groups(16, C.Thresholds())
    for i in range(9):
        groups.learn(1, np.eye(16)[i], 1.0)
    groups.learn(2, np.eye(16)[15], 1.0)
    own = groups.owner[: groups.looks]
    assert (own == 1).sum() == C.MOST_LOOKS and (own == 2).sum() == 1 and groups.count == {1: 9, 2: 1} and np.isclose(groups.sums[: groups.looks][own == 1].sum(), 9)
    assert groups.nearest(np.eye(16)[15], 0.3, set()) == 2 and groups.nearest(np.eye(16)[15], 0.3, {2}) is None


def test_like_people_merge(spark):
    # Two people around one direction that were kept apart by a photo of both; a third one shares no photo.
    a = [face(1, 10, (1, 0, 0), 9.0, person=1, pinned=True, named=True), face(2, 11, (1, 0.1, 0), 8.0, person=1, pinned=True, named=True)]
    b = [face(3, 20, (1, 0.2, 0), 7.0, person=2), face(4, 21, (1, 0.25, 0), 6.0, person=2)]
    new = [face(5, 20, (1, 0.1, 0.1), 5.0), face(6, 30, (0, 0, 1), 4.0)]
    assert grouped(spark, a + b + new) == {5: 1, 6: -6}
    groups = C.Groups(3, C.Thresholds())
    for r in a + b:
        groups.learn(r[6], np.array(r[-1]), r[4])
        groups.join(r[6], r[2])
    assert groups.merged({1}, {1}, set()) == {2: 1} and groups.count == {1: 4}


@pytest.mark.parametrize(("rejected", "photo", "want"), [(set(), 20, {2: 1}), ({(1, 2)}, 20, {}), (set(), 10, {})])
def test_rejected_people_and_those_in_one_photo_stay_apart(rejected, photo, want):
    groups = C.Groups(2, C.Thresholds())
    for person, media, v in ((1, 10, (1, 0)), (1, 11, (1, 0)), (2, photo, (1, 0.1))):
        groups.learn(person, np.array(unit(*v)), 1.0)
        groups.join(person, media)
    assert groups.merged(set(), set(), rejected) == want


def test_options_differ_in_kind(spark):
    rows = [(i, i * 20 * DAY, s, k) for i, (s, k) in enumerate([(9, "crowd"), (8, "crowd"), (5, "solo"), (4, "duo"), (3, "group"), (2, "solo")])]
    pool = spark.createDataFrame(rows, "key long, ms long, score long, kind string").collect()
    assert [r.kind for r in M.options(pool, 3)] == ["solo", "duo", "group"] and [r.key for r in M.options(pool, 4)] == [0, 2, 3, 4]
    near = spark.createDataFrame([(i, i * DAY, 9 - i, "crowd") for i in range(5)], "key long, ms long, score long, kind string").collect()
    assert [r.key for r in M.options(near, 3)] == [0, 1, 3]


def test_what_is_shown_first_depends_on_the_seed(spark):
    rows = [(1, i, i * 40 * DAY, i * 4 // 3, float(i % 5), "solo") for i in range(30)]
    df = spark.createDataFrame(rows, "person_id long, key long, ms long, month int, score double, kind string")
    first = {tuple(r.key for r in M.then_and_now(df, seed=s).where("first").orderBy("side").collect()) for s in range(6)}
    assert len(first) > 1 and all(len(f) == 2 and f[0] != f[1] for f in first)


def test_numbered_names(spark):
    rows = [("f", "a.jpg", 1), ("f", "A.jpg", 2), ("f", "a (2).jpg", 3), ("f", "a.jpg", 4), ("f", "b", 5), ("f", "b", 6), ("g", "a.jpg", 7), ("f", ".x", 8), ("f", ".x", 9)]
    found = {r.ord: r.path for r in X.unique_names(spark.createDataFrame(rows, "folder string, name string, ord int")).collect()}
    assert found == {1: "f/a.jpg", 2: "f/A (2).jpg", 3: "f/a (2) (2).jpg", 4: "f/a (3).jpg", 5: "f/b", 6: "f/b (2)", 7: "g/a.jpg", 8: "f/.x", 9: "f/.x (2)"}


def test_zones_do_not_depend_on_the_session(spark):
    ms = 1_711_846_800_000  # 2024-03-31 01:00 UTC, when clocks in Berlin go from 2 to 3
    row = spark.range(1).select(F.lit(ms).alias("ms"))
    want = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            want.append(tuple(row.select(
                D.day_number(F.col("ms"), "Asia/Tokyo"), D.month_number(F.col("ms") + 20 * 3_600_000, "Asia/Tokyo"), D.label(F.col("ms"), "America/New_York"), D.delay_until(F.col("ms"), 9, 0, "Europe/Berlin"),
                D.day_range(F.lit(2024), F.lit(3), F.lit(31), 0, "Europe/Berlin")["end"] - D.day_range(F.lit(2024), F.lit(3), F.lit(31), 0, "Europe/Berlin")["start"], D.from_name(F.lit("a 2019-08-12"), "Asia/Tokyo"),
            ).first()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert want == [(19813, 2024 * 12 + 3, "March 30", 6 * 3_600_000, 23 * 3_600_000, 1_565_578_800_000)] * 3


def test_replaced_photos_take_defaults(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "hash long, uri string, complete boolean")
    faces = spark.createDataFrame([(5, 1)], "id long, media_key long")
    photos, faces = B.insert_photos(old, faces, spark.createDataFrame([(2, "c")], "hash long, uri string"), spark.createDataFrame([(2, 1), (2, 0)], "media_key long, place int"))
    assert sorted(map(tuple, photos.collect())) == [(1, "a", True), (2, "c", False)] and sorted(map(tuple, faces.collect())) == [(5, 1), (6, 2), (7, 2)]


def test_notices(spark):
    schema = "year int, years_ago int, total long, strength double, qualifies boolean, kind string, taken_ms long, names array<string>"
    rows = [(2020, 4, 50, 1.5, True, "exact", 1_588_550_400_000, ["A", "B"]), (2021, 3, 5, 1.5, True, "exact", 1_620_086_400_000, []), (2019, 5, 2, 0.5, True, "exact", 1_556_928_000_000, []), (2018, 6, 9, 9.0, False, "exact", 0, [])]
    found = {r.kind: r for r in N.day_notices(spark.createDataFrame(rows, schema), 0).collect()}
    assert set(found) == {"on_this_day", "same_day"} and found["on_this_day"].year == 2020 and found["on_this_day"].title == "A day to remember · 4 years ago"
    assert found["on_this_day"].body == "A and B · May 4, 2020 · 50 photos and videos" and found["same_day"].body == "Photos from 3 different years are waiting for you."
    one = N.day_notices(spark.createDataFrame([(2023, 1, 1, 1.0, True, "week", 1_683_158_400_000, ["A", "B", "C", "D"])], schema), 1).collect()
    assert [(r.kind, r.title, r.body) for r in one] == [("this_week", "This week · 1 year ago", "A, B and C · May 4, 2023")]
