"""Small literal inputs with known results."""

import datetime
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import dates as D
from orrery.functions import scalar as S
from orrery.operators import cluster as C
from orrery.operators import export as X
from orrery.operators import memories as M
from orrery.operators import state as U
from orrery.operators import text as Q
from orrery.operators import timeline as L
from orrery.operators import vector as V
from orrery.sources import vector_log as G

DAY, HOUR = 86_400_000, 3_600_000


def ms(*x):
    return int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp() * 1000)


def groups(spark, rows):
    return spark.createDataFrame([(1000 + i, t, p) for i, (t, p) in enumerate(rows)], "media_key long, ms long, people array<long>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_companions(spark):
    rows = [(100, [1, 2]), (200, [1, 2, 3]), (300, [1, 3]), (400, [1, 2]), (500, [4])]
    found = {r.person: (r.companion, r.n, r.first_ms, r.first_key) for r in L.companions(groups(spark, rows)).collect()}
    assert found[1] == (2, 3, 100, 1000) and found[3][:2] == (1, 2) and 4 not in found


def test_companion_tie_goes_to_the_earlier_first_photo(spark):
    found = L.companions(groups(spark, [(500, [1, 2]), (100, [1, 3]), (600, [1, 2]), (200, [1, 3])])).where("person = 1").first()
    assert (found.companion, found.first_ms, found.first_key) == (3, 100, 1001)


def test_large_groups_have_no_companions(spark):
    found = {r.person: (r.n, r.first_ms) for r in L.companions(groups(spark, [(100, list(range(1, 21))), (200, [1, 2])])).collect()}
    assert found == {1: (1, 200), 2: (1, 200)}


def test_crowds(spark):
    sizes = [(10, 4), (20, 6), (30, 3), (400, 5), (410, 5)]
    rows = [(d * DAY, list(range(n))) for d, n in sizes]
    assert [r.media_key for r in L.crowds(groups(spark, rows), per_year=1).orderBy("year").collect()] == [1001, 1003]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(10, [1, 2, 3]), (40, [1, 2, 3]), (900, [1, 2, 3, 4]), (905, [5, 6, 7])], [(1002, 860)]),
        ([(10, [1, 2, 3]), (400, [1, 2, 3]), (500, [1, 2, 3])], [(1001, 390)]),
        ([(10, [1, 2]), (200, [1, 2]), (500, [1, 2, 3])], []),
        ([(10, [1, 2, 3]), (900, [1, 2, 3]), (1000, [1, 2, 3])], [(1001, 890)]),
    ],
)
def test_reunions(spark, rows, want):
    found = L.spaced(L.reunion_candidates(groups(spark, [(d * DAY, p) for d, p in rows])))
    assert [(r.media_key, r.gap) for r in found.collect()] == want


def picks(spark, rows, per_month, burst):
    df = spark.createDataFrame([(int(t // (30 * DAY)), k, int(t), float(s)) for k, t, s in rows], "month int, key long, ms long, score double")
    return [r.key for r in L.month_picks(df, per_month, burst).orderBy("ms").collect()]


def test_month_picks(spark):
    rows = [(1, 2 * DAY, 10), (2, 5 * DAY, 30), (3, 9 * DAY, 20), (4, 12 * DAY, 5), (5, 31 * DAY, 7), (6, 40 * DAY, 9)]
    assert picks(spark, rows, 2, 120_000) == [2, 3, 5, 6]
    rows = [(1, 3 * DAY, 40), (2, 3 * DAY + 20_000, 39), (3, 3 * DAY + 90_000, 38), (4, 8 * DAY, 10)]
    assert picks(spark, rows, 3, 120_000) == [1, 4]


def test_month_picks_are_greedy(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(60 * DAY), r.randrange(20)) for k in range(300)]
    want = []
    for month in (0, 1):
        chosen = []
        for k, t, s in sorted((x for x in rows if x[1] // (30 * DAY) == month), key=lambda x: (-x[2], x[1], x[0])):
            if len(chosen) < 8 and all(abs(t - c[1]) >= 2 * DAY for c in chosen):
                chosen.append((k, t, s))
        want += sorted(chosen, key=lambda c: c[1])
    assert picks(spark, rows, 8, 2 * DAY) == [c[0] for c in want]


def day_picks(spark, rows, n):
    df = spark.createDataFrame([(0, k, int(t), float(s)) for k, t, s in rows], "group long, key long, ms long, score double")
    return [r.key for r in M.day_picks(df, n).orderBy("ms").collect()]


def test_day_picks(spark):
    assert day_picks(spark, [(1, HOUR, 50), (2, HOUR + 30_000, 90), (3, 3 * HOUR, 70), (4, 5 * HOUR, 10)], 3) == [2, 3, 4]
    assert day_picks(spark, [(i, i * 600_000, 0) for i in range(100)], 4) == [12, 37, 62, 87]
    assert len(day_picks(spark, [(i, i * 10_000, 0) for i in range(5)], 4)) == 1


def test_valid_dates(spark):
    now = ms(2024, 5, 1)
    got = [one(spark, D.valid(F.lit(x), F.lit(now))) for x in (now, now + HOUR, now + 3 * DAY, ms(1989, 12, 31), ms(1990, 1, 2), ms(2000, 1, 1, 5), ms(2000, 1, 3))]
    assert got == [True, True, False, False, True, False, True]


def test_picked_date(spark):
    now, good, reset = ms(2024, 5, 1), ms(2020, 3, 4), ms(2000, 1, 1)
    cases = [((good, 0, 0, 0, 0), 1), ((0, 0, 0, good, 0), 4), ((0, 0, 0, 0, 0), 0), ((reset, good, 0, 0, 0), 2)]
    for values, src in cases:
        assert one(spark, D.pick(*(F.lit(v).cast("long") for v in values), F.lit(now)))["src"] == src


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("IMG-20190812-WA0001.jpg", ms(2019, 8, 12, 12)), ("PXL_20210101_101500123.jpg", ms(2021, 1, 1, 12)), ("Screenshot_2020-03-05-10-11-12.png", ms(2020, 3, 5, 12)),
        ("VID_20181231_235959.mp4", ms(2018, 12, 31, 12)), ("photo_1234567890123.jpg", 0), ("12019081234.jpg", 0), ("IMG_20191332.jpg", 0), (None, 0), ("a_20190231.jpg", ms(2019, 3, 3, 12)),
    ],
)
def test_date_from_name(spark, name, want):
    assert one(spark, D.from_name(F.lit(name).cast("string"))) == want


def test_day_ranges(spark):
    find = lambda y, m, d, s, z="UTC": one(spark, D.day_range(F.lit(y), F.lit(m), F.lit(d), s, z))
    assert find(2023, 2, 29, 0) is None
    assert (find(2024, 2, 29, 0)["start"], find(2024, 2, 29, 0)["end"]) == (ms(2024, 2, 29), ms(2024, 3, 1))
    assert find(2023, 5, 10, 3)["end"] - find(2023, 5, 10, 3)["start"] == 7 * DAY
    assert find(2023, 5, 10, 0, "Asia/Kolkata")["start"] == ms(2023, 5, 9, 18, 30)


def test_names(spark):
    assert one(spark, D.is_screenshot(F.lit("my Screen-Recording.mp4"))) and not one(spark, D.is_screenshot(F.lit("scream.jpg")))
    assert not one(spark, D.is_image(F.lit("a.MP4?x"))) and one(spark, D.is_image(F.lit("a.jpeg")))
    assert one(spark, S.safe_name(F.lit(' ..a/b:c"..'), "file")) == "a_b_c_" and one(spark, S.safe_name(F.lit("..."), "file")) == "file"


def test_qualifies_and_milestones(spark):
    assert [one(spark, S.qualifies(F.lit(n), F.lit(b))) for n, b in ((1, 40), (6, 0), (1, 0))] == [True, True, False]
    assert [one(spark, S.milestone_reached(F.lit(n))) for n in (49, 180)] == [0, 100]
    assert [one(spark, S.milestone_crossed(F.lit(n), F.lit(a))) for n, a in ((180, 50), (180, 100), (1200, 250), (30, 0))] == [100, None, 1000, None]


def test_first_appearance(spark):
    real = lambda *days: one(spark, S.truly_first(F.array(*(F.lit(d * DAY) for d in days))))
    assert real(0, 3, 40, 400) and not real(0, 400, 410)


def test_trips(spark):
    rows = [(100, 3), (101, 12), (102, 20), (103, 9), (104, 2), (200, 60), (300, 8), (301, 7), (302, 6)]
    runs = M.trips(spark.createDataFrame(rows, "day long, n long"))
    assert [(r.first_day, r.last_day, r.total) for r in runs.collect()] == [(101, 103, 41)]
    assert M.trip_near(runs, 105, 3).count() == 1 and M.trip_near(runs, 120, 3).count() == 0


def test_rotation(spark):
    kinds = spark.createDataFrame([("day", "morning", 0), ("trip", "ordinary", 1), ("vault", "ordinary", 2), ("then_now", "ordinary", 3), ("week", "fallback", 4)], "kind string, role string, place int")
    choose = lambda k, h, slot="evening": getattr(M.rotation_choice(k, spark.createDataFrame(h, "kind string, day int"), 50, slot).first(), "kind", None)
    plain = kinds.where("kind in ('trip', 'vault', 'then_now')")
    assert choose(plain, [("trip", 43), ("then_now", 49)]) == "vault"
    assert choose(plain, [("trip", 43), ("vault", 40), ("then_now", 10), ("then_now", 49)]) == "vault"
    assert choose(kinds, [("trip", 43)], "morning") == "day" and choose(kinds, [("day", 50)], "morning") == "trip"
    assert choose(kinds.where("kind in ('day', 'week')"), [("trip", 1)]) == "day" and choose(kinds.where("kind = 'week'"), [("trip", 1)]) == "week"


def test_history_texts(spark):
    df = spark.createDataFrame([(1, "trip:10"), (2, "nonsense,x:1,trip:y"), (3, "vault:3:evening")], "id int, state string")
    assert [tuple(r) for r in M.decode_history(df).orderBy("id").collect()] == [(1, "trip", 10, ""), (2, "x", 1, ""), (3, "vault", 3, "evening")]


def test_then_and_now(spark):
    rows = [(1, k, ms(y, m, d), y * 12 + m - 1, float(s)) for k, (y, m, d, s) in enumerate([(2016, 1, 1, 5), (2016, 1, 20, 9), (2016, 2, 20, 8), (2016, 2, 21, 7), (2024, 1, 1, 5), (2024, 2, 1, 6), (2024, 2, 20, 7), (2024, 2, 21, 1), (2001, 1, 1, 300)])]
    found = M.then_and_now(spark.createDataFrame(rows, "person_id long, key long, ms long, month int, score double"))
    sides = {s: {r.key for r in found.where(F.col("side") == s).collect()} for s in ("then", "now")}
    assert sides == {"then": {0, 1, 2}, "now": {4, 5, 6}}
    assert M.then_and_now(spark.createDataFrame(rows[:3], "person_id long, key long, ms long, month int, score double")).count() == 0


def test_hashes(spark):
    def want(size, modified, name):
        h = 1125899906842597
        for x in (size, modified, *np.frombuffer(name.encode("utf-16-le"), "<u2").tolist()):
            h = (31 * h + x) % 2**64
        return h - 2**64 if h >= 2**63 else h

    df = spark.createDataFrame([(123456789, 1_700_000_000_000, "IMG_é😀.jpg")], "s long, m long, n string")
    assert df.select(S.identity_hash("s", "m", "n")).first()[0] == want(123456789, 1_700_000_000_000, "IMG_é😀.jpg")
    got = (2**62 * 1_000_003 ^ 5 * 0x2545F4914F6CDD1D ^ 0x5851F42D4C957F2D) % 2**64
    assert spark.range(1).select(S.frame_hash(F.lit(2**62), F.lit(5).cast("long"))).first()[0] == (got - 2**64 if got >= 2**63 else got)


def test_scalars(spark):
    assert one(spark, S.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2).cast("long"))) == (lambda s: [1, 2, 3][s:] + [1, 2, 3][:s])(2 * 2654435761 % 3)
    assert one(spark, S.frame_times(F.lit(9000))) == [1500, 4500, 7500]
    assert [one(spark, S.joined_names(F.array(*map(F.lit, x)))) for x in (["A"], ["A", "B"], ["A", "B", "C"])] == ["A", "A and B", "A, B and C"]
    assert [one(spark, S.span_words(F.lit(n))) for n in (1, 14, 65)] == ["1 month", "1 year 2 months", "5 years"]
    a, b = (F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(x, "ltrb", strict=True))) for x in ((0, 0, 2, 2), (1, 1, 3, 3)))
    assert one(spark, S.iou(a, b)) == pytest.approx(1 / 7)
    assert one(spark, S.face_yaw(F.array(*(F.lit(float(x)) for x in (0, 0, 4, 0, 3, 1, 0, 0, 0, 0))))) == 0.25


def test_vector_functions(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.dot(v, v)) == 25 and one(spark, V.normalised(v)) == [0.6, 0.8] and one(spark, V.normalised(F.array(F.lit(0.0)))) == [0.0]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "@Anna Lee and Bo at the beach"), (2, "annabel"), (3, "Sam")], "id long, text string")
    people = spark.createDataFrame([(1, "Anna Lee"), (2, "bo"), (3, "Sam"), (4, "Sam"), (5, None), (6, "Anna")], "id long, name string")
    assert sorted((r.id, r.person, r.at) for r in Q.mentions(texts, people).collect()) == [(1, 1, 1), (1, 2, 14), (1, 6, 1)]
    assert Q.query_without_mentions("@Anna Lee and Bo at the  beach", [(1, 9), (14, 16)]) == "at the beach"


def test_clip_tokens(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    df = spark.createDataFrame([(1, "A  photo of\ta cat"), (2, "word " * 100), (3, None)], "id long, text string")
    found = {r.id: r.tokens for r in Q.clip_tokens(df, open(path).read()).collect()}
    ids = Tokenizer.from_file(path).encode("a photo of a cat", add_special_tokens=False).ids
    assert found[1][: len(ids) + 2] == [49406, *ids, 49407] and set(found[1][len(ids) + 2 :]) == {0}
    assert all(len(x) == 77 for x in found.values()) and 49407 not in found[2] and found[3][:3] == [49406, 49407, 0]


def test_states(spark):
    people = spark.createDataFrame([(1, "A", False, False), (2, None, False, True)], "id long, name string, hidden boolean, pinned boolean")
    assert [tuple(r) for r in U.rename(people, 2, "  ").collect()] == [(1, "A", False, False), (2, None, False, True)]
    assert U.set_hidden(people, 1, True).where("id = 1 and hidden and pinned").count() == 1
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, U.upsert(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "c", None), (3, "d", None)]
    assert U.insert_missing(old, new, ["k"]).count() == 3
    faces = spark.createDataFrame([(1, 5, False), (2, None, False), (3, 5, True)], "id long, person_id long, locked boolean")
    entry = spark.createDataFrame([(1, [1, 2, 3])], "id long, face_ids array<long>")
    assert sorted((r.id, r.person_id) for r in U.restore_faces(faces, entry, 9).collect()) == [(1, 9), (2, None), (3, 5)]


def test_parts_and_names(spark):
    entries = spark.createDataFrame([(1, i, c) for i, c in enumerate([400, 500, 200, 900, 50])], "job long, ord long, cost long")
    assert [r.part for r in X.parts(entries, 1000 + X.RESERVE).orderBy("ord").collect()] == [0, 0, 1, 2, 2]
    assert {r.part for r in X.parts(entries, 0).collect()} == {0}
    names = spark.createDataFrame([("f", "a.jpg", 1), ("f", "A.jpg", 2), ("f", "a (2).jpg", 3), ("g", "a.jpg", 4)], "folder string, name string, ord int")
    assert [r.path for r in X.unique_names(names).orderBy("ord").collect()] == ["f/a.jpg", "f/A (2).jpg", "f/a (2) (2).jpg", "g/a.jpg"]


def test_manifest_and_archives(spark, tmp_path):
    rows = [(1, 0, "Trip", "album", "Trip/Images/a.jpg", "a.jpg", False, ms(2020, 1, 2, 3, 4, 5), 0, 5, 1), (1, 1, "Trip", "album", "Trip/Videos/b.mp4", "b.mp4", True, 0, 0, 7, 2)]
    df = spark.createDataFrame(rows, "job long, part int, album string, kind string, path string, name string, is_video boolean, taken_ms long, modified_ms long, size long, ord int")
    first = json.loads(X.manifest(df).orderBy("part").first().manifest)
    assert first["parts"] == 2 and first["albums"][0]["files"] == [{"path": "Trip/Images/a.jpg", "name": "a.jpg", "type": "image", "dateTaken": "2020-01-02T03:04:05Z", "modified": None, "size": 5}]
    sizes = [0, 1, 65534, 65535, 65536, 131070, 200001, 3000000]
    files = spark.createDataFrame([(1, i % 2, f"{i}.bin", bytearray(bytes([i]) * n)) for i, n in enumerate(sizes)] + [(1, 0, "gone", None)], "job long, part int, path string, content binary")
    done = {r.part: r for r in X.write_parts(files, lambda job, part: f"{tmp_path}/{job}-{part}.zip").collect()}
    assert done[0].skipped == 1 and done[0].files == 4
    with zipfile.ZipFile(tmp_path / "1-1.zip") as z:
        assert z.testzip() is None and {i.file_size for i in z.infolist()} == set(sizes[1::2])


def test_vector_log(spark, tmp_path):
    rows = [("content://é/1", "f1", -5, None, 0, [1.0, 2.0]), ("b", "f1", 7, "v", 1500, [3.0, 4.0]), ("c", "", 8, "v", 2500, [5.0, 6.0])]
    data = G.head(2) + b"".join(G.record(*r) for r in rows)
    (tmp_path / "log.bin").write_bytes(data)
    found = G.read_log(spark, str(tmp_path / "log.bin")).orderBy("ord").collect()
    assert [(r.image_path, r.folder_id, r.hash, r.video_uri, r.timestamp_ms, r.embedding) for r in found] == rows
    ends = [r.next_offset for r in found]
    assert [r[0] for r in G.records(data[:-5], 12, 2, False)] == ends[:2]
    assert [r[0] for r in G.records(data, ends[0], 2)] == ends[1:]
    # A length that can't be one ends the log; what comes before it is kept.
    assert list(G.records(data[:12] + b"\xff\xff\xff\xff" + data[16:], 12, 2)) == []
    bad = data[: ends[1]] + b"\x7f\xff\xff\xff" + data[ends[1] + 4 :]
    assert [r[0] for r in G.records(bad, 12, 2)] == ends[:2]
    # Any size of range gives the same rows, and an offset skips what is before it.
    for most in (1, 7, 40, 1000):
        assert [(r.image_path, r.next_offset) for r in G.read_log(spark, str(tmp_path / "log.bin"), most=most).orderBy("next_offset").collect()] == [(r[0], e) for r, e in zip(rows, ends, strict=True)]
    assert [r.image_path for r in G.read_log(spark, str(tmp_path / "log.bin"), offset=ends[0], vectors=False, most=30).orderBy("ord").collect()] == ["b", "c"]
    (tmp_path / "bad.bin").write_bytes(b"nothing here")
    assert G.bad_logs(spark, str(tmp_path)).count() == 1 and G.read_log(spark, str(tmp_path)).count() == 3


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


def test_clusters(spark):
    rows = [(0, 1, 10, 9.0, True, unit(1, 0)), (0, 2, 11, 8.0, True, unit(0.9, 0.1)), (0, 3, 10, 7.0, True, unit(1, 0.05)), (0, 4, 12, 6.0, False, unit(-1, 0)), (0, 5, 13, 1.0, False, unit(0, 1))]
    df = spark.createDataFrame(rows, "block long, id long, media_key long, rank double, good boolean, embedding array<double>")
    found = {r.id: r.leader for r in C.leader_clusters(df, C.Thresholds.named("strict")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: None, 5: None}
    people = spark.createDataFrame([(1, i, 10.0 - i, i < 8, unit(1, 0.01 * i) if i % 2 else unit(0.01 * i, 1)) for i in range(9)], "person_id long, id long, rank double, good boolean, embedding array<double>")
    found = {r.id: r.second for r in C.two_groups(people).collect()}
    assert {i for i, s in found.items() if s} == {1, 3, 5, 7} and len(found) == 9


def test_tracks_and_suppression(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 9.0), (1, 2, 0, 5.0, 0.0, 1.0, 8.0), (1, 3, 1, 5.2, 0.0, 1.0, 7.0), (1, 4, 1, 0.3, 0.0, 1.0, 6.0), (1, 5, 2, 0.4, 0.0, 3.0, 5.0), (1, 6, 2, 5.3, 0.0, 1.2, 5.0)]
    df = spark.createDataFrame(rows, "video long, id long, frame int, cx double, cy double, size double, rank double")
    found = C.tracks(df)
    assert {r.id: r.track for r in found.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 2, 6: 1}
    roles = C.recognition_picks(found.join(df, ["video", "id"])).where("track = 1").orderBy("id").collect()
    assert [(r.id, r.role) for r in roles] == [(2, "best"), (3, "extra"), (6, "second")]
    boxes = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 2, 0.8, 0.1, 0.0, 2.0, 2.0), (1, 3, 0.7, 5.0, 5.0, 6.0, 6.0)], "media_key long, id long, score double, l double, t double, r double, b double")
    assert {r.id for r in C.suppressed(boxes).collect()} == {1, 3}


def test_mutual_match(spark):
    a = spark.createDataFrame([(1, i, unit(1, 0.1 * i)) for i in range(3)] + [(2, 0, unit(1, 0))], "pair long, id long, embedding array<double>")
    found = C.mutual_match(a, a).collect()
    assert [r.pair for r in found] == [1] and found[0].score == pytest.approx(1.0)


def test_rate():
    assert L.rate(iter([(0, 0), (1000, 5), (2000, 10), (4000, 30)])) == pytest.approx(0.6 * 5 + 0.4 * 10)
    assert L.rate(iter([(0, 0)])) is None


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "media_key long, ms long, people array<long>")
    assert L.companions(none).count() == L.crowds(none).count() == L.spaced(L.reunion_candidates(none)).count() == 0
    assert pd.isna(L.axis_start(spark.createDataFrame([], "person_id long, month int, n long")).first().month)
