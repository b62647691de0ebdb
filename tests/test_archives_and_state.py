"""Archives from chunks, walks of folders, state in versions, alignment and table functions."""

import os
import random
import shutil
import subprocess
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as E
from orrery.functions import table as T
from orrery.operators import archive as A
from orrery.sources.log_table import Changed
from orrery.sources.versions import Versions, once
from orrery.sources.walk import walk

FILES = "job long, part int, ord long, path string, modified_ms long, size long, content binary"


def test_crc_of_both():
    rng = random.Random(1)
    for n in (0, 1, 2, 255, 65_535, 200_000):
        a, b = rng.randbytes(rng.randint(0, 999)), rng.randbytes(n)
        assert A.crc_of_both(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize(("large", "size"), [(False, 50_000), (True, 65_535), (False, 131_070)])
def test_archives_read_back(spark, tmp_path, monkeypatch, large, size):
    if large:
        monkeypatch.setattr(A, "LARGE_FILES", 2)
    monkeypatch.setattr(A, "RUN", 4)
    rng = random.Random(7)
    sizes = [0, 1, 65_534, 65_535, 65_536, 131_070, 200_001, 3_000_000]
    files = [(1, i % 2, i, f"Beach/photo {i} ({s}) é.jpg", 1_700_000_000_000 + i * 86_400_000, s, rng.randbytes(s)) for i, s in enumerate(sizes)]
    files += [(1, 0, 20, "short.jpg", 0, 11, b"ten bytes!"), (1, 1, 21, "none.jpg", 0, 5, None), (2, 0, 0, "gone.jpg", 0, 5, None)]
    df = spark.createDataFrame(files, FILES)
    chunks = A.chunked(df, size).repartition(7)
    found = A.entries(df.drop("content"), chunks)
    assert {r.path: r.state for r in found.collect() if r.state != "whole"} == {"short.jpg": "truncated", "none.jpg": "unreadable", "gone.jpg": "unreadable"}
    assert all(r.crc == zlib.crc32(f[6]) for r in found.collect() for f in files if f[3] == r.path and f[6] is not None)
    for how in ("skip", "keep"):
        done = {(r.job, r.part): r for r in A.write_archives(found, chunks, lambda job, part, how=how: str(tmp_path / f"{how}-{job}-{part}.zip"), how).collect()}
        assert {k: r.skipped for k, r in done.items()} == {(1, 0): 1, (1, 1): 1, (2, 0): 1}
        for (job, part), r in done.items():
            path = tmp_path / f"{how}-{job}-{part}.zip"
            assert path.stat().st_size == r.n_bytes
            with zipfile.ZipFile(path) as archive:
                assert archive.testzip() is None
                want = [f for f in files if f[:2] == (job, part) and f[6] is not None and (how == "keep" or len(f[6]) == f[5])]
                assert [i.filename for i in archive.infolist()] == [f[3] for f in want] and len(want) == r.files
                assert all(archive.read(f[3]) == f[6] for f in want)
                assert all(i.date_time[:3] == (2023, 11, 14 + int(f[2])) for i, f in zip(archive.infolist(), want, strict=True) if f[4])
            if shutil.which("unzip") and r.files:
                subprocess.run(["unzip", "-tq", path], check=True, capture_output=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{how}-{k}.zip" for how in ("skip", "keep") for k in ("1-0", "1-1", "2-0"))


def test_chunks_of_files(spark, tmp_path):
    data = random.Random(3).randbytes(10_000)
    (tmp_path / "a").write_bytes(data)
    rows = [(0, 0, 0, (tmp_path / "a").as_uri(), 10_000), (0, 0, 1, (tmp_path / "b").as_uri(), 5), (0, 0, 2, (tmp_path / "a").as_uri(), 12_000)]
    found = A.read_chunks(spark.createDataFrame(rows, "job long, part int, ord long, uri string, size long"), 3000).collect()
    whole = {o: [r.data for r in sorted(found, key=lambda r: r.chunk) if r.ord == o] for o in range(3)}
    assert b"".join(whole[0]) == data and whole[1] == [None] and b"".join(whole[2]) == data and len(whole[2]) == 4


def test_walk(spark, tmp_path):
    at = tmp_path / "tree"
    for depth in range(5):
        at = at / f"d{depth}"
        (at / "side").mkdir(parents=True)
        (at / f"p{depth}.jpg").write_bytes(b"x" * depth)
        (at / "side" / f"q{depth}.PNG").write_bytes(b"y")
        (at / "note.txt").write_text("no")
    os.symlink(tmp_path / "tree", at / "back")  # a cycle
    os.symlink(tmp_path / "tree" / "d0" / "side", at / "twice")
    files, failed = walk(spark, str(tmp_path / "tree"), tasks=3)
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == sorted([f"p{d}.jpg" for d in range(5)] + [f"q{d}.PNG" for d in range(5)])
    assert failed.count() == 0 and {r["size"] for r in files.collect()} == {0, 1, 2, 3, 4}
    files, failed = walk(spark, str(tmp_path / "missing"), tasks=1)
    assert files.count() == 0 and [r.path for r in failed.collect()] == [str(tmp_path / "missing")]


def test_a_slot_sends_once(spark, tmp_path, monkeypatch):
    state, calls = Versions(spark, str(tmp_path / "state")), []
    one = lambda x: spark.createDataFrame([(x,)], "x int")

    def step(read):
        calls.append(read("history") is None)
        old = read("history")
        return {"history": one(1) if old is None else old.unionByName(one(old.count() + 1))}, one(len(calls))

    first = [r.x for r in once(state, "a", step).collect()]
    assert [r.x for r in once(state, "a", step).collect()] == first == [1] and calls == [True]
    assert [r.x for r in once(state, "b", step).collect()] == [2]
    assert sorted(r.x for r in state.table("history").collect()) == [1, 2] and state.current()[0] == 2

    def lost(read):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        once(state, "c", lost)
    monkeypatch.setattr(state.log, "publish", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        once(state, "c", step)  # all tables are written, but no version names them
    monkeypatch.undo()
    assert state.current()[0] == 2 and sorted(r.x for r in state.table("history").collect()) == [1, 2]
    assert [r.x for r in once(state, "c", step).collect()] == [4] and sorted(r.x for r in state.table("history").collect()) == [1, 2, 3]


def test_a_step_that_comes_second_begins_anew(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "state")) for _ in range(2))
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    runs = []

    def step(read):
        runs.append(1)
        if len(runs) == 1:
            once(b, "other", lambda read: ({"t": one(10)}, one(10)))
        old = read("t")
        return {"t": one(1) if old is None else old.unionByName(one(1))}, one(1)

    once(a, "mine", step)
    assert len(runs) == 2 and sorted(r.x for r in a.table("t").collect()) == [1, 10] and a.table("sent").count() == 2
    with pytest.raises(Changed):
        a.commit(1, {"t": one(5)})


def test_alignment_beside_least_squares(spark):
    rng = np.random.default_rng(5)
    points = [(rng.normal(size=10) * 40 + 90).tolist() for _ in range(20)] + [[7.0] * 10, [1.0, 2.0]]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, p array<double>").select("id", E.alignment(F.col("p"), 224).alias("m")).orderBy("id").collect()
    goal = np.array(E.TEMPLATE) * 2
    for r in rows[:20]:
        p = np.array(points[r.id]).reshape(5, 2)
        left = np.concatenate([np.c_[p[:, 0], -p[:, 1], np.ones(5), np.zeros(5)], np.c_[p[:, 1], p[:, 0], np.zeros(5), np.ones(5)]])
        want = np.linalg.lstsq(left, np.concatenate([goal[::2], goal[1::2]]), rcond=None)[0]
        assert np.allclose([r.m.a, r.m.b, r.m.tx, r.m.ty], want)
    assert (rows[20].m.a, rows[20].m.b) == (1.0, 0.0) and rows[21].m is None


def test_fields_of_a_log(spark):
    T.register(spark)
    spark.createDataFrame([("f", 2, "a", None, 5000), ("f", 1, "b", "v", 900), ("g", 1, "c", None, None)], "folder_id string, hash long, image_path string, video_uri string, timestamp_ms long").createOrReplaceTempView("some_log")
    found = spark.sql("SELECT * FROM log_fields(fields => 'uri,number,is_video,seconds', rows => TABLE(some_log))")
    assert found.columns == ["folder_id", "uri", "number", "is_video", "seconds"]
    assert sorted(map(tuple, found.collect())) == [("f", "a", 2, False, 5), ("f", "v", 1, True, 0), ("g", "c", 1, False, None)]
    with pytest.raises(Exception, match="doesn't know colour"):
        spark.sql("SELECT * FROM log_fields(TABLE(some_log), 'uri,colour')").collect()



def test_archives_are_listed_many_entries_at_once(tmp_path):
    import zipfile

    import pandas as pd

    from orrery.plans import log_queries as L

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        for k in range(2 * L.LISTED + 5):
            out.writestr(f"{k}.txt", b"x" * (k % 7))
    frames = list(L._listed(iter([pd.DataFrame({"job": [1], "part": [0], "place": [str(tmp_path / "a.zip")]})])))
    assert [len(f) for f in frames] == [L.LISTED, L.LISTED, 5]
    assert pd.concat(frames)["size"].tolist() == [k % 7 for k in range(2 * L.LISTED + 5)]
