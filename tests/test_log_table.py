"""The vector log as a source and a sink: pieces, commits, generations and following."""

import threading

import pytest
from pyspark.sql import functions as F

from orrery.sources import log_table as G
from orrery.sources import vector_log as V
from orrery.streaming import ingest as I

ROWS = "image_path string, folder_id string, hash long, video_uri string, timestamp_ms long, embedding array<float>"


def rows(a, b, dim=4):
    return [(f"p{i}é", f"f{i % 3}", i, f"v{i // 4}" if i % 4 == 0 else None, i * 10, [float(i), 0.5, -1.0, 2.0][:dim]) for i in range(a, b)]


def names(df):
    return sorted(r.image_path for r in df.collect())


def test_write_and_read_in_pieces(spark, tmp_path):
    path = (tmp_path / "log").as_uri()
    G.append(spark.createDataFrame(rows(0, 40), ROWS).repartition(3), path, 4, cut=100)
    G.append(spark.createDataFrame(rows(40, 50), ROWS).coalesce(1), path, 4)
    found = G.read_table(spark, path)
    assert sorted((r.image_path, r.folder_id, r.hash, r.video_uri, r.timestamp_ms, list(r.embedding)) for r in found.collect()) == sorted(rows(0, 50))
    log = G.Log(path)
    assert log.current()["version"] == 2 and log.current()["generation"] == 0
    # Cuts that the writer kept are those that are found by lengths.
    file = log.current()["files"][0]
    pieces = log.pieces(file)
    assert len(pieces) >= 3 and pieces[0][0] == 12 and pieces[-1][1] == file["bytes"] and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    assert G.Log(path, 100).pieces({**file, "cuts": None}) == pieces
    bare = G.read_table(spark, path, vectors=False)
    assert bare.where("embedding is not null").count() == 0 and bare.count() == 50
    one = G.read_table(spark, path).where("folder_id = 'f1' and hash > 10")
    assert names(one) == sorted(r[0] for r in rows(0, 50) if r[1] == "f1" and r[2] > 10)
    assert "folder_id" in one._jdf.queryExecution().executedPlan().toString()


def test_one_raw_file_over_many_tasks(spark, tmp_path):
    file = tmp_path / "log.bin"
    data = V.head(4) + b"".join(V.record(*r) for r in rows(0, 60))
    half = V.record(*rows(60, 61)[0])
    file.write_bytes(data + half[:-3])
    found = G.read_table(spark, file.as_uri(), cut=100)
    assert found.rdd.getNumPartitions() >= 10 and names(found) == sorted(r[0] for r in rows(0, 60))
    assert found.orderBy("start").first().start == 12 and found.agg(F.max("next_offset")).first()[0] == len(data)
    file.write_bytes(data + half)
    assert G.read_table(spark, file.as_uri(), cut=100).count() == 61
    with pytest.raises(ValueError):
        G.Log(file.as_uri()).pieces({"name": str(file), "bytes": None, "cuts": None}, first=15)


def test_a_failed_write_leaves_the_log(spark, tmp_path):
    path = (tmp_path / "log").as_uri()
    G.append(spark.createDataFrame(rows(0, 5), ROWS), path, 4)
    bad = spark.createDataFrame([*rows(5, 30), *rows(30, 31, dim=3)], ROWS).repartition(4)
    with pytest.raises(Exception, match="vector of 3"):
        G.append(bad, path, 4)
    assert names(G.read_table(spark, path)) == sorted(r[0] for r in rows(0, 5)) and G.Log(path).current()["version"] == 1


def test_rewrites_raise_the_generation(spark, tmp_path):
    path = (tmp_path / "log").as_uri()
    G.append(spark.createDataFrame(rows(0, 12), ROWS), path, 4)
    G.delete_folder(spark, path, "f1", 4)
    assert names(G.read_table(spark, path)) == sorted(r[0] for r in rows(0, 12) if r[1] != "f1")
    assert G.Log(path).current()["generation"] == 1
    survivors = G.read_table(spark, path).where("folder_id <> 'f0'")
    G.append(spark.createDataFrame(rows(20, 22), ROWS), path, 4)
    with pytest.raises(Exception, match="has version 3, not 2"):
        G.rewrite(survivors, path, 4, 2)  # begun before the last write: nothing is lost
    assert len(names(G.read_table(spark, path))) == 10
    G.clear(path)
    assert G.read_table(spark, path).count() == 0 and G.Log(path).current()["generation"] == 2


def test_writers_at_once_lose_nothing(tmp_path):
    path = (tmp_path / "log").as_uri()
    writers = [G.LogWriter({"path": path, "dim": "4"}, type("S", (), {"names": list(G.WRITTEN)}), False) for _ in range(8)]
    threads = [threading.Thread(target=lambda w=w, i=i: w.commit([w.write(iter(rows(10 * i, 10 * i + 10)))])) for i, w in enumerate(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    now = G.Log(path).current()
    assert now["version"] == 8 and len(now["files"]) == 8


def follow(spark, tmp_path, path, catalog):
    state = catalog.get("state", {})
    seen = []

    def put(batch, number):
        batch = batch.cache()
        seen.append(batch.where("image_path is not null").count())
        table, new = G.synced(catalog.get("table"), catalog.get("state", state), batch)
        catalog["table"], catalog["state"] = spark.createDataFrame(table.collect(), table.schema), new

    I.ingest(G.follow_log(spark, path), str(tmp_path / "out"), str(tmp_path / "check"), after=put).awaitTermination()
    return seen


def test_following_a_folder(spark, tmp_path):
    path, catalog = (tmp_path / "log").as_uri(), {}
    G.append(spark.createDataFrame(rows(0, 10), ROWS), path, 4)
    assert sum(follow(spark, tmp_path, path, catalog)) == 10
    catalog["table"] = catalog["table"].withColumn("src", F.when(F.col("key") < 5, 2).otherwise(F.col("src"))).withColumn("taken_ms", F.when(F.col("key") < 5, 77).otherwise(0).cast("long"))
    G.append(spark.createDataFrame(rows(8, 14), ROWS), path, 4)
    assert sum(follow(spark, tmp_path, path, catalog)) == 6  # only what is new
    assert {r.key: r.src for r in catalog["table"].collect()} == {i: 2 if i < 5 else -1 for i in range(14)}
    G.delete_folder(spark, path, "f1", 4)
    G.append(spark.createDataFrame(rows(20, 21), ROWS), path, 4)
    follow(spark, tmp_path, path, catalog)
    left = [i for i in range(14) if i % 3 != 1] + [20]
    assert {r.key: (r.src, r.taken_ms) for r in catalog["table"].collect()} == {i: (2, 77) if i < 5 else (-1, 0) for i in left} and catalog["state"] == {"generation": 1}
    G.clear(path)
    follow(spark, tmp_path, path, catalog)
    assert catalog["table"].count() == 0
    assert follow(spark, tmp_path, path, catalog) in ([], [0])


def test_following_one_file(spark, tmp_path):
    file, catalog = tmp_path / "log.bin", {}
    parts = [V.record(*r) for r in rows(0, 9)]
    file.write_bytes(V.head(4) + b"".join(parts[:4]) + parts[4][:20])
    assert sum(follow(spark, tmp_path, file.as_uri(), catalog)) == 4
    file.write_bytes(V.head(4) + b"".join(parts[:7]))
    assert sum(follow(spark, tmp_path, file.as_uri(), catalog)) == 3
    file.write_bytes(V.head(4) + b"".join(parts[5:]))
    (tmp_path / "log.bin.generation").write_text("1")
    assert sum(follow(spark, tmp_path, file.as_uri(), catalog)) == 4
    assert {r.key for r in catalog["table"].collect()} == {5, 6, 7, 8}
