"""Queries over the vector log as a table, streams with state, and people across blocks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as E
from orrery.functions import table as T
from orrery.operators import archive as A
from orrery.operators import cluster as C
from orrery.operators import export as X
from orrery.operators import memories as R
from orrery.operators import text as W
from orrery.operators import merge as M
from orrery.operators import vector as V
from orrery.plans.queries import query, r6
from orrery.shared import scratch, written
from orrery.sources import log_table as G
from orrery.sources.versions import Versions, once
from orrery.sources.views import Library
from orrery.sources.walk import walk
from orrery.streaming import batches as B
from orrery.streaming import ingest as I
from orrery.streaming import people as P


def _records(x: Library) -> DataFrame:
    """The index as rows of a log."""
    key = F.col("media_key")
    return x.index().select(F.concat(F.lit("p"), key).alias("image_path"), F.col("folder_id").cast("string").alias("folder_id"), key.cast("long").alias("hash"), F.when(F.col("is_video"), F.concat(F.lit("v"), key)).alias("video_uri"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"), "embedding")


def _dim(x: Library) -> int:
    first = x.index().select(F.size("embedding").alias("n")).first()
    return first["n"] if first else 1


def _log(x: Library) -> str:
    path = scratch(x.spark)
    G.append(_records(x), path, _dim(x))
    return path


_LOG = "SELECT media_key AS hash, 'p' || media_key AS image_path, folder_id::VARCHAR AS folder_id, CASE WHEN is_video THEN 'v' || media_key END AS video_uri, timestamp_ms::BIGINT AS timestamp_ms"


@query(f"{_LOG}, embedding[1]::DOUBLE AS first_x, embedding[len(embedding)]::DOUBLE AS last_x FROM idx")
def log_rows(x: Library) -> DataFrame:
    ends = (F.element_at("embedding", i).cast("double").alias(n) for i, n in ((1, "first_x"), (-1, "last_x")))
    return G.read_table(x.spark, _log(x)).select("hash", "image_path", "folder_id", "video_uri", "timestamp_ms", *ends)


@query(f"{_LOG} FROM idx WHERE folder_id = 2")
def log_folder(x: Library) -> DataFrame:
    """Without vectors; the folder is looked for in the source."""
    found = G.read_table(x.spark, _log(x), vectors=False).where("folder_id = '2'")
    return found.select("hash", "image_path", "folder_id", "video_uri", "timestamp_ms")


@query(f"SELECT *, 1::BIGINT AS generation FROM ({_LOG} FROM idx) WHERE folder_id <> '1'")
def log_after_delete(x: Library) -> DataFrame:
    path = _log(x)
    G.delete_folder(x.spark, path, "1", _dim(x))
    return G.read_table(x.spark, path, vectors=False).select("hash", "image_path", "folder_id", "video_uri", "timestamp_ms", "generation")


@query("""SELECT media_key AS key, coalesce(min(CASE WHEN is_video THEN 'v' || media_key END), min('p' || media_key)) AS uri, bool_or(is_video) AS is_video, CASE WHEN min(first) % 5 < 2 THEN 77 ELSE 0 END::BIGINT AS taken_ms, CASE WHEN min(first) % 5 < 2 THEN 2 ELSE -1 END AS src
FROM (SELECT *, min(ord) OVER (PARTITION BY media_key) AS first FROM idx) WHERE folder_id <> 1 GROUP BY media_key""")
def log_followed(x: Library) -> DataFrame:
    """A catalog that follows a log: part of it, the rest, then the dates of some, then all again without a folder."""
    rows, path, dim, to = _records(x), scratch(x.spark), _dim(x), scratch(x.spark)
    kept: dict = {"table": None, "state": {}}

    def put(batch: DataFrame, number: int) -> None:
        table, kept["state"] = G.synced(kept["table"], kept["state"], batch)
        kept["table"] = written(table)

    def follow() -> None:
        I.ingest(G.follow_log(x.spark, path), f"{to}/rows", f"{to}/state", after=put).awaitTermination()

    for part in (0, 1):
        G.append(rows.where(F.col("hash") % 2 == part), path, dim)
        follow()
    first = x.index().groupBy(F.col("media_key").alias("key")).agg((F.min("ord") % 5 < 2).alias("dated"))
    dated = kept["table"].join(first, "key").withColumn("taken_ms", F.when(F.col("dated"), 77).otherwise(0).cast("long")).withColumn("src", F.when(F.col("dated"), 2).otherwise(-1))
    kept["table"] = written(dated.drop("dated"))
    G.delete_folder(x.spark, path, "1", dim)
    follow()
    return kept["table"].select("key", "uri", "is_video", "taken_ms", "src")


# ---- streams of several batches


@query("SELECT user_id % 4 AS key, n // 60 AS number, list(event_id ORDER BY n) AS items, 'count' AS cause FROM (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY user_id % 4) AS c FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY epoch_us(ts::TIMESTAMP) // 1000, event_id)) WHERE (n // 60 + 1) * 60 <= c GROUP BY 1, 2")
def stream_batches(x: Library) -> DataFrame:
    """Events as they fall due by count; a table has no clock, so what waits at the end isn't due."""
    events = x.sightings().select((F.col("person") % 4).alias("key"), "ts_ms", F.col("event_id").alias("item"))
    return I.drained(B.due_batches(I.in_parts(events, "ts_ms"), ms=None))


#: Tasks for each core that make pairs of what met.
PAIR_TASKS = 8


@query("SELECT a.kind AS video, a.ts_ms, a.person, b.person AS other, b.ts_ms AS other_ms FROM sightings a JOIN sightings b ON a.kind = b.kind AND a.person <> b.person AND b.ts_ms - a.ts_ms BETWEEN 0 AND 600000")
def stream_pairs(x: Library) -> DataFrame:
    rows = x.sightings().select(F.col("kind").alias("video"), F.timestamp_millis("ts_ms").alias("ts"), "person")
    parts = I.split(rows, "ts")
    met = I.drained(B.meetings_stream(I.follow_parts(x.spark, parts, rows), I.follow_parts(x.spark, parts, rows), 600_000))
    # Few rows become many pairs, which are not written: each task has its share of them.
    found = B.met(met.repartition(PAIR_TASKS * x.spark.sparkContext.defaultParallelism))
    return found.select("video", F.unix_millis("ts").alias("ts_ms"), "person", "other", F.unix_millis("other_ts").alias("other_ms"))


def _faces(x: Library) -> DataFrame:
    """Vectors as faces, two to a photo."""
    none = F.lit(None).cast("long")
    return x.index().select(
        F.col("ord").alias("id"), F.floor(F.col("ord") / 2).alias("media_key"), none.alias("video"), (F.col("ord") * 7 % 11).cast("double").alias("rank"), (F.col("ord") % 5 != 0).alias("good"), none.alias("person_id"), none.alias("blocked"),
        F.col("embedding").cast("array<double>").alias("embedding"), (F.floor(F.col("ord") / 2) % 2).alias("block"),
    )


@query()
def stream_people(x: Library) -> DataFrame:
    """Faces of two blocks in five batches, like people merged as photos come."""
    return P.final_people(I.drained(P.people_stream(I.in_parts(_faces(x), "media_key"), C.Thresholds())))


# ---- people across blocks


@query()
def people_merged(x: Library) -> DataFrame:
    """Faces placed in two blocks, then like people of both merged."""
    faces, limits = _faces(x), C.Thresholds()
    placed = written(C.place_faces(faces, limits)).where("person is not null").select("id", "person")
    people = x.spark.createDataFrame([], "person long, pinned boolean, named boolean")
    return M.regroup_all(faces, placed, people, x.spark.createDataFrame([], "a long, b long"), limits)


#: Normalised sums of normalised vectors for each folder: c (folder_id, v).
CENTROIDS = """c AS (SELECT folder_id, list(x / sqrt(q) ORDER BY k) AS v FROM (SELECT folder_id, k, sum(x) AS x, sum(sum(x) ^ 2) OVER (PARTITION BY folder_id) AS q
  FROM (SELECT folder_id, k, embedding[k]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM idx, generate_series(1, (SELECT max(len(embedding)) FROM idx)) AS g(k)) GROUP BY folder_id, k) GROUP BY folder_id)"""


@query(f""", {CENTROIDS}, face AS (SELECT ord AS id, ord // 6 AS frame, row_number() OVER (PARTITION BY ord // 6 ORDER BY ord * 7 % 5 DESC, ord) AS place, embedding FROM idx),
cand AS (SELECT id, folder_id AS person, list_inner_product(embedding::DOUBLE[], v) AS s FROM face, c WHERE list_inner_product(embedding::DOUBLE[], v) >= 0.1), walk AS (
  SELECT DISTINCT frame, 0::BIGINT AS place, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::BIGINT AS person, NULL::DOUBLE AS score FROM face
  UNION ALL
  SELECT frame, place + 1, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best[2]) END, id, best[2], -best[1] FROM (
    SELECT w.frame, w.place, w.taken, f.id, min(CASE WHEN d.person IS NOT NULL AND NOT list_contains(w.taken, d.person) THEN (-d.s, d.person::BIGINT) END) AS best
    FROM walk w JOIN face f ON f.frame = w.frame AND f.place = w.place + 1 LEFT JOIN cand d ON d.id = f.id GROUP BY 1, 2, 3, 4)
) SELECT frame, id, person, round(score, 6) AS score FROM walk WHERE person IS NOT NULL""")
def frame_names(x: Library) -> DataFrame:
    """Six faces a frame, of which several are nearest to one person; each person is named once a frame."""
    looks = V.centroid(x.index(), "folder_id").select(F.col("folder_id").cast("long").alias("person"), F.col("centroid").alias("embedding"))
    faces = x.index().select(F.floor(F.col("ord") / 6).alias("frame"), F.col("ord").alias("id"), (F.col("ord") * 7 % 5).alias("rank"), "embedding")
    return M.name_frames(faces, looks, 0.1).select("frame", "id", "person", r6("score"))


# ---- archives, folders, state and functions of callers


#: Entries of archives that are listed at once.
LISTED = 1024


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What an ordinary reader finds in archives: job, part, path, size, md5; LISTED entries at a time."""
    import hashlib
    import zipfile

    found: list[tuple] = []
    names = ["job", "part", "path", "size", "md5"]
    for pdf in frames:
        for job, part, name in zip(pdf.job.tolist(), pdf.part.tolist(), pdf.place.tolist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                for info in archive.infolist():
                    digest, size = hashlib.md5(), 0
                    with archive.open(info) as entry:
                        while data := entry.read(1 << 20):
                            digest.update(data)
                            size += len(data)
                    found.append((job, part, info.filename, size, digest.hexdigest()))
                    if len(found) == LISTED:
                        yield pd.DataFrame(found, columns=names)
                        found = []
    yield pd.DataFrame(found, columns=names)


@query("SELECT doc_id % 3 AS job, lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, md5(text) AS md5 FROM documents WHERE doc_id % 10 <> 9")
def archived_texts(x: Library) -> DataFrame:
    """Texts as files of exports in parts of some 300 kB, in chunks of 1,000 bytes, read back; every tenth is cut short and left out."""
    docs = x.table("documents").select((F.col("doc_id") % 3).alias("job"), F.col("doc_id").alias("ord"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))
    cost = X.entry_cost(F.col("size"), F.col("path"), False)
    files = docs.join(X.parts(docs.select("job", "ord", cost.alias("cost")), 300_000 + X.RESERVE), ["job", "ord"])
    wanted = F.when(F.col("ord") % 10 == 9, F.col("size") + 1).otherwise(F.col("size"))
    files = written(files.select("job", "part", "ord", "path", F.lit(0).cast("long").alias("modified_ms"), wanted.alias("size"), "content"))
    chunks, to = A.chunked(files, 1000), scratch(x.spark)
    path = x.spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(x.spark._jsc.hadoopConfiguration()).mkdirs(path)
    done = written(A.write_archives(A.entries(files.drop("content"), chunks), chunks, lambda job, part: f"{to}/{job}-{part}.zip"))
    return done.select("job", "part", F.concat(F.lit(f"{to}/"), "job", F.lit("-"), "part", F.lit(".zip")).alias("place")).mapInPandas(_listed, "job long, part int, path string, size long, md5 string").drop("part")


@query("SELECT DISTINCT 'status=' || o_orderstatus || '/year=' || year(o_orderdate) || '/month=' || month(o_orderdate) AS folder, 1::BIGINT AS n FROM orders")
def walked_folders(x: Library) -> DataFrame:
    """Orders written as a tree of three levels, a file in each folder of the last one, and walked."""
    to, date = scratch(x.spark), F.col("o_orderdate")
    rows = x.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.year(date).alias("year"), F.month(date).alias("month"))
    rows.repartition("status", "year", "month").write.partitionBy("status", "year", "month").parquet(to)
    files, _ = walk(x.spark, to, r"^part-.*\.parquet$")
    return files.groupBy(F.regexp_extract("path", r"(status=[^/]*/year=[^/]*/month=[^/]*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT folder_id::VARCHAR AS folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY media_key, timestamp_ms) AS number, CASE WHEN is_video THEN 'v' || media_key ELSE 'p' || media_key END AS uri, (timestamp_ms // 1000)::BIGINT AS seconds FROM idx""")
def log_fields(x: Library) -> DataFrame:
    T.register(x.spark)
    G.read_table(x.spark, _log(x), vectors=False).createOrReplaceTempView("log_rows_of_library")
    return x.spark.sql("SELECT * FROM log_fields(TABLE(log_rows_of_library), 'number, uri, seconds')")


@query(""", base AS (SELECT kind, max(ts_ms // 86400000) AS last FROM sightings WHERE ts_ms // 86400000 < 19750 GROUP BY kind), days AS (
  SELECT 0 AS n, (SELECT list({'kind': kind, 'last': last}) FROM base) AS known, NULL::VARCHAR AS kind
  UNION ALL
  SELECT n + 1, list_transform(known, lambda h: CASE WHEN h.kind = pick THEN {'kind': h.kind, 'last': day::BIGINT} ELSE h END), pick FROM (
    SELECT n, known, 19750 + n // 2 AS day, list_min(list_transform(list_filter(known, lambda h: h.last < 19750 + n // 2), lambda h: {'y': h.last = 19749 + n // 2, 'l': h.last, 'k': h.kind})).k AS pick FROM days WHERE n < 6)
) SELECT (19750 + (n - 1) // 2)::INTEGER AS day, CASE WHEN n % 2 = 1 THEN 'morning' ELSE 'evening' END AS part, kind FROM days WHERE kind IS NOT NULL""")
def memory_days(x: Library) -> DataFrame:
    """What three days send in the morning and in the evening, each run twice: choice, sending and the new history are one step."""
    past = x.sightings().select("kind", F.floor(F.col("ts_ms") / 86_400_000).cast("int").alias("day")).where("day < 19750")
    past = written(past.groupBy("kind").agg(F.max("day").alias("day")))
    kinds = past.select("kind", F.lit("ordinary").alias("role"), F.col("kind").alias("place"))
    state = Versions(x.spark, scratch(x.spark))

    def send(day: int, part: str) -> DataFrame:
        def step(read):
            history = read("history")
            history = past if history is None else history
            sent = written(R.rotation_choice(kinds, history, day, part).select(F.lit(day).alias("day"), F.lit(part).alias("part"), "kind"))
            return {"history": history.unionByName(sent.select("kind", "day"))}, sent

        return once(state, f"{day}:{part}", step)

    for day in range(19_750, 19_753):
        for part in ("morning", "evening"):
            send(day, part)
            send(day, part)
    return state.table("sent").select("day", "part", "kind")


def _landmarks(x: Library) -> DataFrame:
    return x.index().select("ord", F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 50 + 60).alias("p"))


@query(""", g AS (SELECT [38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041]::DOUBLE[] AS g), p AS (SELECT ord, [v::DOUBLE * 50 + 60 FOR v IN embedding[1:10]] AS p FROM idx), q AS (
  SELECT ord, unnest(range(1, 6)) AS i, p, g FROM p, g), r AS (SELECT ord, p[2 * i - 1] AS x, p[2 * i] AS y, g[2 * i - 1] AS u, g[2 * i] AS v FROM q), s AS (
  SELECT ord, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, regr_sxx(x, x) + regr_sxx(y, y) AS n, regr_sxy(x, u) + regr_sxy(y, v) AS d, regr_sxy(x, v) - regr_sxy(y, u) AS c FROM r GROUP BY ord)
SELECT ord, round(d / n, 6) AS a, round(c / n, 6) AS b, round(mu - (d / n * mx - c / n * my), 6) AS tx, round(mv - (c / n * mx + d / n * my), 6) AS ty FROM s""")
def face_alignments(x: Library) -> DataFrame:
    m = _landmarks(x).select("ord", E.alignment(F.col("p")).alias("m"))
    return m.select("ord", *(F.round(F.col("m")[c], 6).alias(c) for c in ("a", "b", "tx", "ty")))


@query(""", pic AS (SELECT o_orderkey AS key, (600 + o_orderkey * 37 % 1500)::INTEGER AS w, (500 + o_orderkey * 53 % 1400)::INTEGER AS h FROM orders), n AS (SELECT *, CASE WHEN w >= h * 1.8::DOUBLE THEN 3 ELSE 2 END AS nc, CASE WHEN h >= w * 1.8::DOUBLE THEN 3 ELSE 2 END AS nr FROM pic),
t AS (SELECT *, floor(w / (nc - (nc - 1) * 0.2::DOUBLE) + 0.5)::INTEGER AS tw, floor(h / (nr - (nr - 1) * 0.2::DOUBLE) + 0.5)::INTEGER AS th FROM n),
tile AS (SELECT *, floor((w - tw) * c / (nc - 1) + 0.5)::INTEGER AS x, floor((h - th) * r / (nr - 1) + 0.5)::INTEGER AS y FROM (SELECT *, unnest(range(nc)) AS c FROM (SELECT *, unnest(range(nr)) AS r FROM t))),
box AS (SELECT *, k, x + (k * 97 + key * 13) % tw AS l, y + (k * 61 + key * 29) % th AS top FROM (SELECT *, unnest(range(4)) AS k FROM tile)), b AS (SELECT *, least(l + 60, x + tw) AS rgt, least(top + 70, y + th) AS bot FROM box)
SELECT key, x::INTEGER AS x, y::INTEGER AS y, k::INTEGER AS k, l::INTEGER AS l, top::INTEGER AS t FROM b WHERE NOT (x > 0 AND l <= x + 2) AND NOT (y > 0 AND top <= y + 2) AND NOT (x + tw < w AND rgt >= x + tw - 2) AND NOT (y + th < h AND bot >= y + th - 2)""")
def seam_boxes(x: Library) -> DataFrame:
    """Boxes of every tile of a picture that no inner edge cuts."""
    key = F.col("o_orderkey")
    pics = x.table("orders").select(key.alias("key"), (600 + key * 37 % 1500).cast("int").alias("w"), (500 + key * 53 % 1400).cast("int").alias("h"))
    rows = pics.select("*", F.explode(E.tiles(F.col("w"), F.col("h"))).alias("tile")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    left, top = F.col("tile.x") + (F.col("k") * 97 + F.col("key") * 13) % F.col("tile.w"), F.col("tile.y") + (F.col("k") * 61 + F.col("key") * 29) % F.col("tile.h")
    rows = rows.withColumn("l", left.cast("int")).withColumn("t", top.cast("int"))
    box = F.struct("l", "t", F.least(F.col("l") + 60, F.col("tile.x") + F.col("tile.w")).alias("r"), F.least(F.col("t") + 70, F.col("tile.y") + F.col("tile.h")).alias("b"))
    return rows.where(~E.cut_by_tile(box, F.col("tile"), F.col("w"), F.col("h"))).select("key", F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "k", "l", "t")


@query()
def token_ids(x: Library) -> DataFrame:
    """Texts as ids of the encoder's vocabulary, which lies in TOKENIZER_DIR."""
    with open(f"{os.environ.get('TOKENIZER_DIR', '/opt/tokenizers')}/word_bpe_49k.json") as file:
        vocabulary = file.read()
    return W.clip_tokens(x.table("documents").select(F.col("doc_id").alias("id"), "text"), vocabulary)


# ---- faces of videos, people in blocks, lists of exports


def _tracked(x: Library) -> DataFrame:
    """Eight pictures as the frames of a video, a place in them as a track."""
    return x.faces().select(F.floor(F.col("media_key") / 8).alias("video"), (F.col("id") % 10).cast("int").alias("track"), "id", (F.col("media_key") % 8).cast("int").alias("frame"), F.col("rank").cast("double").alias("rank"))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY rank DESC, id) AS p FROM (SELECT media_key // 8 AS video, id % 10 AS track, id, media_key % 8 AS frame, rank FROM faces)),
s AS (SELECT o.video, o.track, coalesce(min(o.p) FILTER (abs(o.frame - f.frame) >= 2), 2) AS second FROM o JOIN o f ON f.video = o.video AND f.track = o.track AND f.p = 1 WHERE o.p > 1 GROUP BY 1, 2),
r AS (SELECT o.*, CASE WHEN p = 1 THEN 'best' WHEN p = second THEN 'second' END AS role FROM o LEFT JOIN s USING (video, track)),
k AS (SELECT *, row_number() OVER (PARTITION BY video, track, role IS NULL ORDER BY p) AS k, count(*) OVER (PARTITION BY video, track, role IS NULL) AS c FROM r)
SELECT video, track::INTEGER AS track, id, coalesce(role, 'extra') AS role FROM k WHERE role IS NOT NULL OR k = 1 OR k = c""")
def track_picks(x: Library) -> DataFrame:
    return C.recognition_picks(_tracked(x))


@query()
def face_tracks(x: Library) -> DataFrame:
    """Faces of a video's frames, linked by place and size."""
    box = x.faces().select(F.floor(F.col("media_key") / 8).alias("video"), "id", (F.col("media_key") % 8).cast("int").alias("frame"), F.col("box_r").cast("double").alias("cx"), F.col("box_b").cast("double").alias("cy"), (F.col("rank") / 100 + 0.01).cast("double").alias("size"), F.col("rank").cast("double").alias("rank"))
    return C.tracks(box)


@query()
def people_split(x: Library) -> DataFrame:
    """Every folder's faces in two groups, where they may be two people."""
    return C.two_groups(_faces(x).select((F.col("block") + 0).alias("person_id"), "id", "rank", "good", "embedding"))


@query()
def faces_placed(x: Library) -> DataFrame:
    return C.place_faces(_faces(x), C.Thresholds.named("loose"))


@query()
def faces_regrouped(x: Library) -> DataFrame:
    """As placed, but the clearest of a block first, and like people merged."""
    rows = _faces(x).withColumn("pinned", F.lit(False)).withColumn("named", F.lit(False))
    return C.regroup(rows, x.spark.createDataFrame([], "block long, a long, b long"), C.Thresholds.named("strict"))


@query(""", e AS (SELECT o_custkey % 5 AS job, (o_orderkey % 2)::INTEGER AS part, o_orderpriority AS album, o_orderkey % 10 = 0 AS video, o_orderkey AS ord, taken_ms FROM orders JOIN media_dates ON key = o_orderkey),
f AS (SELECT job, part, album, CASE WHEN video THEN 'videos' ELSE 'images' END AS kind, min(ord) AS ord, list({'path': album || '/' || ord || '.jpg', 'name': ord || '.jpg', 'type': CASE WHEN video THEN 'video' ELSE 'image' END,
  'dateTaken': CASE WHEN taken_ms > 0 THEN strftime(make_timestamp(taken_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') END, 'modified': NULL::VARCHAR, 'size': ord * 3} ORDER BY ord) AS files FROM e GROUP BY 1, 2, 3, 4)
SELECT job, part, to_json({'part': part + 1, 'parts': max(part) OVER (PARTITION BY job) + 1, 'albums': albums})::VARCHAR AS manifest FROM (SELECT job, part, list({'name': album, 'type': kind, 'files': files} ORDER BY ord) AS albums FROM f GROUP BY 1, 2)""")
def export_lists(x: Library) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 10 == 0, "videos").otherwise("images")
    rows = x.table("orders").join(x.media_dates(), F.col("key") == key).select(
        (F.col("o_custkey") % 5).alias("job"), (key % 2).cast("int").alias("part"), F.col("o_orderpriority").alias("album"), kind.alias("kind"), F.concat("o_orderpriority", F.lit("/"), key, F.lit(".jpg")).alias("path"), F.concat(key, F.lit(".jpg")).alias("name"),
        (key % 10 == 0).alias("is_video"), "taken_ms", F.lit(0).cast("long").alias("modified_ms"), (key * 3).alias("size"), key.alias("ord"),
    )
    return X.manifest(rows)
