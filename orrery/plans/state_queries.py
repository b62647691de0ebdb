"""Queries of the library's tables as they change, of small functions, and of what there is to remember."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import dates as D
from orrery.functions import media as A
from orrery.functions import scalar as S
from orrery.operators import catalogue as K
from orrery.operators import cluster as C
from orrery.operators import export as X
from orrery.operators import library as B
from orrery.operators import memories as M
from orrery.operators import notices as N
from orrery.operators import people as P
from orrery.operators import state as U
from orrery.operators import timeline as L
from orrery.operators import vector as V
from orrery.plans.queries import _CANDIDATES, _GROUPS, _MONTHS, _REUNIONS, query, r6
from orrery.sources.views import Library

# ---- tables that change


@query("SELECT ord, folder_id FROM idx WHERE folder_id <> 3")
def delete_folder(x: Library) -> DataFrame:
    return B.delete_where(x.index(), F.col("folder_id") == 3).select("ord", "folder_id")


@query("SELECT count(*) AS n FROM idx WHERE false")
def clear_index(x: Library) -> DataFrame:
    return B.emptied(x.index())[0].agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT hash, coalesce(uri, '') AS uri, complete FROM (SELECT hash, uri, hash % 2 = 0 AS complete FROM photos WHERE hash % 5 <> 0 UNION ALL SELECT hash, 'new' || hash, false FROM photos WHERE hash % 5 = 0)""")
def insert_photos(x: Library) -> DataFrame:
    old = x.photos().select("hash", "uri", (F.col("hash") % 2 == 0).alias("complete"))
    new = x.photos().where("hash % 5 = 0").select("hash", F.concat(F.lit("new"), "hash").alias("uri"))
    found = x.faces().where("media_key % 5 = 0").select("media_key", F.col("id").alias("place"))
    return B.insert_photos(old, x.faces().select("id", "media_key"), new, found)[0].select("hash", "uri", "complete")


@query("SELECT count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM (SELECT (SELECT max(id) FROM faces) + row_number() OVER () AS id FROM faces WHERE media_key % 5 = 0)")
def new_face_ids(x: Library) -> DataFrame:
    found = x.faces().where("media_key % 5 = 0").select("media_key", F.col("id").alias("place"))
    ids = B.numbered(found, x.faces().agg(F.max("id").alias("id")))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _frames(x: Library) -> DataFrame:
    return x.photos().where("is_video").select("hash", F.floor(F.col("hash") / 30).alias("video_hash"), "uri")


@query("SELECT id, media_key FROM faces WHERE media_key NOT IN (SELECT hash FROM photos WHERE is_video AND (hash // 30) % 4 = 0)")
def delete_video_inside(x: Library) -> DataFrame:
    frames = _frames(x)
    gone = frames.where("video_hash % 4 = 0").select("video_hash")
    return B.delete_inside(frames, x.faces().select("id", "media_key"), gone)[1]


@query("""SELECT hash AS media_key, count(id) AS n FROM photos LEFT JOIN (SELECT id, media_key FROM faces WHERE media_key NOT IN (SELECT hash FROM photos WHERE is_video AND (hash // 30) % 4 = 0)
  UNION ALL SELECT 0, hash FROM photos WHERE is_video AND (hash // 30) % 4 = 0) f ON media_key = hash WHERE is_video GROUP BY hash""")
def insert_videos(x: Library) -> DataFrame:
    frames = _frames(x)
    own = frames.where("video_hash % 4 = 0")
    videos = frames.select("video_hash").distinct().withColumn("uri", F.lit("v")).withColumn("exact", F.lit(0))
    found = own.select(F.col("hash").alias("media_key"), F.lit(1).alias("place"))
    _, frames_, faces = B.insert_videos(videos, frames, x.faces().select("id", "media_key"), own.select("video_hash", F.lit("w").alias("uri")).distinct(), own, found)
    return frames_.join(faces, F.col("hash") == F.col("media_key"), "left").groupBy(F.col("hash").alias("media_key")).agg(F.count("id").alias("n"))


@query("SELECT v AS video_hash, CASE WHEN v % 4 = 0 THEN 1 ELSE 2 END AS exact FROM (SELECT DISTINCT hash // 30 AS v FROM photos WHERE is_video)")
def looked_frames(x: Library) -> DataFrame:
    frames = _frames(x)
    known = frames.where("video_hash % 4 = 0").select("video_hash", "uri").dropDuplicates(["video_hash"]).withColumn("exact", F.lit(1))
    found = frames.select(F.col("hash").alias("media_key"), F.lit(1).alias("place"))
    empty = frames.where(F.lit(False)).withColumn("complete", F.lit(False))
    return B.store_looked_frames(known, empty, x.faces().select("id", "media_key"), frames, found)[0].select("video_hash", "exact")


@query("SELECT v AS video_hash, CASE WHEN v % 2 = 0 OR v % 3 = 0 THEN 1 ELSE 0 END AS exact FROM (SELECT DISTINCT hash // 30 AS v FROM photos WHERE is_video AND (hash // 30 % 3 = 0 OR hash // 30 % 2 = 1))")
def mark_scanned(x: Library) -> DataFrame:
    all_ = _frames(x).select("video_hash").distinct()
    known = all_.where("video_hash % 2 = 1").withColumn("uri", F.lit("u")).withColumn("exact", F.lit(0))
    return B.mark_scanned(known, all_.where("video_hash % 3 = 0").withColumn("uri", F.lit("u"))).select("video_hash", "exact")


@query("SELECT hash, hash % 2 = 0 OR hash % 3 = 0 AS complete FROM photos")
def mark_complete(x: Library) -> DataFrame:
    photos = x.photos().select("hash", (F.col("hash") % 2 == 0).alias("complete"))
    return B.mark_complete(photos, photos.where("hash % 3 = 0"))


@query("SELECT id, CASE WHEN id = 21 THEN 5 ELSE person_id END AS person_id, locked OR id = 21 AS locked, CASE WHEN id = 21 THEN 9 END AS blocked FROM faces")
def lock_face(x: Library) -> DataFrame:
    faces = x.faces().withColumn("blocked", F.lit(None).cast("long"))
    return U.lock_face(faces, 21, 5, 9).select("id", "person_id", "locked", "blocked")


@query("SELECT id, CASE WHEN person_id IS NOT NULL AND NOT locked AND id IN (SELECT id FROM faces WHERE person_id = 2) THEN 999 ELSE person_id END AS person_id FROM faces")
def restore_person(x: Library) -> DataFrame:
    entry = x.faces().where("person_id = 2").agg(F.collect_list("id").alias("face_ids"))
    return U.restore_faces(x.faces(), entry, 999).select("id", "person_id")


@query("SELECT id, deferred AND id % 4 <> 2 AS deferred, CASE WHEN deferred AND id % 4 = 2 THEN 2 ELSE 0 END AS dim FROM faces")
def fill_vectors(x: Library) -> DataFrame:
    faces = x.faces().withColumn("embedding", F.expr("cast(array() as array<float>)"))
    found = x.faces().where("deferred and id % 4 = 2").select("id", F.expr("array(1f, 2f)").alias("embedding"))
    return B.fill_vectors(faces, found).select("id", "deferred", F.size("embedding").alias("dim"))


@query("SELECT DISTINCT kind AS uri, ts_ms, person FROM sightings")
def record_seen(x: Library) -> DataFrame:
    seen = x.sightings().select(F.col("kind").alias("uri"), "ts_ms", "person")
    return B.record_seen(seen.where("person % 2 = 0").distinct(), seen)


@query("SELECT name AS key FROM file_names WHERE key % 3 = 2")
def wipe_meta(x: Library) -> DataFrame:
    key = F.when(F.col("key") % 3 == 0, F.concat(F.lit("video_relax_"), "name")).when(F.col("key") % 3 == 1, F.concat(F.lit("video_fail_"), "name")).otherwise(F.col("name"))
    return B.wiped_meta(x.file_names().select(key.alias("key")))


@query("SELECT name AS key, CASE WHEN key % 2 = 0 THEN 'new' WHEN key % 3 = 0 THEN 'old' END AS value FROM file_names")
def meta_values(x: Library) -> DataFrame:
    names = x.file_names().select(F.col("name").alias("key"), F.col("key").alias("n"))
    meta = U.upsert(names.where("n % 3 = 0").select("key", F.lit("old").alias("value")), names.where("n % 2 = 0").select("key", F.lit("x").alias("value")), ["key"])
    return B.get_meta(B.set_meta(meta, names.where("n % 2 = 0").select("key", F.lit("new").alias("value"))), names)


@query("SELECT kind AS uri, min(event_id) AS at FROM (SELECT event_type AS kind, event_id FROM events) GROUP BY kind")
def latest_scan(x: Library) -> DataFrame:
    scanned = x.sightings().select(F.col("kind").alias("uri"), F.col("event_id").alias("at"))
    return B.latest_scan(scanned.limit(1), scanned)


@query("SELECT min(event_id) AS at FROM events")
def latest_scan_kept(x: Library) -> DataFrame:
    before = x.sightings().agg(F.min("event_id").alias("at")).select(F.lit("a").alias("uri"), "at")
    return B.latest_scan(before, before.where(F.lit(False))).select("at")


@query("SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM listed) AS people")
def store_stats(x: Library) -> DataFrame:
    return B.stats(x.photos(), x.people(), x.faces())


@query("""SELECT media_key, list_sort(list(DISTINCT person_id) FILTER (person_id IN (1, 2, 3))) AS people, count(*) FILTER (coalesce(person_id NOT IN (1, 2, 3), true)) AS others, max(rank) FILTER (person_id IN (1, 2, 3)) AS rank
FROM faces GROUP BY media_key HAVING count(*) FILTER (person_id IN (1, 2, 3)) > 0""")
def frame_rows(x: Library) -> DataFrame:
    return B.frame_rows(x.faces(), [1, 2, 3])


@query("SELECT EXISTS (SELECT * FROM idx WHERE media_key NOT IN (SELECT media_key FROM faces)) OR EXISTS (SELECT * FROM faces WHERE deferred) AS work")
def has_work(x: Library) -> DataFrame:
    return B.has_work(x.index(), x.faces(), x.faces().where("deferred"))


@query("SELECT key, CASE WHEN key % 2 = 0 THEN taken_ms WHEN key % 3 = 0 THEN 7 ELSE 0 END AS taken_ms, CASE WHEN key % 2 = 0 THEN src WHEN key % 3 = 0 THEN 2 ELSE 0 END AS src FROM media_dates WHERE key IN (SELECT key FROM media_dates WHERE src <> 1 ORDER BY key LIMIT 300)")
def resolve_dates(x: Library) -> DataFrame:
    d = x.media_dates()
    read = d.where("key % 3 = 0").select("key", F.lit(7).cast("long").alias("taken_ms"), F.lit(2).alias("src"))
    return B.resolve_dates(d.where("src <> 1"), d.where("key % 2 = 0"), read, 300)


@query("SELECT hash, hash IN (SELECT media_key FROM faces) AS has_faces, EXISTS (SELECT * FROM faces WHERE media_key = hash AND deferred) AS waits FROM photos WHERE uri IN ('uri1', 'uri2', 'uri3', 'uri7')")
def photo_probes(x: Library) -> DataFrame:
    own = x.photos().where(F.col("uri").isin("uri1", "uri2", "uri3", "uri7")).select("hash")
    faces = x.faces().join(F.broadcast(own.select(F.col("hash").alias("media_key"))), "media_key", "left_semi").groupBy("media_key").agg(F.bool_or("deferred").alias("w"))
    return own.join(faces, F.col("hash") == F.col("media_key"), "left").select("hash", F.col("w").isNotNull().alias("has_faces"), F.coalesce("w", F.lit(False)).alias("waits"))


@query("SELECT media_key, id FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY rank DESC, id) AS n FROM faces) WHERE n = 1")
def preview_faces(x: Library) -> DataFrame:
    return V.first_by(x.faces(), ["media_key"], F.desc("rank"), "id").select("media_key", "id")


@query("SELECT id, rank FROM faces WHERE NOT deferred")
def faces_by_rank(x: Library) -> DataFrame:
    return x.faces().where("not deferred").select("id", "rank").orderBy(F.desc("rank"), "id")


@query("SELECT media_key, id FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY rank DESC, id) AS n FROM faces) WHERE n <= 3")
def trimmed_faces(x: Library) -> DataFrame:
    return A.top_per(x.faces(), "media_key", 3, F.desc("rank"), "id").select("media_key", "id")


# ---- collections and lists


@query("SELECT 'c' || folder_id AS id, CASE WHEN folder_id % 3 <> 0 AND count(*) FILTER (is_video) = 0 THEN 'none' WHEN folder_id % 2 = 0 THEN 'everyday' ELSE 'main' END AS part FROM idx GROUP BY folder_id")
def collection_tabs(x: Library) -> DataFrame:
    c = x.index().groupBy("folder_id").agg(F.count_if("is_video").alias("n"))
    part = K.tab_part(F.col("folder_id") % 3 != 0, F.col("folder_id") % 2 == 0, F.col("n"), F.lit(True), F.lit(False))
    return c.select(F.concat(F.lit("c"), "folder_id").alias("id"), part.alias("part"))


@query("SELECT id FROM (SELECT DISTINCT 'c' || folder_id AS id, folder_id % 4 = 0 AS fresh FROM idx) ORDER BY fresh DESC, md5(id || ':19700'), id LIMIT 5")
def hero_candidates(x: Library) -> DataFrame:
    c = x.index().select(F.concat(F.lit("c"), "folder_id").alias("id"), (F.col("folder_id") % 4 == 0).alias("fresh")).distinct()
    return K.hero_candidates(c, 19700)


@query("SELECT hash FROM photos WHERE hash NOT IN (SELECT media_key FROM idx) ")
def shuffled_new_files(x: Library) -> DataFrame:
    new = V.new_files(x.photos(), x.index().select(F.col("media_key").alias("hash")))
    return K.shuffled(new, "hash", 5).select("hash")


_BUILT_IN = ", ".join("('{}', '{}', {}, {})".format(i, name, sensitivity, len(prompts)) for i, name, sensitivity, prompts in K.BUILT_IN)


@query(f"SELECT id, CASE WHEN id = 'builtin_pets' THEN 'Mine' ELSE name END AS name, sensitivity::DOUBLE AS sensitivity, CASE WHEN id = 'builtin_pets' THEN 1 ELSE n END AS n_prompts, CASE WHEN id IN ('builtin_pets', 'builtin_food') THEN 1 ELSE 0 END AS hidden FROM (VALUES {_BUILT_IN}) v(id, name, sensitivity, n)")
def built_in_collections(x: Library) -> DataFrame:
    mine = x.spark.createDataFrame([("builtin_pets", "Mine", ["a cat"], 3.0, 1), ("builtin_food", "x", [], 1.0, 1)], "id string, name string, prompts array<string>, sensitivity double, hidden int")
    return U.overlay(K.built_in(x.spark), mine).select("id", "name", "sensitivity", F.size("prompts").alias("n_prompts"), "hidden")


# ---- memories


_DAYS = """, y AS (SELECT year(make_timestamp(taken_ms * 1000))::INTEGER AS year, key, taken_ms, coalesce(score, 0) AS score FROM reliable r LEFT JOIN cand USING (key)
  WHERE month(make_timestamp(taken_ms * 1000)) = {month} AND day(make_timestamp(taken_ms * 1000)) BETWEEN {first} AND {last} AND year(make_timestamp(taken_ms * 1000)) < 2002),
days AS (SELECT year, 2002 - year AS years_ago, count(*) AS total, least(max(score), 300) / 300 + 0.5 * least(1, ln(1 + count(*)) / ln(21)) + CASE WHEN max(score) > 0 THEN 0.3 ELSE 0 END AS strength,
  max(score) > 0 OR count(*) >= 4 AS qualifies, arg_max(taken_ms, (score, -taken_ms)) AS taken_ms FROM y GROUP BY year)
"""


def _days(x: Library, month: int, day: int, spread: int) -> DataFrame:
    ranges = M.past_ranges(x.spark, 2002, month, day, spread)
    scores = P.face_scores(x.faces())
    found = M.on_this_day(x.media_dates(), scores, ranges)
    rows = P.reliable(x.media_dates()).join(F.broadcast(ranges), (F.col("taken_ms") >= F.col("start")) & (F.col("taken_ms") < F.col("end"))).join(scores, F.col("key") == F.col("media_key"), "left")
    best = rows.groupBy("year").agg((-F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("taken_ms")).alias("t")))["t"]).alias("taken_ms"))
    return found.join(best, "year").select("year", (2002 - F.col("year")).alias("years_ago"), "total", "strength", "qualifies", "taken_ms")


@query(_CANDIDATES + _DAYS.format(month=5, first=1, last=7) + "SELECT year, total, 'week' AS kind FROM days")
def memory_plan_week(x: Library) -> DataFrame:
    return N.exact_or_week(_days(x, 5, 4, 0).where(F.lit(False)), _days(x, 5, 4, 3)).select("year", "total", "kind")


@query(_CANDIDATES + _DAYS.format(month=5, first=4, last=4) + "SELECT count(*) AS n_years, coalesce(sum(total), 0)::BIGINT AS total FROM days")
def memory_view_total(x: Library) -> DataFrame:
    return N.view_total(N.exact_or_week(_days(x, 5, 4, 0), _days(x, 5, 4, 3)))


@query(_CANDIDATES + _DAYS.format(month=5, first=1, last=7) + """, b AS (SELECT * FROM days WHERE qualifies ORDER BY strength DESC, years_ago DESC LIMIT 1), n AS (SELECT count(*) AS n FROM days WHERE qualifies),
told AS (SELECT *, CASE WHEN years_ago = 1 THEN '1 year' ELSE years_ago || ' years' END AS span, strftime(make_timestamp(taken_ms * 1000), '%B %-d') AS label FROM b)
SELECT 'on_this_day' AS kind, year, CASE WHEN total >= 40 THEN 'A day to remember · ' || span || ' ago' ELSE span || ' ago today' END AS title,
  CASE WHEN total >= 40 OR total > 1 THEN label || ', ' || year || ' · ' || total || ' photos and videos' ELSE label || ', ' || year END AS body FROM told
UNION ALL SELECT 'same_day', year, label || ', across the years', 'Photos from ' || n || ' different years are waiting for you.' FROM told, n WHERE n >= 3""")
def memory_notices(x: Library) -> DataFrame:
    years = _days(x, 5, 4, 3).withColumn("kind", F.lit("exact")).withColumn("names", F.expr("cast(array() as array<string>)"))
    return N.day_notices(years, 4)


@query(_GROUPS + _REUNIONS + _MONTHS + """, c AS (SELECT (year(make_timestamp(ms * 1000)) * 12 + month(make_timestamp(ms * 1000)) - 1)::INTEGER AS month, len(people) AS n FROM g),
gang AS (SELECT month, n FROM (SELECT *, row_number() OVER (PARTITION BY month // 12 ORDER BY n DESC, month) AS r FROM c WHERE n >= 4) WHERE r = 1),
ru AS (SELECT (year(make_timestamp(day * 86400 * 1000000)) * 12 + month(make_timestamp(day * 86400 * 1000000)) - 1)::INTEGER AS month, n, round(gap / 30.4::DOUBLE)::INTEGER AS m FROM found WHERE n >= 3),
f AS (SELECT person_id, min(month) AS month, sum(n) AS total FROM months GROUP BY person_id), y AS (SELECT *, month // 12 AS year FROM f),
s AS (SELECT year, count(*) AS n, list(month ORDER BY month) AS l FROM y WHERE year > (SELECT min(year) FROM y) AND total >= 4 GROUP BY year HAVING count(*) >= 1)
SELECT 'gang' AS kind, month, (40 + 8 * least(n, 10))::INTEGER AS importance, 'The whole gang: ' || n || ' people in one photo' AS text FROM gang
UNION ALL SELECT 'reunion', month, (50 + 6 * least(n, 10) + least(m, 36) // 2)::INTEGER, 'A reunion: ' || n || ' of you together again after ' || CASE WHEN m >= 24 THEN round(m / 12.0::DOUBLE)::INTEGER || ' years' ELSE m || ' months' END FROM ru
UNION ALL SELECT 'new', l[n // 2 + 1], (30 + 6 * least(n, 10))::INTEGER, n || ' new faces in ' || year FROM s""")
def group_moments(x: Library) -> DataFrame:
    groups, months = L.groups(x.faces(), x.media_dates()), L.timeline_months(x.faces(), x.media_dates())
    crowds = groups.select(L.month_of(F.col("ms")).alias("month"), F.size("people").alias("n"))
    again = L.reunion_candidates(groups).select(L.month_of(F.col("day") * L.DAY_MS).alias("month"), "n", "gap")
    return N.group_moments(crowds, again, L.new_arrivals(months, people=1))


@query("SELECT kind AS uri, month, importance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY importance DESC, month) AS r FROM (SELECT kind, (ts_ms // 2592000000)::INTEGER AS month, (person % 50)::INTEGER AS importance FROM sightings)) WHERE r = 1")
def photo_moments(x: Library) -> DataFrame:
    m = x.sightings().select(F.col("kind").alias("uri"), F.floor(F.col("ts_ms") / 2592000000).cast("int").alias("month"), (F.col("person") % 50).cast("int").alias("importance"))
    return N.photo_moments(m)


@query("SELECT DISTINCT 'person:' || person AS subject FROM sightings WHERE 'person:' || person NOT IN (SELECT 'person:' || person FROM sightings WHERE ts_ms // 86400000 BETWEEN 19656 AND 19700)")
def fresh_subjects(x: Library) -> DataFrame:
    s = x.sightings().select(F.concat(F.lit("person:"), "person").alias("subject"), F.floor(F.col("ts_ms") / L.DAY_MS).alias("day"))
    return M.fresh_subjects(s.select("subject").distinct(), s, 19700)


@query("SELECT o_orderkey AS id, unnest(['trip', 'vault']) AS kind, unnest([(o_orderkey % 100)::INTEGER, 12]) AS day, unnest(['evening', '']) AS slot FROM orders")
def decoded_history(x: Library) -> DataFrame:
    state = F.concat(F.lit("trip:"), F.col("o_orderkey") % 100, F.lit(":evening,vault:12,bad,:3,a:b:c:d,trip:x"))
    return M.decode_history(x.table("orders").select(F.col("o_orderkey").alias("id"), state.alias("state")))


@query("SELECT o_custkey AS id, array_to_string(list(o_orderpriority || ':' || o_orderkey || ':m' ORDER BY o_orderkey)[-28:], ',') AS state FROM orders GROUP BY o_custkey")
def encoded_history(x: Library) -> DataFrame:
    h = x.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("day"), F.lit("m").alias("slot"))
    return M.encode_history(h)


@query("SELECT kind FROM (VALUES ('a', 1), ('b', 3), ('c', 7)) v(kind, place) ORDER BY place <= 3, place LIMIT 1")
def next_kind(x: Library) -> DataFrame:
    return M.next_choice(x.spark.createDataFrame([("a", 1), ("b", 3), ("c", 7)], "kind string, place int"), 3)


# ---- small functions


@query("SELECT key, CASE WHEN key % 4 = 0 THEN 0 ELSE taken_ms + 36900000 END AS ms FROM media_dates")
def exif_dates(x: Library) -> DataFrame:
    text = F.when(F.col("key") % 4 != 0, F.date_format(D.local(F.col("taken_ms")), "yyyy:MM:dd 10:15:00")).otherwise("0000:00:00 00:00:00")
    return x.media_dates().select("key", A.exif_date(F.when(F.col("key") % 2 == 0, text), F.when(F.col("key") % 2 == 1, text), F.lit("none")).alias("ms"))


@query("""SELECT key AS id, CASE WHEN key % 3 = 0 THEN name WHEN key % 3 = 1 THEN 'x y.jpg' ELSE 'uri' || key END AS name, CASE WHEN key % 3 = 2 OR key % 5 = 0 THEN -1 ELSE key END AS size, NOT (key % 3 = 2 OR key % 5 = 0) AS readable FROM file_names""")
def file_infos(x: Library) -> DataFrame:
    files = x.file_names().select("key", "name", F.when(F.col("key") % 3 == 1, F.concat(F.lit("f/"), "key", F.lit("/x y.jpg"))).otherwise(F.concat(F.lit("f/uri"), "key")).alias("uri"))
    meta = files.where("key % 3 <> 2").select("uri", F.when(F.col("key") % 3 == 0, F.col("name")).otherwise(F.lit("  ")).alias("name"), F.when(F.col("key") % 5 != 0, F.col("key")).alias("size"))
    return A.file_info(files, meta).join(files.select("uri", F.col("key").alias("id")), "uri").select("id", "name", "size", "readable")


@query("SELECT key, key % 4 <> 1 AS image FROM file_names")
def image_names(x: Library) -> DataFrame:
    name = F.element_at(F.array(F.lit("a.JPG"), F.lit("b.Mp4?t=3"), F.lit("noending"), F.lit("mp4.png")), (F.col("key") % 4 + 1).cast("int"))
    return x.file_names().select("key", D.is_image(name).alias("image"))


_QUALITY = "SELECT key, (key % 60)::DOUBLE AS size, (key % 11) / 10.0::DOUBLE AS score, (key % 17) / 10.0::DOUBLE AS yaw, (key % 40)::DOUBLE AS sharp FROM media_dates"


def _quality(x: Library) -> DataFrame:
    key = F.col("key")
    return x.media_dates().select("key", (key % 60).cast("double").alias("size"), (key % 11 / 10).alias("score"), (key % 17 / 10).alias("yaw"), (key % 40).cast("double").alias("sharp"))


@query(f"SELECT key, size >= 48 AND score >= 0.6 AND yaw <= 0.55 AND sharp >= 20 AS photo, size >= 44 AND score >= 0.5 AND yaw <= 0.65 AND sharp >= 14 AS video FROM ({_QUALITY})")
def good_faces(x: Library) -> DataFrame:
    c = [F.col(n) for n in ("size", "score", "yaw", "sharp")]
    return _quality(x).select("key", S.is_good_face(*c).alias("photo"), S.is_good_face(*c, video=True).alias("video"))


@query(f"SELECT key, size >= 44 AND score >= 0.5 AND yaw <= 0.65 AND sharp >= 14 AS a, size >= 36 AND score >= 0.4 AND yaw <= 0.85 AND sharp >= 6 AS b, size >= 28 AND score >= 0.3 AND yaw <= 1.5 AS c FROM ({_QUALITY})")
def relaxed_faces(x: Library) -> DataFrame:
    c = [F.col(n) for n in ("size", "score", "yaw", "sharp")]
    return _quality(x).select("key", *(A.good_when_relaxed(level, *c).alias(n) for level, n in enumerate("abc")))


@query("SELECT key, CASE WHEN a = 0 AND b = 0 THEN 1 ELSE round(abs((7 - a / 2.0::DOUBLE) * a + (3 - b / 2.0::DOUBLE) * b) / (a * a + b * b), 6) END AS yaw FROM (SELECT key, (key % 9)::DOUBLE AS a, (key % 5)::DOUBLE AS b FROM media_dates)")
def face_yaws(x: Library) -> DataFrame:
    points = F.array(F.lit(0.0), F.lit(0.0), (F.col("key") % 9).cast("double"), (F.col("key") % 5).cast("double"), F.lit(7.0), F.lit(3.0))
    return x.media_dates().select("key", F.round(S.face_yaw(points), 6).alias("yaw"))


@query("""SELECT a.id AS a, b.id AS b, round(CASE WHEN ua > 0 THEN w * h / ua ELSE 0 END, 6) AS iou FROM (SELECT *, la + lb - w * h AS ua FROM (SELECT f.id, g.id AS other, greatest(0, least(f.box_r, g.box_r) - greatest(f.box_l, g.box_l)) AS w, greatest(0, least(f.box_b, g.box_b) - greatest(f.box_t, g.box_t)) AS h,
  (f.box_r - f.box_l) * (f.box_b - f.box_t) AS la, (g.box_r - g.box_l) * (g.box_b - g.box_t) AS lb FROM faces f JOIN faces g ON f.media_key = g.media_key AND f.id < g.id)) p JOIN faces a ON a.id = p.id JOIN faces b ON b.id = p.other""")
def face_overlaps(x: Library) -> DataFrame:
    box = lambda n: F.struct(F.col("box_l").alias("l"), F.col("box_t").alias("t"), F.col("box_r").alias("r"), F.col("box_b").alias("b")).alias(n)
    a, b = (x.faces().select("media_key", F.col("id").alias(n), box(f"box_{n}")) for n in "ab")
    return a.join(b, "media_key").where("a < b").select("a", "b", F.round(S.iou(F.col("box_a"), F.col("box_b")), 6).alias("iou"))


@query(""", n AS MATERIALIZED (SELECT media_key, id, rank AS score, box_r AS r, box_b AS b, row_number() OVER (PARTITION BY media_key ORDER BY rank DESC, id) AS i FROM faces),
k AS (SELECT media_key, i, id, [(r, b)] AS kept, true AS ok FROM n WHERE i = 1 UNION ALL
  SELECT media_key, i, id, CASE WHEN ok THEN list_append(kept, (r, b)) ELSE kept END, ok FROM (SELECT n.media_key, n.i, n.id, n.r, n.b, k.kept, len(list_filter(k.kept, lambda y: CASE WHEN n.r * n.b + y[1] * y[2] - least(n.r, y[1]) * least(n.b, y[2]) > 0
    THEN least(n.r, y[1]) * least(n.b, y[2]) / (n.r * n.b + y[1] * y[2] - least(n.r, y[1]) * least(n.b, y[2])) ELSE 0 END > 0.4)) = 0 AS ok FROM k JOIN n ON n.media_key = k.media_key AND n.i = k.i + 1))
SELECT media_key, id FROM k WHERE ok""")
def kept_boxes(x: Library) -> DataFrame:
    return C.suppressed(x.faces().select("media_key", "id", F.col("rank").alias("score"), F.col("box_l").alias("l"), F.col("box_t").alias("t"), F.col("box_r").alias("r"), F.col("box_b").alias("b")))


_SIGN = "CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT"


@query(f"SELECT key, {_SIGN} AS hash FROM (SELECT key, xor(xor(key::HUGEINT * {S.FRAME_VIDEO} % 18446744073709551616, taken_ms::HUGEINT * {S.FRAME_TIME} % 18446744073709551616), {S.FRAME_MASK}::HUGEINT) AS h FROM media_dates)")
def frame_hashes(x: Library) -> DataFrame:
    return x.media_dates().select("key", S.frame_hash(F.col("key"), F.col("taken_ms")).alias("hash"))


@query(f"SELECT key, {_SIGN} AS hash FROM (SELECT key, list_reduce(list_prepend({S.HASH_START}::HUGEINT, list_concat([key::HUGEINT, key::HUGEINT * 1000], list_transform(string_split(name, ''), lambda c: unicode(c)::HUGEINT))), lambda h, v: (31 * h + v) % 18446744073709551616) AS h FROM file_names)", name="identity_hashes")
def identity_hashes(x: Library) -> DataFrame:
    return x.file_names().select("key", S.identity_hash(F.col("key"), F.col("key") * 1000, F.col("name")).alias("hash"))


@query(f"SELECT hash AS key, {_SIGN} AS h64 FROM (SELECT hash, ('0x' || substr(sha256(uri), 1, 16))::UBIGINT::HUGEINT AS h FROM photos)")
def uri_hashes(x: Library) -> DataFrame:
    return x.photos().select(F.col("hash").alias("key"), S.uri_hash(F.col("uri")).alias("h64"))


@query("SELECT o_orderkey AS key, (s + s // 13000 + 500)::BIGINT AS cost FROM (SELECT o_orderkey, floor(o_totalprice * 100)::BIGINT AS s FROM orders)")
def zip_estimates(x: Library) -> DataFrame:
    return x.table("orders").select(F.col("o_orderkey").alias("key"), S.zip_estimate(F.floor(F.col("o_totalprice") * 100).cast("long")).alias("cost"))


@query("SELECT key, CASE WHEN key % 60 >= 20 AND key * 7 >= 8000 THEN round(key * 7 / (key % 60)::DOUBLE * (1000 - key % 60))::BIGINT END AS left_ms FROM media_dates")
def scan_time_left(x: Library) -> DataFrame:
    return x.media_dates().select("key", A.time_left(F.col("key") * 7, F.col("key") % 60, F.lit(1000)).alias("left_ms"))


@query("SELECT key, CASE key % 4 WHEN 0 THEN '_a_b_' || key WHEN 1 THEN 'trip' || key WHEN 2 THEN 'Album' ELSE repeat('x', 100) END AS name FROM file_names")
def safe_names(x: Library) -> DataFrame:
    k = F.col("key")
    text = F.when(k % 4 == 0, F.concat(F.lit(" :a/b?"), k)).when(k % 4 == 1, F.concat(F.lit("..trip"), k, F.lit("."))).when(k % 4 == 2, " .. ").otherwise(F.repeat(F.lit("x"), F.lit(150)))
    return x.file_names().select("key", S.safe_name(text, "Album").alias("name"))


@query("SELECT n_nationkey AS key, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN n_name WHEN 2 THEN n_name || ' and B' ELSE n_name || ', B and C' END AS names FROM nation")
def joined_names(x: Library) -> DataFrame:
    names = F.slice(F.array(F.col("n_name"), F.lit("B"), F.lit("C")), F.lit(1), (F.col("n_nationkey") % 4).cast("int"))
    return x.table("nation").select(F.col("n_nationkey").alias("key"), S.joined_names(names).alias("names"))


@query("SELECT ord, list_transform(embedding, lambda v: v::FLOAT) AS v FROM idx")
def blob_roundtrip(x: Library) -> DataFrame:
    return x.index().select("ord", A.floats_of(A.blob_of(F.col("embedding"))).alias("v"))


@query("SELECT key AS id, [name, 'b \"c\"'] AS prompts, CASE WHEN key % 2 = 0 THEN [key, 7] END AS person_ids FROM file_names")
def collection_json(x: Library) -> DataFrame:
    seed = F.struct(F.array(F.lit(1.5)).alias("embedding"), F.lit("u").alias("uri"), F.lit(3).cast("long").alias("timestamp_ms"))
    c = x.file_names().select(F.col("key").alias("id"), F.array(F.col("name"), F.lit('b "c"')).alias("prompts"), seed.alias("seed"), F.when(F.col("key") % 2 == 0, F.array(F.col("key"), F.lit(7).cast("long"))).alias("person_ids"))
    return A.collection_from_row(A.collection_to_row(c)).where("seed.uri = 'u'").select("id", "prompts", "person_ids")


@query("SELECT key, 'v2|' || name || '|b' AS signature FROM file_names")
def signatures(x: Library) -> DataFrame:
    return x.file_names().select("key", A.signature(F.lit("v2"), F.array(F.col("name"), F.lit("b"))).alias("signature"))


@query("SELECT hash, CASE WHEN is_video THEN uri || '@' || ts_ms ELSE uri END AS cover FROM photos")
def cover_keys(x: Library) -> DataFrame:
    return x.photos().select("hash", A.cover_key(F.col("uri"), F.col("is_video"), F.col("ts_ms")).alias("cover"))


@query("SELECT key, CASE key % 3 WHEN 0 THEN 'Internal storage/DCIM/Camera' WHEN 1 THEN 'Internal storage' ELSE '1A2B-3C/Pics' END AS path, CASE key % 3 WHEN 0 THEN 'DCIM/Camera/' END AS scan FROM file_names")
def display_paths(x: Library) -> DataFrame:
    uri = F.element_at(F.array(*(F.lit(f"content://x/tree/{t}") for t in ("primary%3ADCIM%2FCamera", "primary%3A", "1A2B-3C%3APics"))), (F.col("key") % 3 + 1).cast("int"))
    return x.file_names().select("key", A.display_path(uri).alias("path"), B.scan_path(uri).alias("scan"))


@query("SELECT key, year(t)::INTEGER AS year, month(t)::INTEGER AS month, day(t)::INTEGER AS day FROM (SELECT key, make_timestamp(taken_ms * 1000) + INTERVAL 330 MINUTE AS t FROM media_dates)")
def local_days(x: Library) -> DataFrame:
    return x.media_dates().select("key", D.year_month_day(F.col("taken_ms"), "Asia/Kolkata").alias("d")).select("key", "d.year", "d.month", "d.day")


@query("SELECT key, list_concat(['a', 'b', 'c', 'd', 'e'][p + 1:], ['a', 'b', 'c', 'd', 'e'][:p]) AS items FROM (SELECT key, (key * 2654435761 % 5)::INTEGER AS p FROM media_dates)")
def rotated_items(x: Library) -> DataFrame:
    return x.media_dates().select("key", S.rotated(F.array(*map(F.lit, "abcde")), F.col("key")).alias("items"))


@query("SELECT make_timestamp(taken_ms * 1000)::DATE AS day, count(*) AS n, list(key ORDER BY taken_ms, key) AS keys FROM media_dates GROUP BY 1")
def photo_days(x: Library) -> DataFrame:
    return A.consecutive_days(x.media_dates().select("key", F.col("taken_ms").alias("ms")))


@query("SELECT person AS key, ts_ms AS ms, CASE WHEN ts_ms - lm > 200 AND event_id > ln THEN (event_id - ln) * 1000::DOUBLE / (ts_ms - lm) END AS rate FROM (SELECT *, lag(ts_ms) OVER w AS lm, lag(event_id) OVER w AS ln FROM (SELECT person, ts_ms, max(event_id) AS event_id FROM (SELECT user_id AS person, epoch_us(ts::TIMESTAMP) // 1000 AS ts_ms, event_id FROM events) GROUP BY 1, 2) WINDOW w AS (PARTITION BY person ORDER BY ts_ms))")
def scan_throughput(x: Library) -> DataFrame:
    ticks = x.sightings().groupBy(F.col("person").alias("key"), F.col("ts_ms").alias("ms")).agg(F.max("event_id").alias("n"))
    return A.throughput(ticks)


@query("SELECT count(*) AS total, count(*) FILTER (k <> 3) AS processed, coalesce(sum(CASE WHEN k = 0 THEN greatest(key % 7, 1) END), 0)::BIGINT AS embedded, count(*) FILTER (k IN (1, 2)) AS skipped, count(*) FILTER (k = 2) AS failed FROM (SELECT key, key % 4 AS k FROM media_dates)")
def scan_totals(x: Library) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("embedded", "skipped", "failed", "waiting"))), (F.col("key") % 4 + 1).cast("int"))
    return A.scan_totals(x.media_dates().select(status.alias("status"), (F.col("key") % 7).alias("frames")))


# ---- similarity


@query(""", p AS (SELECT a.folder_id // 2 AS pair, a.ord AS ia, b.ord AS ib, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM idx a JOIN idx b ON b.folder_id = a.folder_id + 1 WHERE a.folder_id % 2 = 0),
x AS (SELECT pair, avg(s) AS s FROM (SELECT pair, ia, max(s) AS s, row_number() OVER (PARTITION BY pair ORDER BY max(s) DESC) AS r FROM p GROUP BY pair, ia) WHERE r <= 3 GROUP BY pair),
y AS (SELECT pair, avg(s) AS s FROM (SELECT pair, ib, max(s) AS s, row_number() OVER (PARTITION BY pair ORDER BY max(s) DESC) AS r FROM p GROUP BY pair, ib) WHERE r <= 3 GROUP BY pair)
SELECT x.pair, round(least(x.s, y.s), 6) AS score FROM x JOIN y USING (pair)""")
def mutual_matches(x: Library) -> DataFrame:
    side = lambda k: x.index().where(F.col("folder_id") % 2 == k).select(F.floor(F.col("folder_id") / 2).alias("pair"), F.col("ord").alias("id"), "embedding")
    return C.mutual_match(side(0), side(1)).select("pair", r6("score"))


@query("""SELECT ord, folder_id AS person, round(s, 6) AS score FROM (SELECT i.ord, c.folder_id, list_inner_product(i.embedding::DOUBLE[], c.v) AS s, row_number() OVER (PARTITION BY i.ord ORDER BY list_inner_product(i.embedding::DOUBLE[], c.v) DESC, c.folder_id) AS r
  FROM idx i, (SELECT folder_id, list(x / sqrt(q) ORDER BY k) AS v FROM (SELECT folder_id, k, sum(x) AS x, sum(sum(x) ^ 2) OVER (PARTITION BY folder_id) AS q FROM (SELECT folder_id, k, embedding[k]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM idx, generate_series(1, 64) AS g(k)) GROUP BY folder_id, k) GROUP BY folder_id) c) WHERE r = 1 AND s >= 0.1""")
def identified(x: Library) -> DataFrame:
    people = V.centroid(x.index(), "folder_id").select(F.col("folder_id").alias("person"), F.col("centroid").alias("embedding"))
    return C.identify(x.index().select("ord", "embedding"), people, 0.1).select("ord", "person", r6("score"))


@query("""SELECT media_key, CASE WHEN n = 2 AND k = 1 THEN 'duo' WHEN n <= 1 THEN 'solo' WHEN n <= 5 THEN 'group' ELSE 'crowd' END AS kind, round(r, 6) AS r, round(b, 6) AS b
FROM (SELECT media_key, count(*) AS n, count(person_id) - 1 AS k, max(box_r) AS r, max(box_b) AS b FROM faces GROUP BY media_key)""")
def photo_kinds(x: Library) -> DataFrame:
    box = lambda r, b: F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.col(r).alias("r"), F.col(b).alias("b"))
    g = x.faces().groupBy("media_key").agg(F.count(F.lit(1)).alias("n"), (F.count("person_id") - 1).alias("k"), F.max("box_r").alias("r"), F.max("box_b").alias("b"), F.min("box_r").alias("r0"), F.min("box_b").alias("b0"))
    both = M.joint_box(box("r", "b0"), box("r0", "b"))
    return g.select("media_key", M.photo_kind(F.col("n"), F.col("k")).alias("kind"), F.round(both["r"], 6).alias("r"), F.round(both["b"], 6).alias("b"))
