"""More queries of the media library: moments of people, small functions and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import dates as D
from orrery.functions import scalar as S
from orrery.operators import export as X
from orrery.operators import memories as M
from orrery.operators import moments as O
from orrery.operators import people as P
from orrery.operators import timeline as L
from orrery.plans.queries import _CANDIDATES, _COMPANIONS, _COUNTS, _MONTHS, _candidates, _people_candidates, query, r6
from orrery.sources.views import Library

_DATED = """, nf AS (SELECT media_key, count(*) AS n_faces FROM faces GROUP BY media_key),
dated AS (SELECT person_id, key, taken_ms, n_faces, suited FROM (SELECT person_id, key, taken_ms, n_faces, rank / (1 + 0.35::DOUBLE * greatest(n_faces - 1, 0)) AS suited,
  row_number() OVER (PARTITION BY person_id, key ORDER BY rank / (1 + 0.35::DOUBLE * greatest(n_faces - 1, 0)) DESC, c.id) AS r FROM confident c JOIN reliable ON key = c.media_key JOIN nf ON nf.media_key = c.media_key
  WHERE person_id IS NOT NULL AND c.media_key IN (SELECT hash FROM photos WHERE NOT is_video)) WHERE r = 1)
"""
_NOW = 1_009_843_200_000  # 2002-01-01


def _dated(x: Library) -> DataFrame:
    return O.dated_faces(x.faces(), x.photos(), x.media_dates())


@query(_DATED + "SELECT person_id, key, taken_ms, n_faces, round(suited, 6) AS suited FROM dated")
def person_dated_faces(x: Library) -> DataFrame:
    return _dated(x).select("person_id", "key", "taken_ms", "n_faces", r6("suited"))


@query(_COMPANIONS + """, t AS (SELECT month(make_timestamp(first_ms * 1000)) AS m, day(make_timestamp(first_ms * 1000)) AS d FROM best WHERE n >= 3 AND person % 4 <> 0 AND companion % 4 <> 0 ORDER BY person LIMIT 1),
due AS (SELECT least(person, companion) AS a, greatest(person, companion) AS b, 2002 - year(make_timestamp(first_ms * 1000)) AS years FROM best, t
  WHERE n >= 3 AND month(make_timestamp(first_ms * 1000)) = m AND day(make_timestamp(first_ms * 1000)) = d)
SELECT a, b, max(years)::INTEGER AS years FROM due WHERE years > 0 AND a IN (SELECT id FROM people WHERE name IS NOT NULL) AND b IN (SELECT id FROM people WHERE name IS NOT NULL) GROUP BY a, b""")
def anniversaries(x: Library) -> DataFrame:
    c = L.companions(L.groups(x.faces(), x.media_dates()))
    t = F.timestamp_millis("first_ms")
    today = c.where("n >= 3 and person % 4 <> 0 and companion % 4 <> 0").orderBy("person").limit(1).select(F.lit(2002).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"))
    return O.anniversaries(c, x.people(), today)


@query(_DATED + """, f AS (SELECT person_id, min(taken_ms) AS first_ms, count(*) AS n FROM dated GROUP BY person_id),
t AS (SELECT month(make_timestamp(first_ms * 1000)) AS m, day(make_timestamp(first_ms * 1000)) AS d FROM f WHERE person_id = 1),
e AS (SELECT f.person_id, first_ms, 2002 - year(make_timestamp(first_ms * 1000)) AS years FROM f, t WHERE n >= 20 AND month(make_timestamp(first_ms * 1000)) = m AND day(make_timestamp(first_ms * 1000)) = d
  AND (SELECT count(*) FROM dated x WHERE x.person_id = f.person_id AND x.taken_ms <= first_ms + 90 * 86400000::BIGINT) >= 3 AND f.person_id IN (SELECT id FROM people WHERE name IS NOT NULL)),
g AS (SELECT e.person_id, years, key, row_number() OVER (PARTITION BY e.person_id ORDER BY suited DESC, taken_ms, key) AS r FROM e JOIN dated d ON d.person_id = e.person_id WHERE taken_ms - first_ms <= 60 * 86400000::BIGINT AND years > 0)
SELECT person_id, years::INTEGER AS years, key FROM g WHERE r = 1""")
def person_anniversaries(x: Library) -> DataFrame:
    dated = _dated(x)
    t = F.timestamp_millis("ms")
    today = dated.where("person_id = 1").agg(F.min("taken_ms").alias("ms")).select(F.lit(2002).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"))
    return O.person_anniversaries(dated, x.people(), today)


@query(_DATED + _COUNTS + f""", s AS (SELECT id AS person_id, max(s) AS step FROM people JOIN c ON id = c.person_id, (SELECT unnest([50, 100, 250, 500, 1000, 2000, 5000, 10000]) AS s)
  WHERE name IS NOT NULL AND s <= n_media GROUP BY id), k AS (SELECT * FROM s WHERE step > CASE WHEN person_id % 3 = 0 THEN 500 ELSE 0 END),
g AS (SELECT d.person_id, step, key, row_number() OVER (PARTITION BY d.person_id ORDER BY taken_ms >= {_NOW} - 365 * 86400000::BIGINT DESC, suited DESC, taken_ms, key) AS r FROM dated d JOIN k ON k.person_id = d.person_id)
SELECT person_id, step, key FROM g WHERE r = 1""")
def milestone_pictures(x: Library) -> DataFrame:
    counts = P.person_counts(x.people(), x.faces())
    told = counts.where("id % 3 = 0").select(F.col("id").alias("person_id"), F.lit(500).alias("step"))
    return O.milestone_pictures(counts, told, _dated(x), _NOW)


@query(_DATED + f""", old AS (SELECT *, count(*) FILTER (n_faces = 1) OVER (PARTITION BY person_id) >= 3 AS alone, count(*) OVER (PARTITION BY person_id) AS n FROM dated
  WHERE taken_ms < {_NOW} - 300 * 86400000::BIGINT AND person_id IN (SELECT person_id FROM dated GROUP BY person_id HAVING count(*) >= 15) AND person_id IN (SELECT id FROM people WHERE name IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY suited DESC, taken_ms, key) - 1 AS place FROM old WHERE n >= 5 AND (NOT alone OR n_faces = 1)),
q AS (SELECT *, count(*) OVER (PARTITION BY person_id) AS top FROM p WHERE place < 5)
SELECT person_id, key FROM q WHERE place = 11688 % top""")
def vault(x: Library) -> DataFrame:
    return O.vault(_dated(x), x.people(), _NOW, 11688)


@query(_DATED + """, p AS (SELECT x.person_id AS a, y.person_id AS b, x.key, x.taken_ms FROM dated x JOIN dated y ON x.key = y.key AND x.person_id < y.person_id),
s AS (SELECT a, b, min(taken_ms) AS since_ms FROM (SELECT *, count(*) OVER (PARTITION BY a, b ORDER BY taken_ms RANGE BETWEEN CURRENT ROW AND 7776000000 FOLLOWING) AS near FROM p) WHERE near >= 3 GROUP BY a, b),
g AS (SELECT a, b, since_ms, count(*) AS n, (max(taken_ms) - since_ms) / (365.0::DOUBLE * 86400000) AS span FROM p JOIN s USING (a, b) WHERE taken_ms >= since_ms GROUP BY a, b, since_ms)
SELECT a, b, since_ms, n, greatest(1, round(span))::INTEGER AS years FROM g WHERE span >= 1""")
def together_since(x: Library) -> DataFrame:
    d = _dated(x)
    a, b = (d.select(F.col("person_id").alias(n), "key", "taken_ms") for n in "ab")
    return O.together_since(a.join(b, ["key", "taken_ms"]).where("a < b"))


@query(_CANDIDATES + """, days AS (SELECT key, ms // 86400000 AS day, score, ms FROM cand), full_ AS (SELECT day, count(*) AS n, day - row_number() OVER (ORDER BY day) AS island FROM days GROUP BY day),
runs AS (SELECT min(day) AS first_day, max(day) AS last_day FROM full_ GROUP BY island HAVING count(*) >= 3 AND sum(n) >= 6),
wanted AS (SELECT DISTINCT first_day, unnest([first_day, (first_day + last_day) // 2, last_day]) AS day FROM runs)
SELECT first_day::INTEGER AS first_day, day::INTEGER AS day, key FROM (SELECT first_day, day, key, row_number() OVER (PARTITION BY first_day, day ORDER BY score DESC, ms, key) AS r FROM days JOIN wanted USING (day)) WHERE r = 1""")
def trip_photos(x: Library) -> DataFrame:
    days = _candidates(x).select("key", D.day_number(F.col("ms")).alias("day"), "score", "ms")
    runs = M.trips(days.groupBy("day").agg(F.count(F.lit(1)).alias("n")), 3, 1, 6)
    return O.trip_photos(days, runs).select(F.col("first_day").cast("int").alias("first_day"), F.col("day").cast("int").alias("day"), "key")


@query(_COUNTS + """, p AS (SELECT id, name, row_number() OVER (ORDER BY name IS NOT NULL DESC, n_media DESC, id) AS place FROM people JOIN c ON id = person_id)
SELECT id FROM p WHERE place <= 8 AND (name IS NOT NULL OR (SELECT count(*) FROM p WHERE place <= 8 AND name IS NOT NULL) < 4)""")
def moment_circle(x: Library) -> DataFrame:
    return O.moment_circle(P.person_counts(x.people(), x.faces()))


@query(_MONTHS + """, m AS (SELECT person_id AS id, min(month) AS first_month, max(month) AS last_month, sum(n)::BIGINT AS n FROM months GROUP BY person_id),
r AS (SELECT f.id, p.name, first_month, last_month, coalesce(n, 0) AS n FROM (SELECT DISTINCT person_id AS id FROM faces WHERE person_id IS NOT NULL) f JOIN people p ON p.id = f.id LEFT JOIN m ON m.id = f.id)
SELECT id, row_number() OVER (ORDER BY first_month NULLS LAST, n DESC, id)::INTEGER AS earliest, row_number() OVER (ORDER BY last_month DESC NULLS LAST, n DESC, id)::INTEGER AS recent,
  row_number() OVER (ORDER BY n DESC, id)::INTEGER AS most, row_number() OVER (ORDER BY lower(name) NULLS LAST, n DESC, id)::INTEGER AS name FROM r""")
def timeline_rows_sorted(x: Library) -> DataFrame:
    months = L.timeline_months(x.faces(), x.media_dates()).groupBy("person_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.sum("n").alias("n"))
    own = x.faces().where("person_id is not null").select(F.col("person_id").alias("id")).distinct()
    rows = own.join(x.people().select("id", "name"), "id").join(months, F.col("id") == F.col("person_id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = lambda o: F.row_number().over(Window.orderBy(*O.timeline_order(rows, o))).alias(o)
    return rows.select("id", *map(place, ("earliest", "recent", "most", "name")))


@query(""", c AS (SELECT 'c' || folder_id AS id, list(ord ORDER BY ord)[1:6] AS covers, folder_id FROM idx GROUP BY folder_id)
SELECT id, [covers[(19700 + 99 + 48 + folder_id + k) % 6 + 1] FOR k IN [0, 1, 2]] AS covers FROM c""")
def daily_covers(x: Library) -> DataFrame:
    covers = F.slice(F.sort_array(F.collect_list("ord")), 1, 6)
    return O.daily_covers(x.index().groupBy("folder_id").agg(covers.alias("covers")).select(F.concat(F.lit("c"), "folder_id").alias("id"), "covers"), 19700)


@query(""", c AS (SELECT folder_id AS id, folder_id % 2 = 0 AS built_in, CASE WHEN folder_id = 3 THEN 1 ELSE 0 END AS hidden, count(*) AS n FROM idx GROUP BY folder_id)
SELECT id, n, row_number() OVER (ORDER BY built_in, CASE WHEN built_in THEN -n ELSE 0 END, id)::INTEGER AS place FROM c WHERE hidden = 0""")
def shown_collections(x: Library) -> DataFrame:
    c = x.index().groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("built_in", F.col("id") % 2 == 0).withColumn("hidden", F.when(F.col("id") == 3, 1).otherwise(0)).withColumn("ord", F.col("id"))
    return O.shown_collections(c).select("id", "n", "place")


@query(""", s AS (SELECT kind AS video, person, list_sort(list(DISTINCT ts_ms)) AS times FROM sightings GROUP BY 1, 2)
SELECT video, person, times FROM s WHERE person IN (SELECT id FROM people WHERE NOT hidden) AND (person IN (SELECT id FROM listed) OR len(times) >= 2)""")
def video_people(x: Library) -> DataFrame:
    return O.video_people(x.sightings().select(F.col("kind").alias("video"), "ts_ms", "person"), x.people(), x.faces())


_DURATION = "(o_orderkey * 997) % 200000"


@query(f""", d AS (SELECT o_orderkey AS key, {_DURATION} AS dur FROM orders), n AS (SELECT *, CASE WHEN dur < 10000 THEN 3 WHEN dur < 30000 THEN 5 WHEN dur < 120000 THEN 8 ELSE 10 END AS n FROM d)
SELECT key, i::INTEGER AS at, dur * (2 * i + 1) // (2 * n) AS ms FROM (SELECT key, dur, n, unnest(range(n)) AS i FROM n)""")
def video_frame_times(x: Library) -> DataFrame:
    rows = x.table("orders").select(F.col("o_orderkey").alias("key"), F.expr(_DURATION).alias("dur"))
    return rows.select("key", F.posexplode(S.frame_times(F.col("dur"))).alias("at", "ms"))


@query(f""", d AS (SELECT o_orderkey AS key, {_DURATION} AS dur FROM orders), n AS (SELECT *, least(30, greatest(3, dur // 2000)) AS n FROM d)
SELECT key, i::INTEGER AS at, dur * (2 * i + 1) // (2 * n) AS ms FROM (SELECT key, dur, n, unnest(range(n)) AS i FROM n)""")
def video_sample_times(x: Library) -> DataFrame:
    rows = x.table("orders").select(F.col("o_orderkey").alias("key"), F.expr(_DURATION).alias("dur"))
    return rows.select("key", F.posexplode(S.sample_times(F.col("dur"))).alias("at", "ms"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 = 0 THEN 'Export.zip' ELSE 'Export - part ' || (o_orderkey % 3 + 1) || ' of 3.zip' END AS name FROM orders""")
def zip_file_names(x: Library) -> DataFrame:
    n = F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(3)
    return x.table("orders").select(F.col("o_orderkey").alias("key"), X.part_name(F.lit("Export"), F.col("o_orderkey") % 3, n).alias("name"))


@query("""SELECT s_suppkey AS a, 'pair:' || least(s_suppkey, s_nationkey) || '-' || greatest(s_suppkey, s_nationkey) AS pair FROM supplier""")
def pair_subjects(x: Library) -> DataFrame:
    return x.table("supplier").select(F.col("s_suppkey").alias("a"), S.pair_key(F.col("s_suppkey"), F.col("s_nationkey")).alias("pair"))


@query("""SELECT key, CASE WHEN left_ > 0 THEN left_ ELSE left_ + 86400000 END AS delay FROM (SELECT key, 32400000 - taken_ms % 86400000 AS left_ FROM media_dates)""")
def schedule_delay(x: Library) -> DataFrame:
    return x.media_dates().select("key", D.delay_until(F.col("taken_ms"), 9, 0).cast("long").alias("delay"))


@query("""SELECT m AS key, CASE WHEN m = 0 THEN '0 months' ELSE trim(CASE WHEN m // 12 = 1 THEN '1 year ' WHEN m // 12 > 1 THEN (m // 12) || ' years ' ELSE '' END ||
  CASE WHEN m // 12 >= 5 THEN '' WHEN m % 12 = 1 THEN '1 month' WHEN m % 12 > 1 THEN (m % 12) || ' months' ELSE '' END) END AS words FROM (SELECT unnest(range(100)) AS m)""")
def span_words(x: Library) -> DataFrame:
    return x.spark.range(100).select(F.col("id").alias("key"), S.span_words(F.col("id")).alias("words"))


@query("""SELECT s_suppkey AS id, round(least(s_acctbal, 200) * (1 - 0.5::DOUBLE * least(s_nationkey / 20, 1)) * 0.9, 6) AS rank FROM supplier""")
def face_ranks(x: Library) -> DataFrame:
    return x.table("supplier").select(F.col("s_suppkey").alias("id"), F.round(S.face_rank(F.col("s_acctbal"), F.lit(0.9), F.col("s_nationkey") / 20), 6).alias("rank"))


@query()
def pair_then_now(x: Library) -> DataFrame:
    c = _people_candidates(x)
    a, b = (c.select(F.col("person_id").alias(n), "key", "ms", "month", F.col("score").alias(f"s{n}")) for n in "ab")
    both = a.join(b, ["key", "ms", "month"]).where("a < b").select((F.col("a") * 1_000_000 + F.col("b")).alias("person_id"), "key", "ms", "month", (F.col("sa") + F.col("sb")).alias("score"))
    return M.then_and_now(both)


@query("SELECT key FROM media_dates WHERE src = 0 ORDER BY key LIMIT 300")
def pending_dates(x: Library) -> DataFrame:
    return x.media_dates().where("src = 0").select("key").orderBy("key").limit(300)


@query("SELECT f.id, media_key, rank FROM faces f WHERE deferred AND media_key = (SELECT min(media_key) FROM faces WHERE deferred)")
def deferred_faces(x: Library) -> DataFrame:
    rows = x.faces().where("deferred")
    return rows.join(F.broadcast(rows.agg(F.min("media_key").alias("media_key"))), "media_key", "left_semi").select("id", "media_key", "rank")


@query("SELECT f.id, uri, ts_ms, rank FROM faces f JOIN photos ON hash = media_key WHERE f.id = (SELECT min(id) FROM faces)")
def face_location(x: Library) -> DataFrame:
    one = x.faces().agg(F.min("id").alias("id"))
    return x.faces().join(F.broadcast(one), "id", "left_semi").join(x.photos(), F.col("media_key") == F.col("hash")).select("id", "uri", "ts_ms", "rank")


@query("""SELECT media_key, id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY rank DESC, id) AS place FROM faces WHERE good) WHERE place <= 2""")
def frame_faces_top(x: Library) -> DataFrame:
    order = Window.partitionBy("media_key").orderBy(F.desc("rank"), "id")
    return x.faces().where("good").withColumn("place", F.row_number().over(order)).where("place <= 2").select("media_key", "id", "place")


@query("SELECT f.id, person_id, rank, box_l, box_t, box_r, box_b FROM faces f JOIN photos ON hash = media_key WHERE uri = 'uri7' AND NOT is_video AND NOT deferred AND person_id IS NOT NULL")
def photo_faces(x: Library) -> DataFrame:
    photo = x.photos().where("uri = 'uri7' and not is_video")
    own = x.faces().where("not deferred and person_id is not null")
    return own.join(photo, F.col("media_key") == F.col("hash"), "left_semi").select("id", "person_id", "rank", "box_l", "box_t", "box_r", "box_b")


@query("SELECT f.id, person_id, name, rank FROM faces f JOIN photos ON hash = media_key JOIN people p ON p.id = person_id WHERE is_video AND uri = 'uri10' AND ts_ms = 0")
def video_frame_faces(x: Library) -> DataFrame:
    frame = x.photos().where("is_video and uri = 'uri10' and ts_ms = 0")
    own = x.faces().join(frame, F.col("media_key") == F.col("hash"), "left_semi")
    return own.join(x.people().select(F.col("id").alias("person"), "name"), F.col("person_id") == F.col("person")).select("id", "person_id", "name", "rank")


@query("SELECT person_id, ts_ms FROM faces JOIN photos ON hash = media_key WHERE is_video AND uri = 'uri20' AND person_id IS NOT NULL")
def video_sightings(x: Library) -> DataFrame:
    video = x.photos().where("is_video and uri = 'uri20'")
    return x.faces().where("person_id is not null").join(video, F.col("media_key") == F.col("hash")).select("person_id", "ts_ms")


@query("SELECT id FROM faces WHERE person_id = 3")
def face_ids_of_person(x: Library) -> DataFrame:
    return x.faces().where("person_id = 3").select("id")


@query("SELECT id, person_id, rank FROM faces WHERE person_id = 3 AND good")
def person_good_faces(x: Library) -> DataFrame:
    return x.faces().where("person_id = 3 and good").select("id", "person_id", "rank")


@query("SELECT id, name FROM people WHERE trim(name) <> ''")
def names_of_people(x: Library) -> DataFrame:
    return x.people().where("trim(name) <> ''").select("id", "name")


@query("SELECT count(DISTINCT hash) AS videos FROM photos WHERE is_video AND hash IN (SELECT media_key FROM faces)")
def video_count(x: Library) -> DataFrame:
    scanned = x.photos().where("is_video").join(x.faces(), F.col("hash") == F.col("media_key"), "left_semi")
    return scanned.agg(F.countDistinct("hash").alias("videos"))
