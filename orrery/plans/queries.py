"""Queries of the media library by name, each with the SQL that a second engine compares it with.

Doubles are rounded to six places in results, never before they are compared or ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import dates as D
from orrery.functions import scalar as S
from orrery.operators import export as X
from orrery.operators import memories as M
from orrery.operators import people as P
from orrery.operators import state as U
from orrery.operators import text as Q
from orrery.operators import timeline as L
from orrery.operators import vector as V
from orrery.shipping import ship
from orrery.sources.views import SQL_VIEWS, Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CHOSEN = [1, 2]


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a Library; sql follows the views' WITH list."""

    def put(f: Callable[[Library], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Library(spark, sf_dir))

        QUERIES[name or f.__name__] = run
        if sql:
            SQL[name or f.__name__] = f"{SQL_VIEWS}{sql}"
        return f

    return put


def r6(x: str) -> F.Column:
    return F.round(x, 6).alias(x)


def _vector(x: Library, ord_: int) -> DataFrame:
    return x.index().where(F.col("ord") == ord_).select(F.col("embedding").alias("q"))


_SCORED = """, q AS (SELECT embedding AS q FROM idx WHERE ord = {ord}),
scored AS (SELECT ord, media_key, is_video, folder_id, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM idx, q),
best AS (SELECT ord, media_key, score FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY score DESC, ord) AS n FROM scored {where}) WHERE n = 1)
"""


# ---- vector search


@query(_SCORED.format(ord=7, where="") + "SELECT ord, media_key, round(score, 6) AS score FROM best ORDER BY best.score DESC, ord LIMIT 10")
def knn_topk(x: Library) -> DataFrame:
    return V.knn(x.index(), _vector(x, 7), 10).select("ord", "media_key", r6("score"))


@query(_SCORED.format(ord=7, where="WHERE NOT is_video") + "SELECT ord, media_key, round(score, 6) AS score FROM best ORDER BY best.score DESC, ord LIMIT 10")
def knn_images_only(x: Library) -> DataFrame:
    return V.knn(x.index(), _vector(x, 7), 10, "images").select("ord", "media_key", r6("score"))


@query(_SCORED.format(ord=7, where="WHERE is_video") + "SELECT ord, media_key, round(score, 6) AS score FROM best ORDER BY best.score DESC, ord LIMIT 10")
def knn_videos_only(x: Library) -> DataFrame:
    return V.knn(x.index(), _vector(x, 7), 10, "videos").select("ord", "media_key", r6("score"))


@query(_SCORED.format(ord=7, where="WHERE media_key IN (SELECT media_key FROM idx WHERE folder_id = 3)") + "SELECT ord, media_key, round(score, 6) AS score FROM best ORDER BY best.score DESC, ord LIMIT 10")
def knn_path_filtered(x: Library) -> DataFrame:
    return V.knn(x.index(), _vector(x, 7), 10, keys=x.index().where("folder_id = 3")).select("ord", "media_key", r6("score"))


@query(_SCORED.format(ord=9, where="") + """, top AS (SELECT * FROM best ORDER BY score DESC, ord LIMIT 13)
SELECT ord, media_key, round(score, 6) AS score FROM top WHERE media_key <> (SELECT media_key FROM idx WHERE ord = 9) ORDER BY top.score DESC, ord LIMIT 10""")
def similar_excluding_self(x: Library) -> DataFrame:
    return V.similar(x.index(), 9).select("ord", "media_key", r6("score"))


@query(""", s AS (SELECT q.ord AS query, i.ord, list_inner_product(i.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM idx i, idx q WHERE q.ord % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS n FROM s)
SELECT query, ord, round(score, 6) AS score FROM r WHERE n <= 5""")
def knn_many_queries(x: Library) -> DataFrame:
    asked = x.index().where("ord % 50 = 0").select(F.col("ord").alias("query"), F.col("embedding").alias("q"))
    return V.knn_many(x.index(), asked, 5).select("query", "ord", r6("score"))


def _specs(x: Library) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("all"), F.lit("images"), F.lit("videos")), (F.col("ord") % 3 + 1).cast("int"))
    return x.index().where("ord < 6").select(F.col("ord").alias("spec_id"), F.col("embedding").alias("q"), F.lit(1.5).alias("k"), kinds.alias("content"), (F.col("ord") == 5).alias("unlimited"))


_MEMBERS = """, specs AS (SELECT ord AS spec_id, embedding AS q, 1.5 AS k, ['all', 'images', 'videos'][ord % 3 + 1] AS content, ord = 5 AS unlimited FROM idx WHERE ord < 6),
scored AS (SELECT spec_id, k, unlimited, ord, media_key, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM idx, specs
  WHERE content = 'all' OR (content = 'videos') = is_video),
stats AS (SELECT spec_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS dev FROM scored GROUP BY spec_id),
members AS (SELECT spec_id, ord, media_key, score FROM (SELECT s.*, row_number() OVER (PARTITION BY spec_id, media_key ORDER BY score DESC, ord) AS r
  FROM scored s JOIN stats USING (spec_id) WHERE unlimited OR (n >= 2 AND dev >= 1e-6 AND score >= mean + k * dev)) WHERE r = 1)
"""


@query(_MEMBERS + "SELECT spec_id, ord, media_key, round(score, 6) AS score FROM members")
def zscore_members(x: Library) -> DataFrame:
    return V.collection_members(x.index(), _specs(x)).select("spec_id", "ord", "media_key", r6("score"))


@query(_MEMBERS + """SELECT spec_id, count(*) AS members, list(ord ORDER BY score DESC, ord)[1:6] AS covers FROM members GROUP BY spec_id""")
def zscore_counts_covers(x: Library) -> DataFrame:
    return V.collection_summary(V.collection_members(x.index(), _specs(x)))


@query(""", parts AS (SELECT folder_id, i, sum(embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x
  FROM idx, generate_series(1, 64) AS g(i) GROUP BY folder_id, i)
SELECT folder_id, (i - 1)::INTEGER AS at, round(x / sqrt(sum(x * x) OVER (PARTITION BY folder_id)), 6) AS x FROM parts""")
def prompt_centroid(x: Library) -> DataFrame:
    return V.centroid(x.index(), "folder_id").select("folder_id", F.posexplode("centroid").alias("at", "x")).select("folder_id", "at", r6("x"))


@query("SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN NOT is_video THEN media_key END) AS images, count(DISTINCT CASE WHEN is_video THEN media_key END) AS videos FROM idx")
def library_stats(x: Library) -> DataFrame:
    return V.library_stats(x.index())


@query("SELECT folder_id, count(*) AS n, count(*) FILTER (is_video) AS frames FROM idx GROUP BY folder_id")
def folder_counts(x: Library) -> DataFrame:
    return V.folder_counts(x.index())


@query(""", s AS (SELECT 'w' || w.ord AS word, list_inner_product(i.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS score FROM idx i, idx w WHERE i.ord = 0 AND w.ord BETWEEN 10 AND 29),
t AS (SELECT * FROM s ORDER BY score DESC, word LIMIT 3)
SELECT word, round(score, 6) AS score, round(greatest(0, least(1, score / max(score) OVER ())), 6) AS bar FROM t""")
def explain_words(x: Library) -> DataFrame:
    words = x.index().where("ord between 10 and 29").select(F.concat(F.lit("w"), "ord").alias("word"), F.col("embedding").alias("q"))
    return V.word_scores(x.index(), 0, words).select("word", r6("score"), r6("bar"))


@query("SELECT hash, uri FROM photos WHERE hash NOT IN (SELECT media_key FROM faces)")
def new_files_antijoin(x: Library) -> DataFrame:
    return V.new_files(x.photos(), x.faces().select(F.col("media_key").alias("hash"))).select("hash", "uri")


@query("SELECT media_key, min(ord) AS ord FROM idx GROUP BY media_key")
def indexed_media(x: Library) -> DataFrame:
    return V.first_by(x.index(), ["media_key"], "ord").select("media_key", "ord")


@query("SELECT ord, folder_id, timestamp_ms FROM idx WHERE media_key = (SELECT min(media_key) FROM idx WHERE is_video) AND is_video AND timestamp_ms = 1000 LIMIT 1")
def find_embedding(x: Library) -> DataFrame:
    first = x.index().where("is_video").agg(F.min("media_key").alias("first"))
    found = x.index().where("is_video and timestamp_ms = 1000").join(F.broadcast(first), F.col("media_key") == F.col("first"))
    return found.select("ord", "folder_id", "timestamp_ms").limit(1)


@query("SELECT ord, media_key, media_key IN (SELECT media_key FROM idx WHERE folder_id = 1) AS fresh FROM idx")
def latest_scan_first(x: Library) -> DataFrame:
    return V.new_first(x.index(), x.index().where("folder_id = 1")).select("ord", "media_key", "fresh")


# ---- people

_COUNTS = ", c AS (SELECT person_id, count(*) AS n_faces, count(DISTINCT media_key) AS n_media FROM faces WHERE person_id IS NOT NULL GROUP BY person_id)\n"


@query(_COUNTS + "SELECT id, name, n_faces, n_media FROM people JOIN c ON id = person_id WHERE NOT hidden AND n_media >= 2")
def list_people(x: Library) -> DataFrame:
    return P.list_people(x.people(), x.faces())


@query(_COUNTS + "SELECT id, name, n_faces, n_media FROM people JOIN c ON id = person_id WHERE hidden AND n_media >= 2")
def list_hidden_people(x: Library) -> DataFrame:
    return P.list_people(x.people(), x.faces(), hidden=True)


@query(_COUNTS + "SELECT id, name, n_faces, n_media FROM people JOIN c ON id = person_id WHERE id = 3")
def person_summary(x: Library) -> DataFrame:
    return P.person_summary(x.people(), x.faces(), 3)


@query(_COUNTS + "SELECT id, name, n_faces, n_media, row_number() OVER (ORDER BY name IS NULL, lower(name), n_media DESC, id)::INTEGER AS place FROM people JOIN c ON id = person_id")
def people_by_name(x: Library) -> DataFrame:
    found = P.person_counts(x.people(), x.faces())
    order = Window.orderBy(F.col("name").isNull(), F.lower("name"), F.desc("n_media"), "id")
    return P.sort_people(found, "name").select("id", "name", "n_faces", "n_media", F.row_number().over(order).alias("place"))


@query("SELECT id, name FROM people WHERE contains(lower(name), '01')")
def people_name_search(x: Library) -> DataFrame:
    return x.people().where(F.contains(F.lower("name"), F.lit("01"))).select("id", "name")


@query("SELECT media_key, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY rank DESC, id) AS n FROM faces WHERE person_id = 2) WHERE n = 1")
def person_media_best(x: Library) -> DataFrame:
    return P.person_media(x.faces(), 2)


_HITS = """, h AS (SELECT media_key, count(DISTINCT person_id) FILTER (person_id IN (1, 2)) AS n, count(*) FILTER (coalesce(person_id NOT IN (1, 2), true)) AS others,
  max(rank) FILTER (person_id IN (1, 2)) AS rank FROM faces GROUP BY media_key)
"""


@query(_HITS + "SELECT media_key, rank FROM h WHERE n > 0")
def people_any(x: Library) -> DataFrame:
    return P.people_media(x.faces(), CHOSEN, "any")


@query(_HITS + "SELECT media_key, rank FROM h WHERE n = 2")
def people_together(x: Library) -> DataFrame:
    return P.people_media(x.faces(), CHOSEN, "together")


@query(_HITS.replace("(1, 2)", "(1)") + "SELECT media_key, rank FROM h WHERE n = 1 AND others = 0")
def people_only(x: Library) -> DataFrame:
    return P.people_media(x.faces(), [1], "only")


@query(_HITS + "SELECT count(*) AS n_any, count(*) FILTER (n = 2) AS n_together, count(*) FILTER (n = 2 AND others = 0) AS n_only FROM h WHERE n > 0")
def people_counts(x: Library) -> DataFrame:
    return P.people_counts(x.faces(), CHOSEN)


@query(""", two AS (SELECT min(person_id) AS a, max(person_id) AS b FROM confident JOIN reliable ON key = media_key JOIN photos ON hash = media_key WHERE NOT is_video GROUP BY media_key HAVING count(DISTINCT person_id) >= 2 ORDER BY media_key LIMIT 1),
k AS (SELECT media_key FROM confident WHERE person_id = (SELECT a FROM two) INTERSECT SELECT media_key FROM confident WHERE person_id = (SELECT b FROM two))
SELECT media_key, uri, taken_ms, (SELECT count(*) FROM faces f WHERE f.media_key = k.media_key) AS n_faces FROM k JOIN photos ON hash = media_key JOIN reliable ON key = media_key WHERE NOT is_video""")
def pair_photos(x: Library) -> DataFrame:
    """For the first two people of the first photo that shows several."""
    rows = P.confident(x.faces()).join(P.reliable(x.media_dates()), F.col("media_key") == F.col("key")).join(x.photos().where("not is_video"), F.col("media_key") == F.col("hash"))
    some = rows.groupBy("media_key").agg(F.min("person_id").alias("a"), F.max("person_id").alias("b")).where("a < b").orderBy("media_key").first()
    return P.pair_photos(x.faces(), x.photos(), x.media_dates(), *((some.a, some.b) if some else (0, 0)))


@query("""SELECT person_id AS id, count(DISTINCT media_key) AS n_media, min(taken_ms) AS first_ms, max(taken_ms) AS last_ms FROM confident JOIN reliable ON key = media_key
WHERE person_id IN (SELECT id FROM listed WHERE name IS NOT NULL) AND media_key IN (SELECT hash FROM photos WHERE NOT is_video) GROUP BY person_id""")
def person_stats(x: Library) -> DataFrame:
    return P.person_stats(x.people(), x.faces(), x.photos(), x.media_dates())


@query(""", w AS (SELECT media_key, rank * CASE WHEN id IN (SELECT id FROM confident) THEN 1.0 ELSE 0.3 END::DOUBLE AS w FROM faces WHERE person_id IS NOT NULL)
SELECT media_key, round(sum(w), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY w DESC) AS n FROM w) WHERE n <= 3 GROUP BY media_key""")
def face_scores(x: Library) -> DataFrame:
    return P.face_scores(x.faces()).select("media_key", r6("score"))


@query("SELECT person_id, id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY good DESC, rank DESC, id) AS n FROM faces WHERE person_id IS NOT NULL) WHERE n = 1")
def best_face(x: Library) -> DataFrame:
    return P.best_faces(x.faces())


@query(""", b AS (SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY good DESC, rank DESC, id) AS n FROM faces WHERE person_id IS NOT NULL)
SELECT person_id, id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY rank DESC, id) AS place FROM faces
  WHERE person_id IS NOT NULL AND id NOT IN (SELECT id FROM b WHERE n = 1)) WHERE place <= 2""")
def stack_faces(x: Library) -> DataFrame:
    return P.stack_faces(x.faces(), P.best_faces(x.faces()))


@query(""", own AS (SELECT f.*, s_suppkey * 11 + 1 AS cover, s_suppkey % 9 AS had FROM faces f JOIN supplier ON s_suppkey = person_id),
c AS (SELECT person_id, count(*) AS n, bool_or(id = cover) AS valid, min(cover) AS cover, min(had) AS had FROM own GROUP BY person_id),
pool AS (SELECT person_id, max(id) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY good DESC, rank DESC, id) AS p FROM own WHERE id <> cover) WHERE p <= 8 GROUP BY person_id)
SELECT person_id, CASE WHEN valid AND n - had < greatest(5, had // 6) THEN cover ELSE coalesce(newest, cover) END AS cover,
  CASE WHEN valid AND n - had < greatest(5, had // 6) THEN had ELSE n END AS cover_count FROM c LEFT JOIN pool USING (person_id)""")
def next_covers(x: Library) -> DataFrame:
    covers = x.table("supplier").select(F.col("s_suppkey").alias("person_id"), (F.col("s_suppkey") * 11 + 1).alias("cover"), (F.col("s_suppkey") % 9).alias("cover_count"))
    return P.next_covers(x.faces(), covers)


@query("SELECT media_key, count(*) AS n FROM faces WHERE deferred GROUP BY media_key")
def deferred_counts(x: Library) -> DataFrame:
    return P.deferred_photos(x.faces())


@query("SELECT DISTINCT media_key, uri FROM faces JOIN photos ON hash = media_key WHERE person_id IS NOT NULL AND media_key NOT IN (SELECT key FROM media_dates WHERE src <> 0)")
def missing_dates(x: Library) -> DataFrame:
    return P.missing_dates(x.faces(), x.photos(), x.media_dates().where("src <> 0"))


@query("SELECT count(*) AS n_media, count(*) FILTER (media_key NOT IN (SELECT key FROM media_dates WHERE src <> 0)) AS n_missing FROM (SELECT DISTINCT media_key FROM faces WHERE person_id IS NOT NULL)")
def date_progress(x: Library) -> DataFrame:
    return P.date_progress(x.faces(), x.media_dates().where("src <> 0"))


@query(""", o AS (SELECT media_key, person_id, name, f.id, rank, row_number() OVER (PARTITION BY media_key, person_id ORDER BY rank DESC, f.id) AS n FROM confident f JOIN listed p ON p.id = person_id
  WHERE name IS NOT NULL AND media_key IN (SELECT hash FROM photos WHERE NOT is_video))
SELECT media_key, list(name ORDER BY rank DESC, id) AS names FROM o WHERE n = 1 GROUP BY media_key""")
def names_in_media(x: Library) -> DataFrame:
    return P.names_in(x.people(), x.faces(), x.photos())


@query(""", w AS (SELECT person_id, media_key, taken_ms, id, rank * CASE WHEN id IN (SELECT id FROM confident) THEN 1.0 ELSE 0.3 END::DOUBLE AS weight FROM faces JOIN reliable ON key = media_key
  WHERE person_id IS NOT NULL AND taken_ms >= 852076800000 AND taken_ms < 883612800000)
SELECT person_id, media_key, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY weight DESC, taken_ms, id) AS n FROM w) WHERE n = 1""")
def person_photos_between(x: Library) -> DataFrame:
    return P.person_photos_between(x.faces(), x.media_dates(), 852076800000, 883612800000).select("person_id", "media_key", r6("weight"))


@query(""", c AS (SELECT a.ord AS a, b.ord AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM idx a JOIN idx b ON a.ord < b.ord)
SELECT a, b, round(s, 6) AS similarity FROM c WHERE s >= 0.45 AND NOT (a % 10 = 0 AND b = a + 1) AND a // 3 <> b // 3""")
def merge_suggestion_pairs(x: Library) -> DataFrame:
    groups = x.index().select(F.col("ord").alias("id"), F.col("embedding").alias("centroid"))
    rejected = x.index().where("ord % 10 = 0").select(F.col("ord").alias("a"), (F.col("ord") + 1).alias("b"))
    in_one = x.index().select(F.floor(F.col("ord") / 3).alias("picture"), "ord")
    a, b = (in_one.select("picture", F.col("ord").alias(n)) for n in "ab")
    return P.merge_suggestions(groups, rejected, a.join(b, "picture").where("a < b").select("a", "b"), 0.45).select("a", "b", r6("similarity"))


@query(""", s AS (SELECT kind AS video, ts_ms, person FROM sightings)
SELECT a.video, a.ts_ms, list_sort(list(DISTINCT b.person)) AS people FROM s a JOIN s b ON a.video = b.video AND b.ts_ms BETWEEN a.ts_ms AND a.ts_ms + 600000 GROUP BY a.video, a.ts_ms""")
def video_together(x: Library) -> DataFrame:
    return P.together_within(x.sightings().select(F.col("kind").alias("video"), "ts_ms", "person"), 600_000)


@query("SELECT DISTINCT person_id FROM faces WHERE person_id IN (SELECT id FROM listed)")
def listed_people_ids(x: Library) -> DataFrame:
    return P.listed(x.people(), x.faces()).select(F.col("id").alias("person_id"))


@query("SELECT hash, uri, count(f.id) AS n FROM photos LEFT JOIN faces f ON media_key = hash WHERE is_video GROUP BY hash, uri")
def video_face_counts(x: Library) -> DataFrame:
    videos = x.photos().where("is_video")
    return videos.join(x.faces(), F.col("media_key") == F.col("hash"), "left").groupBy("hash", "uri").agg(F.count("id").alias("n"))


# ---- timeline

_GROUPS = ", g AS (SELECT media_key, taken_ms AS ms, list_sort(list(DISTINCT person_id)) AS people FROM confident JOIN reliable ON key = media_key WHERE person_id IS NOT NULL GROUP BY media_key, taken_ms)\n"
_MONTHS = """, months AS (SELECT person_id, (year(make_timestamp(taken_ms * 1000)) * 12 + month(make_timestamp(taken_ms * 1000)) - 1)::INTEGER AS month, count(*) AS n
  FROM (SELECT DISTINCT person_id, media_key FROM confident WHERE person_id IS NOT NULL) JOIN reliable ON key = media_key GROUP BY 1, 2)
"""


@query(_MONTHS + "SELECT * FROM months")
def timeline_months(x: Library) -> DataFrame:
    return L.timeline_months(x.faces(), x.media_dates())


@query("SELECT person_id, count(key) AS dated, count(*) - count(key) AS undated FROM (SELECT DISTINCT person_id, media_key FROM faces WHERE person_id IS NOT NULL) LEFT JOIN reliable ON key = media_key GROUP BY person_id")
def timeline_coverage(x: Library) -> DataFrame:
    return L.timeline_coverage(x.faces(), x.media_dates())


_COMPANIONS = _GROUPS + """, e AS (SELECT media_key, ms, len(people) AS k, unnest(people) AS a FROM g),
p AS (SELECT e.a AS person, f.a AS companion, count(*) AS n, min((e.ms, e.media_key)) AS first FROM e JOIN e f ON e.media_key = f.media_key AND e.a <> f.a WHERE e.k BETWEEN 2 AND 12 GROUP BY 1, 2),
best AS (SELECT person, companion, n, first[1] AS first_ms, first[2] AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, first[1], companion) AS r FROM p) WHERE r = 1)
"""


@query(_COMPANIONS + "SELECT * FROM best")
def companions(x: Library) -> DataFrame:
    return L.companions(L.groups(x.faces(), x.media_dates()))


@query(_COMPANIONS + "SELECT person, companion, least(60, 20 + round(8 * log2(n)))::INTEGER AS importance FROM best WHERE n >= 3")
def companion_importance(x: Library) -> DataFrame:
    return L.companion_importance(L.companions(L.groups(x.faces(), x.media_dates())))


@query(_GROUPS + """, y AS (SELECT year(make_timestamp(ms * 1000))::INTEGER AS year, media_key, len(people)::INTEGER AS n, row_number() OVER (PARTITION BY year(make_timestamp(ms * 1000)) ORDER BY len(people) DESC, ms, media_key)::INTEGER AS place FROM g WHERE len(people) >= 4)
SELECT year, media_key, n, place FROM y WHERE place <= 3""")
def crowds_per_year(x: Library) -> DataFrame:
    return L.crowds(L.groups(x.faces(), x.media_dates()))


_REUNIONS = """, e AS (SELECT media_key, ms, ms // 86400000 AS day, len(people) AS k, unnest(people) AS a FROM g),
m AS (SELECT e.a, f.a AS b, e.day, e.media_key, e.ms, e.k FROM e JOIN e f ON e.media_key = f.media_key AND e.a < f.a),
d AS (SELECT a, b, day, lag(day) OVER (PARTITION BY a, b ORDER BY day) AS last FROM (SELECT DISTINCT a, b, day FROM m)),
r AS (SELECT media_key, m.day, k, min(m.day - last) AS gap FROM m JOIN d ON d.a = m.a AND d.b = m.b AND d.day = m.day WHERE last IS NOT NULL AND k BETWEEN 3 AND 12 GROUP BY media_key, m.day, k), found AS (SELECT media_key, day::BIGINT AS day, k::INTEGER AS n, gap::BIGINT AS gap FROM r WHERE gap >= 365)
"""


@query(_GROUPS + _REUNIONS + "SELECT * FROM found")
def reunion_candidates(x: Library) -> DataFrame:
    return L.reunion_candidates(L.groups(x.faces(), x.media_dates()))


@query(_GROUPS + _REUNIONS + """, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, gap DESC, day, media_key) AS i FROM found),
w AS (SELECT i, media_key, day, n, gap, [day] AS chosen, true AS ok FROM o WHERE i = 1 UNION ALL
  SELECT i, media_key, day, n, gap, CASE WHEN ok THEN list_append(chosen, day) ELSE chosen END, ok FROM (SELECT o.i, o.media_key, o.day, o.n, o.gap, w.chosen,
    len(list_filter(w.chosen, lambda x: abs(x - o.day) < 180)) = 0 AS ok FROM w JOIN o ON o.i = w.i + 1))
SELECT media_key, day, n, gap FROM w WHERE ok""")
def reunions(x: Library) -> DataFrame:
    return L.spaced(L.reunion_candidates(L.groups(x.faces(), x.media_dates())))


def _candidates(x: Library) -> DataFrame:
    dated = P.reliable(x.media_dates()).join(P.face_scores(x.faces()), F.col("key") == F.col("media_key"))
    return dated.select(L.month_of(F.col("taken_ms")).alias("month"), "key", F.col("taken_ms").alias("ms"), F.col("score"))


_CANDIDATES = """, w AS (SELECT media_key, rank * CASE WHEN id IN (SELECT id FROM confident) THEN 1.0 ELSE 0.3 END::DOUBLE AS w FROM faces WHERE person_id IS NOT NULL),
fs AS (SELECT media_key, list(w ORDER BY w DESC) AS l FROM w GROUP BY media_key),
cand AS (SELECT (year(make_timestamp(taken_ms * 1000)) * 12 + month(make_timestamp(taken_ms * 1000)) - 1)::INTEGER AS month, key, taken_ms AS ms, l[1] + coalesce(l[2], 0) + coalesce(l[3], 0) AS score FROM reliable JOIN fs ON media_key = key)
"""


@query(_CANDIDATES + "SELECT month, key, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, ms, key) AS place FROM cand) WHERE place <= 6")
def month_top_n(x: Library) -> DataFrame:
    return L.month_top(_candidates(x), 6)


@query(_CANDIDATES + """, c AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, ms, key) AS i FROM cand),
g AS (SELECT month, i, key, ms, [ms] AS chosen, true AS ok FROM c WHERE i = 1 UNION ALL
  SELECT month, i, key, ms, CASE WHEN ok THEN list_append(chosen, ms) ELSE chosen END, ok FROM (SELECT c.month, c.i, c.key, c.ms, g.chosen,
    len(g.chosen) < 6 AND len(list_filter(g.chosen, lambda x: abs(x - c.ms) < 432000000)) = 0 AS ok FROM g JOIN c ON c.month = g.month AND c.i = g.i + 1))
SELECT month, key, ms FROM g WHERE ok""")
def month_picks_greedy(x: Library) -> DataFrame:
    return L.month_picks(_candidates(x), 6, 5 * L.DAY_MS)


@query(_MONTHS + """, w AS (SELECT person_id, month, n, month - lag(month) OVER v AS quiet, lead(month) OVER v - month AS ahead, sum(n) OVER v - n AS had FROM months WINDOW v AS (PARTITION BY person_id ORDER BY month)),
c AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY quiet DESC, month) AS r FROM w WHERE quiet >= 4 AND had >= 3 AND (n >= 2 OR ahead <= 3))
SELECT person_id, month, quiet FROM c WHERE r <= 2""")
def comebacks(x: Library) -> DataFrame:
    return L.comebacks(L.timeline_months(x.faces(), x.media_dates()), gap=4)


@query(_MONTHS + "SELECT person_id, sum(n)::BIGINT AS total, max(month) AS last_month FROM months GROUP BY person_id HAVING sum(n) >= 6 AND 24036 - max(month) >= 12")
def quiet_people(x: Library) -> DataFrame:
    return L.quiet_people(L.timeline_months(x.faces(), x.media_dates()), 24036)


@query(_MONTHS + "SELECT month, round(sqrt(sum(n) / max(sum(n)) OVER ()), 6) AS height FROM months GROUP BY month")
def density(x: Library) -> DataFrame:
    return L.density(L.timeline_months(x.faces(), x.media_dates())).select("month", r6("height"))


@query(_MONTHS + "SELECT month, count(DISTINCT person_id) AS n_people FROM months WHERE n > 0 GROUP BY month")
def people_in_month(x: Library) -> DataFrame:
    return L.people_in(L.timeline_months(x.faces(), x.media_dates()))


@query(_MONTHS + """, m AS (SELECT month, sum(n) AS n FROM months GROUP BY month),
f AS (SELECT month, sum(n) OVER (ORDER BY month RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS full_ FROM m)
SELECT (x - x % 12)::INTEGER AS month FROM (SELECT coalesce(min(month) FILTER (full_ >= 10), min(month)) AS x FROM f)""")
def axis_start(x: Library) -> DataFrame:
    return L.axis_start(L.timeline_months(x.faces(), x.media_dates()))


@query(_MONTHS + """, a AS (SELECT *, n = 1 AND coalesce(lead(month) OVER (PARTITION BY person_id ORDER BY month) - month, 0) > 2 AS lone FROM months),
lo AS (SELECT person_id, month, n FROM (SELECT *, min(CASE WHEN NOT lone THEN month END) OVER (PARTITION BY person_id) AS e FROM a) WHERE month >= e),
b AS (SELECT *, n = 1 AND coalesce(month - lag(month) OVER (PARTITION BY person_id ORDER BY month), 0) > 2 AS lone FROM lo)
SELECT person_id, month, n FROM (SELECT *, max(CASE WHEN NOT lone THEN month END) OVER (PARTITION BY person_id) AS e FROM b) WHERE month <= e""")
def trimmed_months(x: Library) -> DataFrame:
    return L.trim_lone_months(L.timeline_months(x.faces(), x.media_dates()), gap=2)


@query(_MONTHS + """, f AS (SELECT person_id, min(month) AS month, sum(n) AS total FROM months GROUP BY person_id), y AS (SELECT *, month // 12 AS year FROM f),
s AS (SELECT year, count(*) AS n, list(month ORDER BY month) AS m FROM y WHERE year > (SELECT min(year) FROM y) AND total >= 4 GROUP BY year HAVING count(*) >= 1)
SELECT year::BIGINT AS year, n, m[n // 2 + 1] AS month FROM s""")
def new_arrivals(x: Library) -> DataFrame:
    return L.new_arrivals(L.timeline_months(x.faces(), x.media_dates()), people=1)


@query(_MONTHS + """, s AS (SELECT month, n AS importance, person_id AS id, row_number() OVER (PARTITION BY month // 12 ORDER BY n DESC, month, person_id) AS place FROM months)
SELECT month, importance, id, place::INTEGER AS place FROM s WHERE place <= 6""")
def yearly_story(x: Library) -> DataFrame:
    return L.yearly_story(L.timeline_months(x.faces(), x.media_dates()).select("month", F.col("n").alias("importance"), F.col("person_id").alias("id")))


# ---- memories and dates


@query(_CANDIDATES + """, y AS (SELECT year(make_timestamp(taken_ms * 1000))::INTEGER AS year, key, taken_ms, coalesce(score, 0) AS score FROM reliable r LEFT JOIN cand USING (key)
  WHERE month(make_timestamp(taken_ms * 1000)) = 5 AND day(make_timestamp(taken_ms * 1000)) BETWEEN 1 AND 7 AND year(make_timestamp(taken_ms * 1000)) < 2002)
SELECT year, count(*) AS total, round(max(score), 6) AS best, round(least(max(score), 300) / 300 + 0.5 * least(1, ln(1 + count(*)) / ln(21)) + CASE WHEN max(score) > 0 THEN 0.3 ELSE 0 END, 6) AS strength,
  max(score) > 0 OR count(*) >= 4 AS qualifies FROM y GROUP BY year""")
def on_this_day_years(x: Library) -> DataFrame:
    found = M.on_this_day(x.media_dates(), P.face_scores(x.faces()), M.past_ranges(x.spark, 2002, 5, 4, 3))
    return found.select("year", "total", r6("best"), r6("strength"), "qualifies")


_TRIPS = """, d AS (SELECT person, ts_ms // 86400000 AS day, count(*) AS n FROM sightings GROUP BY 1, 2 HAVING count(*) >= 1),
i AS (SELECT *, day - row_number() OVER (PARTITION BY person ORDER BY day) AS island FROM d),
trips AS (SELECT person, min(day)::BIGINT AS first_day, max(day)::BIGINT AS last_day, sum(n)::BIGINT AS total FROM i GROUP BY person, island HAVING count(*) >= 3 AND sum(n) >= 5)
"""


def _trips(x: Library) -> DataFrame:
    per_day = x.sightings().groupBy("person", F.floor(F.col("ts_ms") / L.DAY_MS).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return M.trips(per_day, 3, 1, 5, by=("person",))


@query(_TRIPS + "SELECT * FROM trips")
def trips_islands(x: Library) -> DataFrame:
    return _trips(x)


@query(_TRIPS + "SELECT * FROM trips WHERE first_day <= 19735 + 5 AND last_day >= 19735 - 5 ORDER BY total DESC, first_day, person LIMIT 1")
def trip_near(x: Library) -> DataFrame:
    near = _trips(x)
    best = M.trip_near(near.orderBy("person"), 19735, 5)
    ties = near.join(best.select("total", "first_day"), ["total", "first_day"], "left_semi").where("first_day <= 19740 and last_day >= 19730")
    return ties.orderBy("person").limit(1).select("person", "first_day", "last_day", "total")


@query(""", c AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT id, n, coalesce(max(s) FILTER (s <= n), 0)::INTEGER AS reached FROM c, (SELECT unnest([2, 5, 10, 15, 20]) AS s) GROUP BY id, n)
SELECT id, n, reached, CASE WHEN reached > 2 THEN reached END AS crossed FROM m""")
def milestones_crossed(x: Library) -> DataFrame:
    n = x.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    reached = S.milestone_reached(F.col("n"), (2, 5, 10, 15, 20))
    return n.select("id", "n", reached.alias("reached"), F.when(reached > 2, reached).alias("crossed"))


@query(""", o AS (SELECT o_custkey AS id, epoch_ms(o_orderdate::TIMESTAMP) AS ms, min(epoch_ms(o_orderdate::TIMESTAMP)) OVER (PARTITION BY o_custkey) AS first FROM orders)
SELECT id, count(*) FILTER (ms <= first + 90 * 86400000::BIGINT) >= 3 AS real FROM o GROUP BY id""")
def first_appearance(x: Library) -> DataFrame:
    ms = F.collect_list(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return x.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(ms.alias("ms")).select("id", S.truly_first(F.col("ms")).alias("real"))


@query(""", d AS (SELECT key, CASE WHEN src < 3 THEN taken_ms ELSE 0 END AS a, taken_ms + 864000000 AS b FROM media_dates),
v AS (SELECT *, a BETWEEN 631152000000 AND 978393600000 AND a NOT BETWEEN 946634400000 AND 946821600000 AS va, b BETWEEN 631152000000 AND 978393600000 AND b NOT BETWEEN 946634400000 AND 946821600000 AS vb FROM d)
SELECT key, CASE WHEN va THEN a WHEN vb THEN b ELSE 0 END AS ms, CASE WHEN va THEN 1 WHEN vb THEN 2 ELSE 0 END AS src FROM v""")
def date_pick_priority(x: Library) -> DataFrame:
    none = F.lit(0).cast("long")
    picked = D.pick(F.when(F.col("src") < 3, F.col("taken_ms")).otherwise(none), F.col("taken_ms") + 864_000_000, none, none, none, F.lit(978_307_200_000).cast("long"))
    return x.media_dates().select("key", picked.alias("p")).select("key", "p.ms", "p.src")


@query(r"""SELECT key, coalesce(epoch_ms(try_strptime(nullif(regexp_extract(name, '(?:[^0-9]|^)((?:19|20)[0-9][0-9](?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?:[^0-9]|$)', 1), ''), '%Y%m%d')) + 43200000, 0) AS ms FROM file_names""")
def date_from_name(x: Library) -> DataFrame:
    return x.file_names().select("key", D.from_name(F.col("name")).alias("ms"))


@query("""SELECT key, CASE WHEN key % 3 = 0 THEN true ELSE false END AS shot, key % 5 <> 0 AS image FROM file_names""")
def screenshot_flag(x: Library) -> DataFrame:
    name = F.when(F.col("key") % 3 == 0, F.concat(F.lit("Screen_Shot-"), "name")).otherwise(F.col("name"))
    film = F.when(F.col("key") % 5 == 0, F.concat("name", F.lit(".MP4?x=1"))).otherwise(F.col("name"))
    return x.file_names().select("key", D.is_screenshot(name).alias("shot"), D.is_image(film).alias("image"))


@query("SELECT key, (epoch_ms(date_trunc('day', make_timestamp(taken_ms * 1000))) // 86400000)::INTEGER AS day, strftime(make_timestamp(taken_ms * 1000), '%B %-d') AS label FROM media_dates")
def day_labels(x: Library) -> DataFrame:
    return x.media_dates().select("key", D.day_number(F.col("taken_ms")).alias("day"), D.label(F.col("taken_ms")).alias("label"))


@query("SELECT count(*) AS n, min(taken_ms) AS first_ms, max(taken_ms) AS last_ms FROM reliable")
def date_bounds(x: Library) -> DataFrame:
    return P.reliable(x.media_dates()).agg(F.count(F.lit(1)).alias("n"), F.min("taken_ms").alias("first_ms"), F.max("taken_ms").alias("last_ms"))


@query("""SELECT key, taken_ms FROM reliable WHERE taken_ms >= 852076800000 AND taken_ms < 854755200000 ORDER BY taken_ms, key LIMIT 50""")
def dated_photos_range(x: Library) -> DataFrame:
    rows = P.reliable(x.media_dates()).where("taken_ms >= 852076800000 and taken_ms < 854755200000")
    return rows.select("key", "taken_ms").orderBy("taken_ms", "key").limit(50)


@query("""SELECT person, count(*) AS n, round(max(value), 6) AS best, round(least(max(value), 300) / 300 + 0.5 * least(1, ln(1 + count(*)) / ln(21)) + CASE WHEN max(value) > 0 THEN 0.3 ELSE 0 END, 6) AS strength FROM sightings GROUP BY person""")
def day_strength(x: Library) -> DataFrame:
    found = x.sightings().groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    return found.select("person", "n", r6("best"), F.round(S.strength(F.col("n"), F.col("best")), 6).alias("strength"))


@query("""SELECT kind FROM (SELECT kind, max(ts_ms // 86400000) AS last FROM sightings WHERE ts_ms // 86400000 < 19750 GROUP BY kind) ORDER BY last = 19749, last, kind LIMIT 1""")
def rotation_choose(x: Library) -> DataFrame:
    history = x.sightings().select("kind", F.floor(F.col("ts_ms") / L.DAY_MS).alias("day")).where("day < 19750")
    kinds = history.select("kind", F.lit("ordinary").alias("role"), F.col("kind").alias("place")).distinct()
    return M.rotation_choice(kinds, history, 19750, "morning")


def _people_candidates(x: Library) -> DataFrame:
    rows = P.confident(x.faces()).where("person_id is not null").join(P.reliable(x.media_dates()), F.col("media_key") == F.col("key"))
    return V.first_by(rows, ["person_id", "key"], F.desc("rank"), "id").select("person_id", "key", F.col("taken_ms").alias("ms"), L.month_of(F.col("taken_ms")).alias("month"), F.col("rank").alias("score"))


@query()
def then_and_now(x: Library) -> DataFrame:
    return M.then_and_now(_people_candidates(x))


@query()
def day_picks(x: Library) -> DataFrame:
    c = _candidates(x).withColumn("group", F.col("month").cast("long"))
    return M.day_picks(c, 6)


# ---- texts, exports and states


@query("""SELECT doc_id, list_distinct_ordered AS words FROM (SELECT doc_id, list(w ORDER BY i) AS list_distinct_ordered FROM (
  SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS l FROM documents))
  WHERE length(w) > 2 AND w NOT IN ({stop}) GROUP BY doc_id, w) GROUP BY doc_id)""".format(stop=", ".join(f"'{w}'" for w in Q.STOP_WORDS)))
def content_words(x: Library) -> DataFrame:
    return x.table("documents").select("doc_id", Q.content_words(F.col("text")).alias("words")).where("size(words) > 0")


@query(""", n AS (SELECT * FROM (VALUES (1, 'Thand'), (2, 'anan'), (3, 'The'), (4, 'the')) v(person, name))
SELECT doc_id AS id, person, name, length(regexp_extract(lower(text), '(?s)^(|.*?[^a-z0-9_])' || lower(name) || '(?:[^a-z0-9_]|$)', 1))::INTEGER AS at FROM documents, n
WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || lower(name) || '([^a-z0-9_]|$)')""")
def mentions(x: Library) -> DataFrame:
    people = x.spark.createDataFrame([(1, "Thand"), (2, "anan"), (3, "The"), (4, "the"), (5, "Same"), (6, "Same")], "id int, name string")
    return Q.mentions(x.table("documents").select(F.col("doc_id").alias("id"), "text"), people)


@query("""SELECT coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS extra, coalesce(sum((n - 1) * size) FILTER (n > 1), 0)::DOUBLE AS extra_bytes
FROM (SELECT l_partkey, count(*) AS n, max(l_quantity) AS size FROM lineitem GROUP BY l_partkey)""")
def repeated_files(x: Library) -> DataFrame:
    items = x.table("lineitem").select(F.col("l_partkey").alias("uri"), F.col("l_quantity").alias("size"))
    return X.repeated_files(items).withColumn("extra_bytes", F.col("extra_bytes").cast("double"))


@query("SELECT count(*) FILTER (NOT is_video) AS images, count(*) FILTER (is_video) AS videos, sum(ts_ms)::BIGINT AS n_bytes FROM photos")
def export_totals(x: Library) -> DataFrame:
    return X.totals(x.photos().withColumn("size", F.col("ts_ms")))


@query(""", e AS (SELECT o_custkey % 50 AS job, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i,
  (floor(o_totalprice * 10)::BIGINT + 5 * (floor(o_totalprice * 10)::BIGINT // 65535 + 1) + 2 * length('uri' || o_orderkey) + 500)::BIGINT AS cost FROM orders),
p AS (SELECT job, ord, i, 0 AS part, cost AS used FROM e WHERE i = 1 UNION ALL
  SELECT e.job, e.ord, e.i, CASE WHEN used + cost > 8000000 - 262144 THEN part + 1 ELSE part END, CASE WHEN used + cost > 8000000 - 262144 THEN cost ELSE used + cost END FROM p JOIN e ON e.job = p.job AND e.i = p.i + 1)
SELECT job, ord, part::INTEGER AS part FROM p""")
def zip_part_plan(x: Library) -> DataFrame:
    orders = x.table("orders")
    size, path = F.floor(F.col("o_totalprice") * 10).cast("long"), F.concat(F.lit("uri"), "o_orderkey")
    entries = orders.select((F.col("o_custkey") % 50).alias("job"), F.col("o_orderkey").alias("ord"), X.entry_cost(size, path, True).alias("cost"))
    return X.parts(entries, 8_000_000)


@query("SELECT o_orderkey AS key, (floor(o_totalprice * 10)::BIGINT + 5 * (floor(o_totalprice * 10)::BIGINT // 65535 + 1) + 2 * length('uri' || o_orderkey) + 500)::BIGINT AS cost FROM orders")
def zip_costs(x: Library) -> DataFrame:
    size, path = F.floor(F.col("o_totalprice") * 10).cast("long"), F.concat(F.lit("uri"), "o_orderkey")
    return x.table("orders").select(F.col("o_orderkey").alias("key"), X.entry_cost(size, path, True).cast("long").alias("cost"))


@query("""SELECT folder, name, ord, folder || '/' || CASE WHEN n = 1 THEN name ELSE replace(name, '.jpg', '') || ' (' || n || ').jpg' END AS path FROM (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY ord) AS n
  FROM (SELECT (o_custkey % 20)::VARCHAR AS folder, o_orderpriority || '.jpg' AS name, o_orderkey AS ord FROM orders))""")
def unique_names(x: Library) -> DataFrame:
    folder = (F.col("o_custkey") % 20).cast("string")
    return X.unique_names(x.table("orders").select(folder.alias("folder"), F.concat("o_orderpriority", F.lit(".jpg")).alias("name"), F.col("o_orderkey").alias("ord")))


@query("SELECT key, taken_ms, src FROM (SELECT key, CASE WHEN key % 2 = 0 THEN taken_ms + 1 ELSE taken_ms END AS taken_ms, CASE WHEN key % 2 = 0 THEN 4 ELSE src END AS src FROM media_dates WHERE key % 3 = 0 OR key % 2 = 0)")
def put_dates(x: Library) -> DataFrame:
    d = x.media_dates().select("key", "taken_ms", "src")
    found = d.where("key % 2 = 0").select("key", (F.col("taken_ms") + 1).alias("taken_ms"), F.lit(4).alias("src"), F.lit(1).alias("batch"))
    return U.put_dates(d.where("key % 3 = 0"), found.unionByName(found.withColumn("taken_ms", F.lit(0).cast("long")).withColumn("batch", F.lit(0))))


@query("SELECT id, media_key FROM faces WHERE media_key % 3 <> 0")
def purge_missing(x: Library) -> DataFrame:
    return U.purge_missing(x.faces().select("id", "media_key"), x.photos().where("hash % 3 <> 0").select(F.col("hash").alias("media_key")), "media_key")


@query("SELECT id, media_key FROM faces")
def purge_guard(x: Library) -> DataFrame:
    return U.purge_missing(x.faces().select("id", "media_key"), x.photos().where("hash < 0").select(F.col("hash").alias("media_key")), "media_key")


@query("SELECT id, name, pinned FROM people WHERE id IN (SELECT person_id FROM faces WHERE media_key % 97 = 0)")
def prune_people(x: Library) -> DataFrame:
    return U.prune_people(x.people(), x.faces().where("media_key % 97 = 0")).select("id", "name", "pinned")


@query("SELECT id, CASE WHEN id = 4 THEN 'New' ELSE name END AS name, hidden, pinned OR id = 4 AS pinned FROM people")
def rename_person(x: Library) -> DataFrame:
    return U.rename(x.people(), 4, "  New ").select("id", "name", "hidden", "pinned")


@query("SELECT id, CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id FROM faces")
def merge_people(x: Library) -> DataFrame:
    seen = x.sightings().select(F.col("kind").alias("uri"), "ts_ms", F.col("person").alias("person_id"))
    return U.merge_people(x.people(), x.faces(), seen, 2, 1)[1].select("id", "person_id")


@query("SELECT f.id, CASE WHEN locked OR person_id IN (SELECT id FROM people WHERE pinned) OR person_id NOT IN (SELECT id FROM people) THEN person_id END AS person_id FROM faces f")
def dissolve_unpinned(x: Library) -> DataFrame:
    return U.dissolve_unpinned(x.people(), x.faces())[1].select("id", "person_id")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 5 ELSE person_id END AS person_id FROM faces")
def assign_faces(x: Library) -> DataFrame:
    moves = x.faces().where("id % 7 < 2").select("id", F.when(F.col("id") % 7 == 1, F.lit(5).cast("long")).alias("new_person"))
    return U.assign(x.faces(), moves).select("id", "person_id")


@query("SELECT DISTINCT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b FROM events")
def reject_pairs(x: Library) -> DataFrame:
    pairs = x.sightings().select(F.col("person").alias("a"), (F.col("event_id") % 50).alias("b"))
    return U.reject_pairs(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a = 1"), pairs)


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def merge_log(x: Library) -> DataFrame:
    rows = x.table("orders").select(F.col("o_orderkey").alias("id"))
    return U.log_merge(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query("SELECT o_orderkey AS key, 'uri' || o_orderkey AS uri, CASE WHEN o_orderkey % 2 = 0 THEN epoch_ms(o_orderdate::TIMESTAMP) ELSE 0 END AS taken_ms, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 6)::INTEGER ELSE -1 END AS src FROM orders WHERE o_orderkey % 5 <> 0")
def reconcile_catalog(x: Library) -> DataFrame:
    current = x.photos().where("hash % 5 <> 0").select(F.col("hash").alias("key"), "uri")
    old = x.media_dates().where("key % 2 = 0").select("key", F.concat(F.lit("uri"), "key").alias("uri"), "taken_ms", "src")
    return U.reconcile(old, current)


@query("SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS hidden FROM orders")
def collections_overlay(x: Library) -> DataFrame:
    o = x.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.array(F.lit("a photo")).alias("prompts"), F.lit(2.8).alias("sensitivity"))
    mine = o.where("id % 3 = 0").withColumn("name", F.lit("x")).withColumn("prompts", F.array().cast("array<string>")).withColumn("hidden", F.lit(1))
    return U.overlay(o, mine).select("id", "name", "hidden")


