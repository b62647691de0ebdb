"""Queries that run as streams over a table in several batches, until all there is has gone through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.cluster import Thresholds
from orrery.plans.queries import query
from orrery.sources.views import Library
from orrery.streaming import ingest as I


def _events(x: Library) -> DataFrame:
    rows = I.in_parts(x.table("events"), "ts")
    return rows.select("event_id", F.col("user_id").alias("person"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("video"))


@query("SELECT DISTINCT user_id AS person FROM events")
def stream_once(x: Library) -> DataFrame:
    return I.drained(I.once_by_hash(_events(x).select("person"), "person"))


@query("""SELECT s * 3600000 AS start_ms, kind AS video, list_sort(list(DISTINCT person)) AS people FROM (SELECT *, ts_ms // 3600000 AS s FROM sightings) WHERE (s + 1) * 3600000 <= (SELECT max(ts_ms) FROM sightings) - 60000 GROUP BY s, kind""")
def stream_together(x: Library) -> DataFrame:
    found = I.drained(I.seen_together(_events(x).select("video", "ts", "person"), 3_600_000))
    return found.select(F.unix_millis("start").alias("start_ms"), "video", "people")


@query("SELECT event_id, user_id AS person FROM events")
def stream_follow(x: Library) -> DataFrame:
    return I.drained(_events(x).select("event_id", "person"))


@query()
def stream_rates(x: Library) -> DataFrame:
    ticks = _events(x).select(F.col("person").alias("key"), F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("items"))
    return I.drained(I.rates(ticks))


@query()
def stream_clusters(x: Library) -> DataFrame:
    rows = I.in_parts(x.table("embeddings"), "vec_id")
    faces = rows.select(F.col("label").cast("long").alias("block"), F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).alias("media_key"), (F.col("vec_id") % 5 != 0).alias("good"), F.col("embedding").cast("array<double>").alias("embedding"))
    return I.drained(I.cluster_stream(faces, Thresholds()))


@query("SELECT person, list_transform(list((ts_ms, event_id) ORDER BY ts_ms DESC, event_id DESC)[1:10], lambda r: r[2]) AS items FROM sightings GROUP BY person")
def last_items(x: Library) -> DataFrame:
    return I.last_items(x.sightings().select("person", "ts_ms", F.col("event_id").alias("item")), "person")


@query("SELECT kind, min(ts_ms) AS ts_ms FROM sightings GROUP BY kind, ts_ms // 60000")
def throttled_progress(x: Library) -> DataFrame:
    return I.throttled(x.sightings().select("kind", "ts_ms"), "kind", 60_000)


@query("SELECT id, media_key FROM faces WHERE deferred AND media_key IN (SELECT DISTINCT media_key FROM faces WHERE deferred ORDER BY media_key LIMIT 24)")
def late_recognition(x: Library) -> DataFrame:
    return I.recognise_later(x.faces().select("id", "media_key", "rank", "deferred"), lambda round_: round_.select("id", "media_key"))
