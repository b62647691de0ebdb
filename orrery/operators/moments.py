"""Moments of people: first days, round numbers, pictures out of the blue, pairs, and lists of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalar import MILESTONES, milestone_crossed, truly_first
from orrery.operators.people import confident, listed, reliable
from orrery.operators.vector import first_by

DAY_MS = 86_400_000


def dated_faces(faces: DataFrame, photos: DataFrame, dates: DataFrame) -> DataFrame:
    """person_id, id, key, taken_ms, n_faces, suited: sure faces in dated still photos; crowds count for less."""
    n = faces.groupBy("media_key").agg(F.count(F.lit(1)).alias("n_faces"))
    rows = confident(faces).where("person_id is not null").join(photos.where("not is_video"), F.col("media_key") == F.col("hash"), "left_semi")
    rows = rows.join(reliable(dates), F.col("media_key") == F.col("key")).join(n, "media_key")
    suited = F.col("rank") / (1 + 0.35 * F.greatest(F.col("n_faces") - 1, F.lit(0)))
    rows = rows.select("person_id", "id", "key", "taken_ms", "n_faces", suited.alias("suited"))
    return first_by(rows, ["person_id", "key"], F.desc("suited"), "id")


def _same_day(ms: Column, month: Column, day: Column) -> Column:
    t = F.timestamp_millis(ms)
    return (F.month(t) == month) & (F.dayofmonth(t) == day)


def anniversaries(companions: DataFrame, people: DataFrame, today: DataFrame, least: int = 3) -> DataFrame:
    """a, b, years: named pairs whose first time together was on this day of an earlier year.

    today: one row of year, month, day.
    """
    c = companions.where(F.col("n") >= least).crossJoin(F.broadcast(today))
    c = c.where(_same_day(F.col("first_ms"), F.col("month"), F.col("day")))
    years = F.col("year") - F.year(F.timestamp_millis("first_ms"))
    pairs = c.select(F.least("person", "companion").alias("a"), F.greatest("person", "companion").alias("b"), years.alias("years")).where("years > 0")
    pairs = pairs.groupBy("a", "b").agg(F.max("years").alias("years"))
    named = people.where("name is not null").select("id")
    return pairs.join(named, F.col("a") == F.col("id"), "left_semi").join(named, F.col("b") == F.col("id"), "left_semi")


def person_anniversaries(dated: DataFrame, people: DataFrame, today: DataFrame, least: int = 20) -> DataFrame:
    """person_id, years, key: named people of ``least`` photos whose first one, a true beginning, was on this day, with the
    picture of the first 60 days that suits best."""
    first = dated.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.min("taken_ms").alias("first_ms"), F.collect_list("taken_ms").alias("dates"))
    first = first.where((F.col("n") >= least) & truly_first(F.col("dates"))).join(people.where("name is not null").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    first = first.crossJoin(F.broadcast(today)).where(_same_day(F.col("first_ms"), F.col("month"), F.col("day")))
    first = first.select("person_id", "first_ms", (F.col("year") - F.year(F.timestamp_millis("first_ms"))).alias("years")).where("years > 0")
    early = dated.join(first, "person_id").where(F.col("taken_ms") - F.col("first_ms") <= 60 * DAY_MS)
    return first_by(early, ["person_id"], F.desc("suited"), "taken_ms", "key").select("person_id", "years", "key")


def milestone_pictures(counts: DataFrame, announced: DataFrame, dated: DataFrame, now_ms: int, steps: tuple[int, ...] = MILESTONES) -> DataFrame:
    """person_id, step, key: people (id, name, n_media) past a round number that wasn't announced (person_id, step), with the
    best picture of the last year, or of all."""
    x = counts.where("name is not null").join(announced.withColumnRenamed("step", "had"), F.col("id") == F.col("person_id"), "left").drop("person_id")
    crossed = milestone_crossed(F.col("n_media"), F.coalesce("had", F.lit(0))) if steps == MILESTONES else None
    if crossed is None:
        reached = F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col("n_media"))), F.lit(0))
        crossed = F.when(reached > F.coalesce("had", F.lit(0)), reached)
    x = x.select(F.col("id").alias("person_id"), crossed.alias("step")).where("step is not null")
    recent = F.col("taken_ms") >= now_ms - 365 * DAY_MS
    return first_by(dated.join(x, "person_id"), ["person_id"], F.desc(recent), F.desc("suited"), "taken_ms", "key").select("person_id", "step", "key")


def vault(dated: DataFrame, people: DataFrame, now_ms: int, today: int, least: int = 15) -> DataFrame:
    """person_id, key: for each named person of ``least`` photos with five older than 300 days, the (day mod n)-th of the five
    best of them, alone if there are three such."""
    many = dated.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    old = dated.where(F.col("taken_ms") < now_ms - 300 * DAY_MS).join(many, "person_id", "left_semi")
    old = old.join(people.where("name is not null").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    w = Window.partitionBy("person_id")
    old = old.withColumn("alone", F.count_if(F.col("n_faces") == 1).over(w) >= 3).withColumn("all", F.count(F.lit(1)).over(w))
    pool = old.where((F.col("all") >= 5) & (~F.col("alone") | (F.col("n_faces") == 1)))
    pool = pool.withColumn("place", F.row_number().over(w.orderBy(F.desc("suited"), "taken_ms", "key")) - 1).where("place < 5")
    pool = pool.withColumn("top", F.count(F.lit(1)).over(w))
    return pool.where(F.col("place") == F.pmod(F.lit(today), F.col("top"))).select("person_id", "key")


def together_since(pairs: DataFrame) -> DataFrame:
    """a, b, since_ms, n, years of pairs' photos (a, b, key, taken_ms): from the first date with three photos in 90 days on, for
    pairs whose photos span a year from it."""
    w = Window.partitionBy("a", "b").orderBy("taken_ms").rangeBetween(0, 90 * DAY_MS)
    start = pairs.withColumn("near", F.count(F.lit(1)).over(w)).where("near >= 3").groupBy("a", "b").agg(F.min("taken_ms").alias("since_ms"))
    x = pairs.join(start, ["a", "b"]).where(F.col("taken_ms") >= F.col("since_ms"))
    x = x.groupBy("a", "b", "since_ms").agg(F.count(F.lit(1)).alias("n"), F.max("taken_ms").alias("last_ms"))
    years = (F.col("last_ms") - F.col("since_ms")) / (365.0 * DAY_MS)
    return x.where(years >= 1).select("a", "b", "since_ms", "n", F.greatest(F.lit(1), F.round(years)).cast("int").alias("years"))


def trip_photos(photos: DataFrame, trips: DataFrame) -> DataFrame:
    """first_day, day, key: the best photo (key, day, score, ms) of the first, a middle and the last day of each trip."""
    days = F.array_distinct(F.array("first_day", F.floor((F.col("first_day") + F.col("last_day")) / 2), "last_day"))
    wanted = trips.select("first_day", F.explode(days).alias("day"))
    return first_by(photos.join(wanted, "day"), ["first_day", "day"], F.desc("score"), "ms", "key").select("first_day", "day", "key")


def moment_circle(counts: DataFrame, size: int = 8) -> DataFrame:
    """id of the ``size`` best-known named people (id, name, n_media); with fewer than four, unnamed ones fill up."""
    named = F.col("name").isNotNull()
    x = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(named), F.desc("n_media"), "id"))).where(F.col("place") <= size)
    n = F.count_if(named).over(Window.partitionBy())
    return x.withColumn("known", n).where(named | (F.col("known") < 4)).select("id")


def timeline_order(rows: DataFrame, order: str, dates_done: bool = True) -> list[Column]:
    """How rows (name, n, first_month, last_month, id) are ordered: earliest, recent, most or name.

    Until all dates are in, the order by date would keep changing: by photos instead.
    """
    most = [F.desc("n"), F.col("id").asc()]
    if order == "earliest" and dates_done:
        return [F.col("first_month").asc_nulls_last(), *most]
    if order == "recent" and dates_done:
        return [F.col("last_month").desc_nulls_last(), *most]
    return [F.lower("name").asc_nulls_last(), *most] if order == "name" else most


def daily_covers(collections: DataFrame, day: int, most: int = 3) -> DataFrame:
    """id, covers: a collection's covers (id, covers array) from the day's place on, at most three, round to the start."""
    codes = F.aggregate(F.transform(F.split("id", ""), lambda c: F.ascii(c)), F.lit(0), lambda s, x: s + x)
    n = F.size("covers")
    at = F.pmod(F.lit(day) + codes, n)
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), n) - 1), lambda k: F.element_at("covers", ((at + k) % n + 1).cast("int")))
    return collections.where("size(covers) > 0").select("id", picks.alias("covers"))


def shown_collections(collections: DataFrame) -> DataFrame:
    """Visible collections (id, built_in, hidden, n, ord) in order: the user's, then built-in ones, fullest first."""
    order = Window.orderBy("built_in", F.when(F.col("built_in"), -F.col("n")).otherwise(0), "ord")
    return collections.where("hidden = 0").withColumn("place", F.row_number().over(order))


def video_people(sightings: DataFrame, people: DataFrame, faces: DataFrame) -> DataFrame:
    """video, person, times of unhidden people in videos who are listed or were seen at two moments."""
    x = sightings.groupBy("video", "person").agg(F.sort_array(F.collect_set("ts_ms")).alias("times"))
    shown = people.where("not hidden").select(F.col("id").alias("person"))
    often = listed(people, faces).select(F.col("id").alias("person"), F.lit(True).alias("often"))
    x = x.join(shown, "person", "left_semi").join(often, "person", "left")
    return x.where("often or size(times) >= 2").select("video", "person", "times")
