"""Time analytics: months of people, companions, crowds, reunions, comebacks, density and month picks.

A media group is a row (media_key, ms, people array<long>) with distinct people.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.dates import local
from orrery.functions.dates import month_number as month_of
from orrery.operators.people import confident, is_confident, reliable
from orrery.operators.vector import first_by

DAY_MS = 86_400_000


def groups(faces: DataFrame, dates: DataFrame) -> DataFrame:
    """media_key, ms, people: who is surely in each dated media item."""
    rows = confident(faces).where("person_id is not null").join(reliable(dates), F.col("media_key") == F.col("key"))
    return rows.groupBy("media_key", F.col("taken_ms").alias("ms")).agg(F.sort_array(F.collect_set("person_id")).alias("people"))


def timeline_months(faces: DataFrame, dates: DataFrame, zone: str = "UTC") -> DataFrame:
    """person_id, month, n of media; a media item counts once for a person."""
    once = faces.where("person_id is not null").groupBy("person_id", "media_key").agg(F.bool_or(is_confident()).alias("sure")).where("sure")
    rows = once.join(reliable(dates), F.col("media_key") == F.col("key"))
    return rows.groupBy("person_id", month_of(F.col("taken_ms"), zone).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def timeline_coverage(faces: DataFrame, dates: DataFrame) -> DataFrame:
    """person_id, dated, undated: media of each person with and without a reliable date."""
    once = faces.where("person_id is not null").select("person_id", "media_key").distinct()
    found = once.join(reliable(dates), F.col("media_key") == F.col("key"), "left")
    return found.groupBy("person_id").agg(F.count("key").alias("dated"), F.count_if(F.col("key").isNull()).alias("undated"))


def pairs_of(groups: DataFrame) -> DataFrame:
    """One row (a, b) with a < b for each two people of a group; a group has a handful of people."""
    x = groups.withColumn("a", F.explode("people")).withColumn("b", F.explode("people"))
    return x.where("a < b")


def companions(groups: DataFrame, most: int = 12) -> DataFrame:
    """person, companion, n, first_ms, first_key: whom each person is with most, in groups of 2 to ``most``."""
    small = groups.where(F.size("people").between(2, most))
    pairs = pairs_of(small).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "media_key")).alias("first"))
    both = pairs.select(F.col("a").alias("person"), F.col("b").alias("companion"), "n", "first").union(pairs.select("b", "a", "n", "first"))
    best = first_by(both, ["person"], F.desc("n"), "first.ms", "companion")
    return best.select("person", "companion", "n", F.col("first.ms").alias("first_ms"), F.col("first.media_key").alias("first_key"))


def crowds(groups: DataFrame, least: int = 4, per_year: int = 3) -> DataFrame:
    """The fullest media of each year: year, media_key, n."""
    x = groups.select(F.year(local(F.col("ms"))).alias("year"), "media_key", "ms", F.size("people").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("year").orderBy(F.desc("n"), "ms", "media_key")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_year).select("year", "media_key", "n", "place")


def reunion_candidates(groups: DataFrame, least: int = 3, most: int = 12, gap_days: int = 365) -> DataFrame:
    """media_key, day, n, gap: groups of people back together after gap_days or more.

    A pair was last seen on an earlier UTC day; every group of two and more counts as a meeting.  No pair of the group
    may have met within gap_days, and two people at least must be of pairs that meet again; gap is the least one.
    """
    day = F.floor(F.col("ms") / DAY_MS)
    few = groups.where(F.size("people").between(2, most)).withColumn("day", day)
    meets = pairs_of(few)
    wanted = meets.where(F.size("people") >= least).select("a", "b").distinct()
    # Larger groups are meetings, too, but only of pairs that are asked for: they aren't made into pairs.
    crowd = groups.where(F.size("people") > most).select("media_key", day.alias("day"), F.explode("people").alias("a"))
    crowded = wanted.join(crowd, "a").join(crowd.select("media_key", F.col("a").alias("b")), ["media_key", "b"])
    days = meets.select("a", "b", "day").union(crowded.select("a", "b", "day")).distinct()
    last = days.withColumn("last", F.lag("day").over(Window.partitionBy("a", "b").orderBy("day")))
    again = meets.where(F.size("people").between(least, most)).join(last, ["a", "b", "day"]).where("last is not null").withColumn("gap", F.col("day") - F.col("last"))
    found = again.groupBy("media_key", "day", "ms", F.size("people").alias("n")).agg(F.min("gap").alias("gap"), F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias("back"))
    return found.where((F.col("gap") >= gap_days) & (F.size("back") >= 2)).select("media_key", "day", "n", "gap")


def spaced(candidates: DataFrame, days: int = 180) -> DataFrame:
    """Reunions in the order of people, then gap; one within ``days`` of an earlier choice falls out.

    Only the first of each day can be chosen, as the rest of its day falls out with it or because of it.  So what is gone
    through in order, in one group, has a row for each day at most, however large the library is.
    """
    first = F.max(F.struct("n", "gap", (-F.col("media_key")).alias("other"))).alias("f")
    candidates = candidates.groupBy("day").agg(first).select((-F.col("f.other")).alias("media_key"), "day", F.col("f.n").alias("n"), F.col("f.gap").alias("gap"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        keep = []
        for row in pdf.sort_values(["n", "gap", "day", "media_key"], ascending=[False, False, True, True]).itertuples():
            if all(abs(row.day - d) >= days for d in chosen):
                chosen.append(row.day)
                keep.append((row.media_key, row.day, row.n, row.gap))
        return pd.DataFrame(keep, columns=["media_key", "day", "n", "gap"])

    return candidates.groupBy(F.lit(0).alias("one")).applyInPandas(choose, "media_key long, day long, n int, gap long")


def greedy_apart(items: Column, apart_ms: int, most: int) -> Column:
    """items: array of (neg_score, ms, key) in order of choice -> those chosen, none within apart_ms of one before."""

    def step(chosen: Column, x: Column) -> Column:
        near = F.exists(chosen, lambda c: F.abs(c["ms"] - x["ms"]) < apart_ms)
        return F.when(near | (F.size(chosen) >= most), chosen).otherwise(F.concat(chosen, F.array(x)))

    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), step)


def month_picks(candidates: DataFrame, per_month: int = 6, burst_ms: int = 120_000) -> DataFrame:
    """month, key, ms: the best of each month by score, then time, skipping whatever is within burst_ms of a choice.

    candidates: month, key, ms, score.  Stays in the JVM: a fold over each month's sorted array.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg_score"), "ms", "key")))
    chosen = candidates.groupBy("month").agg(greedy_apart(ranked, burst_ms, per_month).alias("chosen"))
    return chosen.select("month", F.explode("chosen").alias("c")).select("month", "c.key", "c.ms")


def month_top(candidates: DataFrame, per_month: int) -> DataFrame:
    """month, key, place: the best of each month, bursts or not."""
    order = Window.partitionBy("month").orderBy(F.desc("score"), "ms", "key")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_month).select("month", "key", "place")


def comebacks(months: DataFrame, gap: int = 12, before: int = 3, top: int = 2) -> DataFrame:
    """person_id, month, quiet: returns after ``gap`` months or more, of people with ``before`` photos before it who went
    on (two photos in the month, or more within three months); the ``top`` longest of each person."""
    w = Window.partitionBy("person_id").orderBy("month")
    x = months.select("person_id", "month", "n", F.lag("month").over(w).alias("last"), F.lead("month").over(w).alias("next"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("had"))
    x = x.withColumn("quiet", F.col("month") - F.col("last"))
    went_on = (F.col("n") >= 2) | (F.coalesce(F.col("next") - F.col("month"), F.lit(99)) <= 3)
    x = x.where((F.col("quiet") >= gap) & (F.col("had") >= before) & went_on)
    order = Window.partitionBy("person_id").orderBy(F.desc("quiet"), "month")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("person_id", "month", "quiet")


def quiet_people(months: DataFrame, now_month: int, least: int = 6, quiet: int = 12) -> DataFrame:
    """People with ``least`` photos and more who haven't been seen for ``quiet`` months: person_id, total, last_month."""
    x = months.groupBy("person_id").agg(F.sum("n").alias("total"), F.max("month").alias("last_month"))
    return x.where((F.col("total") >= least) & (now_month - F.col("last_month") >= quiet))


def companion_importance(companions: DataFrame, least: int = 3) -> DataFrame:
    """person, companion, importance of the first time together: min(60, 20 + round(8 log2 n))."""
    x = companions.where(F.col("n") >= least)
    return x.select("person", "companion", F.least(F.lit(60), 20 + F.round(8 * F.log2("n"))).cast("int").alias("importance"))


def density(months: DataFrame) -> DataFrame:
    """month, height: square root of a month's photos over the fullest month's."""
    x = months.groupBy("month").agg(F.sum("n").alias("n"))
    return x.select("month", F.sqrt(F.col("n") / F.max("n").over(Window.partitionBy())).alias("height"))


def people_in(months: DataFrame) -> DataFrame:
    return months.where("n > 0").groupBy("month").agg(F.countDistinct("person_id").alias("n_people"))


def axis_start(months: DataFrame, ahead: int = 24, least: int = 10) -> DataFrame:
    """month: January of the first month with ``least`` photos from it over ``ahead`` months; else of the first month."""
    x = months.groupBy("month").agg(F.sum("n").alias("n"))
    full = F.sum("n").over(Window.orderBy("month").rangeBetween(0, ahead - 1))
    x = x.withColumn("full", full).agg(F.coalesce(F.min(F.when(F.col("full") >= least, F.col("month"))), F.min("month")).alias("m"))
    return x.select((F.col("m") - F.col("m") % 12).alias("month"))


def trim_lone_months(months: DataFrame, gap: int = 18) -> DataFrame:
    """months without single-photo months more than ``gap`` months away at either end of a person's line, again and again.

    From each end all such months go up to the first that isn't one: the start by the month after each, then the end by the
    month before, among those left.
    """
    own = Window.partitionBy("person_id")

    def without(x: DataFrame, away: Column, ends: Callable[[Column], Column]) -> DataFrame:
        lone = F.coalesce((F.col("n") == 1) & (away > gap), F.lit(False))
        return x.withColumn("lone", lone).withColumn("end", ends(F.when(~F.col("lone"), F.col("month"))).over(own))

    w = own.orderBy("month")
    x = without(months.select("person_id", "month", "n"), F.lead("month").over(w) - F.col("month"), F.min).where("month >= end")
    x = without(x.select("person_id", "month", "n"), F.col("month") - F.lag("month").over(w), F.max).where("month <= end")
    return x.select("person_id", "month", "n")


def yearly_story(entries: DataFrame, per_year: int = 6) -> DataFrame:
    """The most important entries (month, importance, id) of each year, in order of time."""
    year = F.floor(F.col("month") / 12)
    order = Window.partitionBy(year).orderBy(F.desc("importance"), "month", "id")
    return entries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_year).orderBy("month", "id")


def new_arrivals(months: DataFrame, people: int = 3, photos: int = 4) -> DataFrame:
    """year, n, month: years after the first in which ``people`` newcomers or more (of ``photos`` and more) appear; their median month."""
    first = months.groupBy("person_id").agg(F.min("month").alias("month"), F.sum("n").alias("total")).withColumn("year", F.floor(F.col("month") / 12))
    start = first.agg(F.min("year").alias("start"))
    x = first.crossJoin(F.broadcast(start)).where((F.col("year") > F.col("start")) & (F.col("total") >= photos))
    x = x.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("month")).alias("m")).where(F.col("n") >= people)
    return x.select("year", "n", F.element_at("m", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("month"))


def rate(ticks: Iterator[tuple[int, int]], least_ms: int = 1500, old: float = 0.6) -> float | None:
    """Smoothed items a second over (ms, items) ticks; ticks closer than least_ms are joined with the next."""
    last, value = None, None
    for ms, items in ticks:
        if last is None:
            last = ms, items
        elif ms - last[0] >= least_ms:
            now = (items - last[1]) * 1000 / (ms - last[0])
            value = now if value is None else old * value + (1 - old) * now
            last = ms, items
    return value
