"""What there is to remember today: past years' days, and what a notice about them says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.dates import label
from orrery.functions.scalar import joined_names

#: Good years that make a notice across years, photos of a big day, names that make a crowd.
YEARS_ACROSS, BIG_DAY, CROWD = 3, 40, 3


def count_years(n: Column) -> Column:
    return F.when(n == 1, F.lit("1 year")).otherwise(F.concat(n, F.lit(" years")))


def exact_or_week(exact: DataFrame, week: DataFrame) -> DataFrame:
    """The years of the day itself (kind exact), or, where it has none at all, those of the week around it (kind week)."""
    none = exact.agg((F.count(F.lit(1)) == 0).alias("none"))
    around = week.crossJoin(F.broadcast(none)).where("none").drop("none")
    return exact.withColumn("kind", F.lit("exact")).unionByName(around.withColumn("kind", F.lit("week")))


def best_year(years: DataFrame, *by: str) -> DataFrame:
    """The strongest year of each group, the longer ago on ties."""
    best = F.max(F.struct("strength", "years_ago", F.struct(*years.columns).alias("row"))).alias("best")
    return (years.groupBy(*by) if by else years).agg(best).where("best is not null").select("best.row.*")


def day_notices(years: DataFrame, day: int) -> DataFrame:
    """kind, year, title, body of notices of years (year, years_ago, total, strength, qualifies, kind, taken_ms, names): the best
    good year of the day, the same day across years, and this week.

    taken_ms and names are those of the year's best photo; day picks one of the wordings.
    """
    good = years.where("qualifies")
    ago = F.concat(count_years(F.col("years_ago")), F.lit(" ago"))
    date = F.concat(label(F.col("taken_ms")), F.lit(", "), F.col("year"))
    who = F.slice("names", 1, 3)
    described = F.when(F.size(who) > 0, F.concat(joined_names(who), F.lit(" · "), date))
    counted = F.concat(F.col("total"), F.lit(" photos and videos"))
    body = F.coalesce(described, F.when(F.col("total") > 1, F.concat(date, F.lit(" · "), counted)), date)
    pick = lambda *words: F.element_at(F.array(*words), day % len(words) + 1)
    crowd, big = F.size("names") >= CROWD, F.col("total") >= BIG_DAY
    title = (
        F.when(crowd, pick(F.concat(F.lit("Everyone together · "), ago), F.concat(F.lit("The whole gang · "), ago, F.lit(" today"))))
        .when(big, F.concat(F.lit("A day to remember · "), ago))
        .otherwise(pick(F.concat(F.lit("On this day · "), ago), F.concat(count_years(F.col("years_ago")), F.lit(" ago today")), F.lit("Remember this day?")))
    )
    on_day = best_year(good.where("kind = 'exact'")).select(F.lit("on_this_day").alias("kind"), "year", title.alias("title"), F.when(big, F.concat(F.coalesce(described, date), F.lit(" · "), counted)).otherwise(body).alias("body"))
    n = good.where("kind = 'exact'").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= YEARS_ACROSS)
    across = best_year(good.where("kind = 'exact'")).crossJoin(F.broadcast(n)).select(
        F.lit("same_day").alias("kind"), "year", F.concat(label(F.col("taken_ms")), F.lit(", across the years")).alias("title"), F.concat(F.lit("Photos from "), F.col("n"), F.lit(" different years are waiting for you.")).alias("body")
    )
    week = best_year(good.where("kind = 'week'")).select(F.lit("this_week").alias("kind"), "year", F.concat(F.lit("This week · "), ago).alias("title"), body.alias("body"))
    return on_day.unionByName(across).unionByName(week)


def view_total(years: DataFrame) -> DataFrame:
    """One row: n_years and total of the years that are shown."""
    return years.agg(F.count(F.lit(1)).alias("n_years"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def group_moments(crowds: DataFrame, reunions: DataFrame, arrivals: DataFrame) -> DataFrame:
    """kind, month, importance, text of moments of groups.

    crowds: month, n (known people): the fullest of each year, of four and more; reunions: month, n, gap (days): of three
    and more; arrivals: year, n, month of years with newcomers.
    """
    year = F.floor(F.col("month") / 12)
    full = crowds.where("n >= 4").groupBy(year.alias("year")).agg(F.max(F.struct("n", (-F.col("month")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("month"), F.col("b.n").alias("n"))
    gang = full.select(F.lit("gang").alias("kind"), "month", (40 + 8 * F.least("n", F.lit(10))).alias("importance"), F.concat(F.lit("The whole gang: "), F.col("n"), F.lit(" people in one photo")).alias("text"))
    months = F.round(F.col("gap") / 30.4).cast("int")
    apart = F.when(months >= 24, F.concat(F.round(months / 12).cast("int"), F.lit(" years"))).otherwise(F.concat(months, F.lit(" months")))
    again = reunions.where("n >= 3").select(F.lit("reunion").alias("kind"), "month", (50 + 6 * F.least("n", F.lit(10)) + F.floor(F.least(months, F.lit(36)) / 2)).alias("importance"), F.concat(F.lit("A reunion: "), F.col("n"), F.lit(" of you together again after "), apart).alias("text"))
    new = arrivals.select(F.lit("new").alias("kind"), "month", (30 + 6 * F.least("n", F.lit(10))).alias("importance"), F.concat(F.col("n"), F.lit(" new faces in "), F.col("year")).alias("text"))
    columns = lambda df: df.select("kind", F.col("month").cast("int").alias("month"), F.col("importance").cast("int").alias("importance"), "text")
    return columns(gang).unionByName(columns(again)).unionByName(columns(new))


def photo_moments(moments: DataFrame) -> DataFrame:
    """uri, month, importance: the most important moment (uri, month, importance) of each photo, the first on ties."""
    x = moments.groupBy("uri").agg(F.max(F.struct("importance", (-F.col("month")).alias("m"))).alias("b"))
    return x.select("uri", (-F.col("b.m")).alias("month"), F.col("b.importance").alias("importance"))
