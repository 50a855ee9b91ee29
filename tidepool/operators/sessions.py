"""A trading calendar as rows: which days are sessions, and rows that are not on one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A calendar is a table (kind, date): closed weekdays, special weekend sessions and, as their first day, the years it covers.
KINDS = ("closed", "special", "year")


class CalendarNotCurrent(ValueError):
    """A date lies in a year that the calendar does not cover."""


def decode(raw: DataFrame, c: str = "raw") -> DataFrame:
    """(kind, date) from JSON text with closed_weekdays and weekend_sessions (date to name) and years (list)."""
    x = raw.select(F.from_json(c, "closed_weekdays map<string,string>, weekend_sessions map<string,string>, years array<int>").alias("x"))
    days = lambda kind, m: x.select(F.lit(kind).alias("kind"), F.explode(F.transform(F.map_keys(m), lambda k: k.cast("date"))).alias("date"))
    years = x.select(F.lit("year").alias("kind"), F.explode(F.transform("x.years", lambda y: F.make_date(y, F.lit(1), F.lit(1)))).alias("date"))
    return days("closed", "x.closed_weekdays").union(days("special", "x.weekend_sessions")).union(years).distinct()


def load(spark, path: str) -> DataFrame:
    """A calendar from a JSON file on any store that Spark reads."""
    return decode(spark.read.text(path, wholetext=True), "value")


def weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def uncovered(days: DataFrame, calendar: DataFrame, on: str = "date") -> DataFrame:
    """Years of ``days`` that the calendar does not cover (one row a year)."""
    years = calendar.filter("kind = 'year'").select(F.year("date").alias("year"))
    return days.filter(F.col(on).isNotNull()).select(F.year(on).alias("year")).distinct().join(years, "year", "left_anti")


def with_session(rows: DataFrame, calendar: DataFrame, on: str = "date", into: str = "is_session") -> DataFrame:
    """``rows`` and whether each is on a session: a weekday that is not closed or a listed weekend day.

    Raises :class:`CalendarNotCurrent` if a year is not covered; a null date is no session.
    """
    missing = sorted(r["year"] for r in uncovered(rows, calendar, on).limit(50).collect())
    if missing:
        raise CalendarNotCurrent(f"the calendar does not cover {missing}")
    listed = calendar.filter("kind <> 'year'").select(F.col("date").alias("_d")).distinct()
    found = rows.join(listed, F.col(on) == F.col("_d"), "left")
    # the two lists are apart: closed days are weekdays, special ones are not
    return found.withColumn(into, F.coalesce(weekend(F.col(on)) == F.col("_d").isNotNull(), F.lit(False))).drop("_d")


def drop_non_sessions(rows: DataFrame, calendar: DataFrame, on: str = "date") -> tuple[DataFrame, DataFrame]:
    """``rows`` on sessions, and the distinct dates of those that were dropped."""
    marked = with_session(rows, calendar, on, "_session")
    return marked.filter("_session").drop("_session"), marked.filter("not _session").select(on).distinct()


def extend(calendar: DataFrame, closures: DataFrame, year: int) -> DataFrame:
    """The calendar with the weekday closures of a list (date) and one more year."""
    spark = calendar.sparkSession
    more = closures.filter(~weekend(F.col("date"))).select(F.lit("closed").alias("kind"), "date")
    return calendar.union(more).union(spark.sql(f"select 'year' as kind, make_date({int(year)}, 1, 1) as date")).distinct()


def merge_live(calendar: DataFrame, listed: DataFrame, verified_through: Column, year: int) -> DataFrame:
    """The calendar and the listed closures of a year that it lacks and that lie after what was verified."""
    known = calendar.filter("kind = 'closed'").select("date")
    new = listed.filter((F.year("date") == year) & (F.col("date") > verified_through)).join(known, "date", "left_anti")
    return extend(calendar, new, year)
