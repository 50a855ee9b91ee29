"""Joins in time: as-of, grid fill, next session, intervals, reproduction compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.tables import deal


def asof_backward(left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False, tasks: int | None = None) -> DataFrame:
    """For each left row the right row of its key with the greatest time at or before (strict: before) the left one's.

    Union and fill: both sides are shuffled once on the key and read in time order, so no pairs are made. Of several right
    rows at one time the greatest values count. ``tasks``: to how many tasks the rows are dealt (the session's number by default).
    """
    rank = 0 if not strict else 2
    payload = F.struct(F.col(right_on).alias(right_on), *[F.col(v) for v in values])
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col(left_on).alias("_t"), F.lit(1).alias("_o"), F.struct(*left.columns).alias("_l"))
    b = right.filter(F.col(right_on).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col(right_on).alias("_t"), F.lit(rank).alias("_o"), payload.alias("_r"))
    both = deal(a.unionByName(b, allowMissingColumns=True), tasks, *[f"_k{i}" for i in range(len(by))])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_t", "_o", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    return found.select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in (right_on, *values)])


def fill_on_grid(grid: DataFrame, series: DataFrame, values: list[str]) -> DataFrame:
    """Series values on the dates of a grid: filled forward on the union of both date sets, then cut to the grid."""
    dates = grid.select("date").union(series.select("date")).distinct()
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    filled = dates.join(series, "date", "left").select("date", *[F.last(v, True).over(w).alias(v) for v in values])
    return grid.select("date").distinct().join(filled, "date")


def next_session(events: DataFrame, calendar: DataFrame, on: str = "date") -> DataFrame:
    """The first session strictly after each event's date, by union and fill from the far end."""
    days = events.select(F.col(on).alias("_t")).distinct()
    marked = calendar.select(F.col("date").alias("_t"), F.col("date").alias("session")).union(days.select("_t", F.lit(None).cast("date")))
    after = marked.select(F.unix_date("_t").alias("_d"), "_t", "session")
    w = Window.orderBy("_d").rangeBetween(1, Window.unboundedFollowing)
    found = after.withColumn("next", F.min("session").over(w)).groupBy("_t").agg(F.min("next").alias("next_session"))
    return events.join(found, F.col(on) == F.col("_t"), "left").drop("_t")


def member_on(intervals: DataFrame, day: Column, inclusive: bool = False) -> DataFrame:
    """Intervals that hold a day; the end is exclusive unless asked otherwise."""
    end = F.col("effective_to") >= day if inclusive else F.col("effective_to") > day
    return intervals.filter((F.col("effective_from") <= day) & end)


def without_near(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, days: int) -> DataFrame:
    """Rows of left with no right row of the same key within so many days: the days near right rows are unrolled for an equi anti join."""
    near = right.select(F.col(by).alias("_k"), F.explode(F.sequence(F.date_add(right_on, -days), F.date_add(right_on, days))).alias("_d")).distinct()
    return left.join(near, (F.col(by) == F.col("_k")) & (F.to_date(left_on) == F.col("_d")), "left_anti")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer compare: one row with left_only, right_only, equal (null equals null) and max_drift."""
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_x")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = x.join(y, keys, "full")
    n = lambda c: F.sum(c.cast("long"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return j.agg(n(F.col("_y").isNull()).alias("left_only"), n(F.col("_x").isNull()).alias("right_only"),
                 n(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_drift"))
