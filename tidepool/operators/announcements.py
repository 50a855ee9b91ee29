"""Announcements on a session calendar, corporate-action factors and the resolution of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.joins import asof_backward, next_session
from tidepool.operators.windows import by_ticker, latest
from tidepool.sources.tables import deal


def usable_sessions(events: DataFrame, calendar: DataFrame, ts: str = "ts", close_hour: int = 15) -> DataFrame:
    """session and timing of each time stamp: before the close hour the same or the next session, else a strictly later one.

    timing is intraday, after_close or non_trading_day. calendar has the session dates.
    """
    day, early = F.to_date(ts), F.hour(ts) < close_hour
    from_day = events.withColumns({"_day": day, "_from": F.when(early, F.date_sub(day, 1)).otherwise(day)})
    found = next_session(from_day, calendar, "_from").withColumnRenamed("next_session", "session")
    open_days = F.broadcast(calendar.select(F.col("date").alias("_day"), F.lit(True).alias("_open")).distinct())  # one row a session
    timing = F.when(F.col("_open").isNull(), "non_trading_day").when(early, "intraday").otherwise("after_close")
    return found.join(open_days, "_day", "left").withColumn("timing", timing).drop("_day", "_from", "_open")


def event_window(sessions: DataFrame, announcements: DataFrame, value: str, live: int = 30, cap: int = 63) -> DataFrame:
    """Per (ticker, date, pos): the latest announcement's value while it is younger than ``live`` sessions (0 after), age and missing.

    announcements has (ticker, pos of the usable session, value); age is in sessions, at most ``cap``, and equals it where there is none.
    """
    a = announcements.select("ticker", F.col("pos").alias("_pos"), F.col(value).alias("_value"))
    found = asof_backward(sessions, a, by=["ticker"], left_on="pos", right_on="_pos", values=["_value"])
    age = F.col("pos") - F.col("_pos")
    return found.select("ticker", "date", "pos", F.when(age < live, F.coalesce("_value", F.lit(0.0))).otherwise(0.0).alias("value"),
                        F.least(F.coalesce(age, F.lit(cap)), F.lit(cap)).cast("int").alias("age"), F.col("_pos").isNull().cast("int").alias("missing"))


def share_factors(rows: DataFrame, actions: DataFrame, on: str, tasks: int | None = None) -> DataFrame:
    """Product of the ticker's action factors with ex_date at or before each row's date; 1 without any. One shuffle on the ticker."""
    per_day = actions.filter("factor > 0").groupBy("ticker", "ex_date").agg(F.product("factor").alias("_l"))
    w = by_ticker_on("ex_date").rowsBetween(Window.unboundedPreceding, 0)
    found = asof_backward(rows, per_day.withColumn("_all", F.product("_l").over(w)), by=["ticker"], left_on=on, right_on="ex_date", values=["_all"], tasks=tasks)
    return found.withColumn("factor", F.coalesce("_all", F.lit(1.0))).drop("_all", "ex_date")


def by_ticker_on(c: str):
    return Window.partitionBy("ticker").orderBy(c)


def resolution_dates(bars: DataFrame, h: int = 30) -> DataFrame:
    """ticker, date and the date h own rows later; rows not yet that old go."""
    return with_resolution(bars.select("ticker", "date"), h)


def with_resolution(bars: DataFrame, h: int = 30) -> DataFrame:
    """``bars`` with resolved_on, the date h own rows later; rows not yet that old go."""
    return bars.withColumn("resolved_on", F.lead("date", h).over(by_ticker())).filter("resolved_on is not null")


def resolve_forecasts(forecasts: DataFrame, done: DataFrame, labels: DataFrame, q: Column, order: list[Column], tasks: int | None = None) -> DataFrame:
    """Outcomes of due forecasts: newest of each (ticker, date), without those done, with a label.

    direction_ok is null where the forecast is 0; inside is judged on prices (close times exp of the return). ``tasks``:
    to how many tasks forecasts and labels are dealt (the session's number by default).
    """
    newest = latest(deal(forecasts, tasks, "ticker", "date"), ["ticker", "date"], order).join(done.select("ticker", "date").distinct(), ["ticker", "date"], "left_anti")
    due = newest.join(deal(labels.filter("target is not null").select("ticker", "date", "close", "target", "resolved_on"), tasks, "ticker", "date"), ["ticker", "date"])
    price = lambda x: F.col("close") * F.exp(x)
    right = F.when(F.col("pred") != 0, (F.col("pred") > 0) == (F.col("target") > 0))
    inside = (price(F.col("target")) >= price(F.col("pred") - q)) & (price(F.col("target")) <= price(F.col("pred") + q))
    return due.select("ticker", "date", "resolved_on", "pred", "target", right.alias("direction_ok"), inside.alias("inside"))
