"""The panel that models read: one projected scan of signals, sessions only, macro values attached, clean numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import joins, sessions


def number(c: Column) -> Column:
    """A double; null for text that is no number, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def changes(series: DataFrame, value: str, steps: Sequence[int]) -> DataFrame:
    """``series`` (one row a date) with the relative change of a value over so many rows of its own, as <value>_<step>; rows
    without all of them go. One row a date, so one task sees them all."""
    w = Window.orderBy("date")
    out = series.withColumns({f"{value}_{n}": F.col(value) / F.nullif(F.lag(value, n).over(w), F.lit(0.0)) - 1 for n in steps})
    return out.dropna(subset=[f"{value}_{n}" for n in steps])


def load_panel(signals: DataFrame, calendar: DataFrame, features: Sequence[str], *, nullable: Sequence[str] = (), targets: Sequence[str] = ("target",),
               optional: Sequence[str] = (), macro: DataFrame | None = None, tickers: Sequence | None = None, start: str | None = None) -> DataFrame:
    """date, ticker, close, features, targets, optional columns and the macro values (all columns of ``macro`` but date).

    Only these columns are read, and ``tickers`` and ``start`` reach the scan. Rows of days without a session go; a year that
    the calendar lacks raises. Macro values are those known on the day, filled forward. Features and targets are numbers or
    null; a missing feature counts 0 unless it is nullable. Targets and optional columns that the table lacks are
    null; a missing feature column is an error. Rows are in no order: a global sort is left to whoever needs one.
    """
    has = set(signals.columns)
    rows = signals
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
    clean = lambda c: number(F.col(c)) if c in nullable else F.coalesce(number(F.col(c)), F.lit(0.0))
    rows = rows.select("date", "ticker", "close", *[clean(c).alias(c) for c in features],
                       *[(number(F.col(c)) if c in has else F.lit(None).cast("double")).alias(c) for c in targets],
                       *[(F.col(c) if c in has else F.lit(None).cast("double")).alias(c) for c in optional])
    rows = sessions.drop_non_sessions(rows, calendar)[0]
    if macro is None:
        return rows
    return rows.join(joins.fill_on_grid(rows, macro, [c for c in macro.columns if c != "date"]), "date", "left")
