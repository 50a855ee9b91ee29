"""Benchmark levels, excess labels, price breaks and relative candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.windows import by_ticker, forward_label, safe_log


def benchmark_level(returns: DataFrame, c: str = "benchmark") -> DataFrame:
    """level and voids of each ticker's benchmark: exp of the running sum, a null return counts as 0 and as one void, a first row never is void."""
    first = F.row_number().over(by_ticker()) == 1
    marked = returns.withColumn("_void", F.when(first | F.col(c).isNotNull(), 0).otherwise(1))
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumns({"level": F.exp(F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(w)), "voids": F.sum("_void").over(w)}).drop("_void")


def excess_label(levels: DataFrame, h: int = 30, c: str = "close") -> DataFrame:
    """target, benchmark_target and excess over the next h own rows; the last two null where a void lies in the window."""
    out = forward_label(forward_label(levels, h, c, "target"), h, "level", "_b")
    clean = F.lead("voids", h).over(by_ticker()) == F.col("voids")
    out = out.withColumn("benchmark_target", F.when(clean, F.col("_b"))).drop("_b")
    return out.withColumn("excess", F.col("target") - F.col("benchmark_target"))


def adjustment_breaks(bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows whose adjustment ratio moved by more than the tolerance against the row before: ticker, date, ratio, shift."""
    ratio = F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0))
    own = bars.select("ticker", "date", ratio.alias("ratio"))
    own = own.withColumn("shift", F.col("ratio") / F.nullif(F.lag("ratio").over(by_ticker()), F.lit(0.0)) - 1)
    return own.filter(F.abs("shift") > tolerance)


def relative_candles(bars: DataFrame, level: Column) -> DataFrame:
    """Open, high, low and close over a benchmark level, null where it is not positive; volume as it was."""
    base = F.when(level > 0, level)
    return bars.withColumns({c: F.col(c) / base for c in ("open", "high", "low", "close")})


def price_view(rows: DataFrame, price: str, pred: str, q: Column) -> DataFrame:
    """expected, low and high price of a predicted log return and its half width."""
    at = lambda x: F.col(price) * F.exp(x)
    return rows.withColumns({"expected": at(F.col(pred)), "low_price": at(F.col(pred) - q), "high_price": at(F.col(pred) + q)})


def series_comparators(bars: DataFrame, h: int = 30, context: int = 512, least: int = 90) -> DataFrame:
    """Forecasts of the log price's own history up to each row: none (0), its last h-row change, its drift over the context times h.

    Rows without a usable price go first; with fewer than ``least`` values in the context a forecast abstains (0).
    """
    v = bars.withColumn("v", safe_log(F.col("close"))).filter("v is not null")
    w = by_ticker().rowsBetween(1 - context, 0)
    n = F.count("v").over(w)
    last = F.col("v") - F.lag("v", h).over(by_ticker())
    drift = (F.col("v") - F.first("v").over(w)) / F.nullif(n - 1, F.lit(0)) * h
    ready = lambda x: F.when(n >= least, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return v.withColumns({"series_zero": F.lit(0.0), "series_last_return": ready(last), "series_drift": ready(drift)}).drop("v")
