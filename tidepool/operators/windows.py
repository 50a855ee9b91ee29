"""Per-instrument time windows: indicators, labels and momentum on an instrument's own rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def by_ticker():
    """A ticker's own rows in time order."""
    return Window.partitionBy("ticker").orderBy("date")


def rows(n: int):
    """The last n rows, this one included."""
    return by_ticker().rowsBetween(1 - n, 0)


def full(value: Column, over: Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null where fewer than ``least`` values (all n by default) are there."""
    return F.when(F.count(over).over(rows(n)) >= (least or n), value)


def sliding(df: DataFrame, n: int, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with aggregates (sum, min or max) over the last n rows, at the same cost a row whatever n is.

    A ticker's rows are cut into blocks of n: a frame is the end of one block and the beginning of the next, and both come from
    running aggregates within blocks, so nothing is subtracted and no frame is read twice. Nulls are passed over.
    """
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    out = df.withColumn("_i", F.row_number().over(by_ticker()) - 1).withColumn("_b", F.floor(F.col("_i") / n))
    block = Window.partitionBy("ticker", "_b")
    upto, since = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("date"), F.col("date").desc()))
    out = out.withColumns({f"_x_{c}": x for c, (_, x) in values.items()})
    out = out.withColumns({f"_s_{c}": of[f](f"_x_{c}").over(since) for c, (f, _) in values.items()})
    out = out.withColumns({f"_p_{c}": of[f](f"_x_{c}").over(upto) for c, (f, _) in values.items()})
    whole = F.col("_i") % n == n - 1  # the frame is one block

    def joined(c: str, f: str) -> Column:
        a, b = F.col(f"_p_{c}"), F.lag(f"_s_{c}", n - 1).over(by_ticker())
        both = F.least(a, b) if f == "min" else F.greatest(a, b) if f == "max" else F.coalesce(a + b, a, b)
        return F.when(whole, a).otherwise(both)

    return out.withColumns({c: joined(c, f) for c, (f, _) in values.items()}).drop("_i", "_b", *[f"_{k}_{c}" for c in values for k in "xsp"])


def held_in(c: str, n: int) -> Column:
    """How many of the last n rows hold a value: the difference of two running counts."""
    upto = F.count(c).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    before = F.count(c).over(by_ticker().rowsBetween(Window.unboundedPreceding, -n))
    return upto - before


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, c: str = "close") -> DataFrame:
    x = F.col(c)
    mid, sd = full(F.avg(x).over(rows(n)), x, n), full(F.stddev_pop(x).over(rows(n)), x, n)
    return df.withColumns({"sma": mid, "upper": mid + k * sd, "lower": mid - k * sd, "width": F.try_divide(2 * k * sd, mid)})


def stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = full(F.min("low").over(rows(n)), F.col("low"), n), full(F.max("high").over(rows(n)), F.col("high"), n)
    span = F.nullif(high - low, F.lit(0.0))
    return df.withColumns({"stoch_k": 100 * (F.col("close") - low) / span, "williams_r": -100 * (high - F.col("close")) / span})


def obv(df: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_ticker())
    signed = F.when(F.col("close") < before, -F.col("volume")).otherwise(F.col("volume"))
    return df.withColumn("signed_volume", signed).withColumn("obv", F.sum("signed_volume").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))).drop("signed_volume")


def rate_of_change(df: DataFrame, n: int = 10) -> DataFrame:
    c, v = F.lag("close", n).over(by_ticker()), F.lag("volume", n).over(by_ticker())
    return df.withColumns({"roc": 100 * (F.col("close") / F.nullif(c, F.lit(0.0)) - 1), "volume_roc": F.when(v > 0, F.col("volume") / v - 1).otherwise(0.0)})


def proximity(df: DataFrame, n: int = 252, least: int = 50) -> DataFrame:
    """Place of the close between the lowest and highest close of n rows; 0.5 where they are equal."""
    out = sliding(df.withColumn("_held", held_in("close", n)), n, {"_low": ("min", F.col("close")), "_high": ("max", F.col("close"))})
    span = F.col("_high") - F.col("_low")
    place = F.when(span == 0, 0.5).otherwise((F.col("close") - F.col("_low")) / F.nullif(span, F.lit(0.0)))
    return out.withColumn("proximity", F.when(F.col("_held") >= least, place)).drop("_held", "_low", "_high")


def lag_returns(df: DataFrame, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    return df.withColumns({f"ret_{k}": F.col("close") / F.nullif(F.lag("close", k).over(by_ticker()), F.lit(0.0)) - 1 for k in lags})


def sma_deviation(df: DataFrame, n: int = 50) -> DataFrame:
    mean = full(F.avg("close").over(rows(n)), F.col("close"), n)
    return df.withColumn("sma_deviation", 100 * (F.col("close") - mean) / F.nullif(mean, F.lit(0.0)))


def hurst(df: DataFrame, n: int = 60, lags: range = range(2, 20)) -> DataFrame:
    """Slope of log dispersion of lagged log-price differences on log lag; null unless every dispersion is positive.

    A ticker's own rows are one group (as many as there are sessions), and its frames are summed side by side.
    """
    logs = np.log(np.array(lags, float))
    weights = (logs - logs.mean()) / ((logs - logs.mean()) ** 2).sum()

    def slopes(close: np.ndarray) -> np.ndarray:
        out = np.full(len(close), np.nan)
        if len(close) < n + max(lags):
            return out
        with np.errstate(all="ignore"):
            lp = np.log(np.where(close > 0, close, np.nan))
            total = np.zeros(len(close) - n - max(lags) + 1)
            for k, w in zip(lags, weights):
                frames = np.lib.stride_tricks.sliding_window_view(lp[k:] - lp[:-k], n)[max(lags) - k:]
                off = frames - frames.mean(axis=1, keepdims=True)
                total += w * np.log((off * off).sum(axis=1) / (n - 1)) / 2
        out[n + max(lags) - 1:] = np.where(np.isfinite(total), np.clip(total, 0.0, 1.0), np.nan)
        return out

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        return rows.append_column("hurst", pa.array(slopes(rows.column("close").to_numpy()), pa.float64(), from_pandas=True))

    out = df.groupBy("ticker").applyInArrow(run, StructType([*df.schema.fields, StructField("hurst", DoubleType())]))
    return out.withColumn("hurst", F.round("hurst", 4))


def adjust(df: DataFrame) -> DataFrame:
    """Apply the adjustment factor to high and low and put the adjusted close in the place of the close."""
    f = F.coalesce(F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"high": F.col("high") * f, "low": F.col("low") * f, "close": F.coalesce("adj_close", "close")})


def forward_label(df: DataFrame, h: int = 30, c: str = "close", into: str = "target") -> DataFrame:
    """Log return over the next h of the instrument's own rows."""
    lp = safe_log(F.col(c))
    return df.withColumn(into, F.lead(lp, h).over(by_ticker()) - lp)


def true_range(df: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_ticker())
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def identical_runs(df: DataFrame, c: str = "close") -> DataFrame:
    """Longest run of equal neighbouring values of each ticker (gaps and islands over non-null values)."""
    seen = df.filter(F.col(c).isNotNull())
    new = F.when(F.col(c) == F.lag(c).over(by_ticker()), 0).otherwise(1)
    runs = seen.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ticker", "_run").agg(F.count("*").alias("n")).groupBy("ticker").agg(F.max("n").alias("longest_run"))


def market_state(df: DataFrame, short: int = 20, long: int = 60, peak: int = 252, breadth: int = 50) -> DataFrame:
    """Per date: market log return (mean over names), annualised volatility, ratio to the longer one, drawdown from the peak
    of the cumulated return, breadth (share above the mean of ``breadth`` own rows; without one counts as not above), dispersion."""
    own = df.withColumn("r", F.log(F.col("close") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0))))
    mean = full(F.avg("close").over(rows(breadth)), F.col("close"), breadth)
    per = own.withColumn("above", F.coalesce(F.col("close") > mean, F.lit(False)).cast("int")).groupBy("date").agg(
        F.avg("r").alias("market"), F.stddev_samp("r").alias("dispersion"), (F.sum("above") / F.count("close")).alias("breadth"))
    w = Window.orderBy("date")  # one row a date
    last = lambda n: w.rowsBetween(1 - n, 0)
    cum = F.sum(F.coalesce("market", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("cum", cum)
    sd = lambda n: F.when(F.count("market").over(last(n)) >= n, F.stddev_samp("market").over(last(n)))
    return per.withColumns({"vol": sd(short) * math.sqrt(252), "vol_ratio": sd(short) / F.nullif(sd(long), F.lit(0.0)),
                            "drawdown": F.col("cum") - F.max("cum").over(last(peak))}).drop("cum")


def rolling_beta(df: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """Covariance with the date's mean return over its variance, on the ticker's own last n rows; null without spread.

    A frame's sums are differences of running sums, so a row costs the same whatever n is.
    """
    own = df.withColumn("r", F.log(F.col("close") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0))))
    own = own.withColumn("m", F.avg("r").over(Window.partitionBy("date")))
    both = own.withColumn("m", F.when(F.col("r").isNotNull(), F.col("m")))
    r, m = F.coalesce("r", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_n": F.count("r"), "_r": F.sum(r), "_m": F.sum(m), "_rm": F.sum(r * m), "_mm": F.sum(m * m)}
    cum = both.withColumns({c: x.over(upto) for c, x in sums.items()})
    cum = cum.withColumns({c: F.col(c) - F.coalesce(F.lag(c, n).over(by_ticker()), F.lit(0)) for c in sums})
    k = F.nullif(F.col("_n"), F.lit(0))
    spread = F.col("_mm") - F.col("_m") * F.col("_m") / k
    beta = (F.col("_rm") - F.col("_r") * F.col("_m") / k) / F.when(spread > 1e-12 * F.col("_mm"), spread)
    return cum.withColumn("beta", F.when(F.col("_n") >= least, beta)).drop(*sums)


def reversal(df: DataFrame, k: int = 5) -> DataFrame:
    """Minus the sum of the k log returns before this row; null unless all are there."""
    own = df.withColumn("r", F.log(F.col("close") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0))))
    w = by_ticker().rowsBetween(-k, -1)
    return own.withColumn("reversal", F.when(F.count("r").over(w) == k, -F.sum("r").over(w)))
