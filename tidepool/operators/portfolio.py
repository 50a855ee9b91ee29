"""Rebalance books, turnover, costs and drawdown."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Round trip of a trade at default charges: a fixed value of the cost model, 0.2225 %.
ROUND_TRIP = 0.002225


def rebalance_books(preds: DataFrame, every: int = 30, quantiles: int = 5, pred: str = "y_pred") -> DataFrame:
    """Members of the top and bottom leg on every ``every``-th date with a scored row: date, ticker, leg, y_true.

    Dates with fewer than max(10, 2 quantiles) names are skipped after counting; a date whose predictions are all equal
    makes no book; order by prediction, then md5 of the ticker; a leg has max(2, n // quantiles) names.
    """
    some = preds.filter(F.col(pred).isNotNull() & F.col("y_true").isNotNull())
    days = some.select("date").distinct().withColumn("_d", F.dense_rank().over(Window.orderBy("date")) - 1).filter(F.col("_d") % every == 0)
    day = Window.partitionBy("date")
    tie = F.md5(F.col("ticker").cast("string"))
    rows = some.join(days, "date").withColumns({
        "n": F.count("*").over(day), "spread": F.max(pred).over(day) - F.min(pred).over(day),
        "down": F.row_number().over(day.orderBy(F.col(pred).desc(), tie)), "up": F.row_number().over(day.orderBy(F.col(pred).asc(), tie.desc()))})
    k = F.greatest(F.lit(2), F.floor(F.col("n") / quantiles))
    leg = F.when(F.col("down") <= k, "top").when(F.col("up") <= k, "bottom")
    book = rows.filter((F.col("n") >= max(10, 2 * quantiles)) & (F.col("spread") > 0)).withColumn("leg", leg)
    return book.filter("leg is not null").select("date", "ticker", "leg", "y_true")


def simulate(book: DataFrame, cost: float = ROUND_TRIP) -> DataFrame:
    """date, names, gross (mean return of the top leg), turnover against the last traded book, net of costs."""
    w = Window.orderBy("date")  # one row a rebalance
    held = book.filter(F.col("leg") == "top").groupBy("date").agg(F.avg("y_true").alias("gross"), F.array_sort(F.collect_set("ticker")).alias("now"))
    held = held.withColumn("before", F.coalesce(F.lag("now").over(w), F.array().cast("array<long>")))
    new, old = F.col("now"), F.col("before")
    turn = (F.size(F.array_except(new, old)) + F.size(F.array_except(old, new))) / (2 * F.greatest(F.size(new), F.size(old), F.lit(1)))
    return held.select("date", F.size("now").alias("names"), "gross", turn.alias("turnover"), (F.col("gross") - turn * cost).alias("net"))


def drawdown(path: DataFrame, c: str = "net") -> DataFrame:
    """date, cum, drawdown: expm1 of the cumulated log return less its running peak."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cum = path.withColumn("cum", F.sum(c).over(w))
    return cum.select("date", "cum", F.expm1(F.col("cum") - F.greatest(F.max("cum").over(w), F.lit(0.0))).alias("drawdown"))


def book_metrics(path: DataFrame, every: int = 30, c: str = "net") -> DataFrame:
    year = 252 / every
    vol = F.stddev_samp(c) * math.sqrt(year)
    return path.agg(F.count(c).alias("n"), F.expm1(F.avg(c) * year).alias("annual_return"), vol.alias("annual_vol"),
                    (F.avg(c) * year / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.avg((F.col(c) > 0).cast("double")).alias("win_rate"), F.avg("turnover").alias("turnover"))


def cross_sectional_report(book: DataFrame) -> DataFrame:
    """Per rebalance the means of the legs and their difference."""
    leg = lambda x: F.avg(F.when(F.col("leg") == x, F.col("y_true")))
    return book.groupBy("date").agg(leg("top").alias("top"), leg("bottom").alias("bottom"), (leg("top") - leg("bottom")).alias("spread"))


def tie_decided(preds: DataFrame, pred: str, quantiles: int = 5) -> DataFrame:
    """date, n, top_arbitrary: the share of the top leg that equal predictions at its cut had to fill; 1 where the leg takes every name."""
    day = Window.partitionBy("date")
    rows = preds.filter(F.col(pred).isNotNull()).withColumns({"n": F.count("*").over(day), "_r": F.row_number().over(day.orderBy(F.col(pred).desc()))})
    k = F.greatest(F.lit(2), F.floor(F.col("n") / quantiles))
    cut = rows.withColumn("_k", k).withColumn("_cut", F.min(F.when(F.col("_r") <= F.col("_k"), F.col(pred))).over(day))
    above, level = F.sum((F.col(pred) > F.col("_cut")).cast("long")), F.sum((F.col(pred) == F.col("_cut")).cast("long"))
    free = F.when(level > F.col("_k") - above, F.col("_k") - above).otherwise(0)
    return cut.groupBy("date", "n", "_k").agg(F.when(F.col("n") <= F.col("_k"), 1.0).otherwise(free / F.col("_k")).alias("top_arbitrary")).drop("_k")


def simulate_hedged(book: DataFrame, beta: DataFrame, market: DataFrame, cost: float = ROUND_TRIP) -> DataFrame:
    """date, hedge, gross, turnover, net of a top leg hedged by its mean beta (1 where unknown) times the date's market return.

    Half of the hedge's change adds to the turnover.
    """
    w = Window.orderBy("date")  # one row a rebalance
    hedge = book.filter("leg = 'top'").join(beta.select("date", "ticker", "beta"), ["date", "ticker"], "left").groupBy("date").agg(F.avg(F.coalesce("beta", F.lit(1.0))).alias("hedge"))
    path = simulate(book, cost).join(hedge, "date").join(market.select("date", "market_return"), "date")
    path = path.withColumn("turnover", F.col("turnover") + F.abs(F.col("hedge") - F.coalesce(F.lag("hedge").over(w), F.lit(0.0))) / 2)
    gross = F.col("gross") - F.col("hedge") * F.col("market_return")
    return path.select("date", "hedge", gross.alias("gross"), "turnover", (gross - F.col("turnover") * cost).alias("net"))


def one_way_cost(side: str, tax: float, stamp: float, fees: float, impact: float, levy: float = 0.18) -> float:
    """Charges of one trade: tax, stamp duty on buys only, fees with the levy on them, impact."""
    if side not in ("buy", "sell"):
        raise ValueError(side)
    return tax + (stamp if side == "buy" else 0.0) + fees * (1 + levy) + impact


def break_even_ic(turnover: float, spread_per_ic: float, cost: float = ROUND_TRIP) -> float:
    """Rank correlation at which the spread pays for the trades."""
    if spread_per_ic <= 0:
        raise ValueError("the spread per rank correlation must be positive")
    return turnover * cost / spread_per_ic
