"""Long-short books: one rebalance at a time, two of them compared net of costs, and cohorts that overlap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.portfolio import ROUND_TRIP


def long_short(book: DataFrame, cost: float = ROUND_TRIP) -> DataFrame:
    """date, gross, turnover, net of the top leg less the bottom leg of a book of legs, by rebalance.

    Turnover is the mean over both legs of the share of names that changed against the rebalance before.
    """
    w = Window.orderBy("date")  # one row a rebalance
    of = lambda leg, x: F.when(F.col("leg") == leg, x)
    held = book.groupBy("date").agg(F.avg(of("top", F.col("y_true"))).alias("up"), F.avg(of("bottom", F.col("y_true"))).alias("down"), *[F.array_sort(F.collect_set(of(leg, F.col("ticker")))).alias(leg) for leg in ("top", "bottom")])

    def turn(leg: str):
        new, old = F.col(leg), F.coalesce(F.lag(leg).over(w), F.array().cast("array<long>"))
        return (F.size(F.array_except(new, old)) + F.size(F.array_except(old, new))) / (2 * F.greatest(F.size(new), F.size(old), F.lit(1)))

    path = held.withColumn("turnover", (turn("top") + turn("bottom")) / 2).withColumn("gross", F.col("up") - F.col("down"))
    return path.select("date", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost).alias("net"))


def _t(c: str):
    return F.when((F.count(c) >= 3) & (F.stddev_samp(c) > 0), F.avg(c) / (F.stddev_samp(c) / F.sqrt(F.count(c))))


def book_summary(path: DataFrame, every: int = 30) -> DataFrame:
    """One row: rebalances, mean gross and net, their t, mean turnover and the yearly Sharpe ratio of the net."""
    sharpe = F.when((F.count("net") >= 3) & (F.stddev_samp("net") > 0), F.avg("net") / F.stddev_samp("net") * math.sqrt(252 / every))
    return path.agg(F.count("*").alias("n"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), _t("gross").alias("t_gross"), _t("net").alias("t_net"), F.avg("turnover").alias("turnover"), sharpe.alias("sharpe"))


def net_of_cost(base: DataFrame, arm: DataFrame) -> DataFrame:
    """One row that compares two paths on the rebalances of both: means of each and the difference of net returns with its t."""
    j = base.select("date", *[F.col(c).alias(f"{c}_a") for c in ("gross", "net", "turnover")]).join(arm.select("date", *[F.col(c).alias(f"{c}_b") for c in ("gross", "net", "turnover")]), "date").withColumn("d", F.col("net_b") - F.col("net_a"))
    return j.agg(F.count("*").alias("n"), *[F.avg(f"{c}_{s}").alias(f"{c}_{s}") for s in "ab" for c in ("gross", "net", "turnover")], F.avg("d").alias("difference"), _t("d").alias("t"))


def cohort_book(legs: DataFrame, returns: DataFrame, hold: int, cohorts: int, cost: float = ROUND_TRIP) -> DataFrame:
    """pos, gross, turnover, net per session of a book that holds its last ``cohorts`` cohorts, each for ``hold`` sessions.

    legs: pos of a cohort's session, ticker, leg (top or bottom); returns: pos, ticker, r. A cohort is long its top leg and
    short its bottom leg, equal weights within a leg and 1 / ``cohorts`` of the book, from the session after its own on.
    Weights are netted by name, so what one cohort drops and another takes up is not traded: turnover is half the sum of the
    changes of net weights. Missing returns are 0. A cohort makes ``hold`` rows for each name; the changes come from its first
    and last session alone.
    """
    size = F.count("*").over(Window.partitionBy("pos", "leg"))
    w = legs.select("pos", "ticker", (F.when(F.col("leg") == "top", 1.0).otherwise(-1.0) / size / cohorts).alias("w"))
    held = w.select(F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + hold)).alias("pos"), "ticker", "w").groupBy("pos", "ticker").agg(F.sum("w").alias("w"))
    gross = held.join(returns.select("pos", "ticker", "r"), ["pos", "ticker"], "left").groupBy("pos").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    moves = w.select((F.col("pos") + 1).alias("pos"), "ticker", "w").union(w.select((F.col("pos") + hold + 1).alias("pos"), "ticker", -F.col("w")))
    traded = moves.groupBy("pos", "ticker").agg(F.sum("w").alias("x")).groupBy("pos").agg((F.sum(F.abs("x")) / 2).alias("turnover"))
    last = returns.agg(F.max("pos").alias("_last"))  # one row
    path = gross.join(traded, "pos", "full").join(last).filter(F.col("pos") <= F.col("_last")).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("gross", "turnover")})
    return path.select("pos", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost).alias("net"))
