"""Long-run variance of panels and the block length that a series' own dependence asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lagged(series: DataFrame, lags) -> DataFrame:
    """Pairs (l, t, e, b): each place with the one l before, for l up to ``lags``; an equi-join of a table with one row a date."""
    there = series.select(F.col("t").alias("_t"), F.col("e").alias("b"))
    asks = series.select("t", "e", F.explode(F.sequence(F.lit(0), lags)).alias("l")).withColumn("_t", F.col("t") - F.col("l"))
    return asks.join(there, "_t").drop("_t")


def driscoll_kraay_panel(rows: DataFrame, x: str, bandwidth: int | None = None) -> DataFrame:
    """n, dates, bandwidth, mean, se, t of a panel's mean, robust to any dependence within dates and to fading dependence in time.

    rows: date and x, any number a date. Deviations are summed by date, which keeps what names share, and the sums enter a
    Bartlett kernel of ``bandwidth`` dates, by default floor(4 (dates / 100) ^ (2 / 9)).
    """
    some = rows.filter(F.col(x).isNotNull() & ~F.isnan(x))
    whole = some.agg(F.count("*").alias("n"), F.avg(x).alias("mean"))  # one row
    per = some.groupBy("date").agg(F.sum(x).alias("_s"), F.count("*").alias("_c")).join(whole)
    per = per.select(F.row_number().over(Window.orderBy("date")).alias("t"), (F.col("_s") - F.col("_c") * F.col("mean")).alias("e"))  # one row a date
    size = per.agg(F.count("*").alias("dates")).withColumn("bandwidth", F.lit(bandwidth).cast("int") if bandwidth is not None else F.floor(4 * F.pow(F.col("dates") / 100, F.lit(2 / 9))).cast("int"))
    pairs = _lagged(per.join(size), F.col("bandwidth")).join(size)
    kernel = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("bandwidth") + 1)))
    long = pairs.groupBy("dates", "bandwidth").agg(F.sum(kernel * F.col("e") * F.col("b")).alias("s"))
    se = F.sqrt(F.greatest(F.col("s"), F.lit(0.0)) * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))) / F.col("n")
    return whole.join(long).select("n", "dates", "bandwidth", "mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"))


def block_length(series: DataFrame, x: str) -> DataFrame:
    """n, cut, circular, stationary: block lengths by Politis and White with the correction by Patton, Politis and White.

    series: date and x; dates average first. The cut is the first lag from which on max(5, floor(log10 n)) autocorrelations stay
    below 2 sqrt(log10(n) / n); autocovariances up to twice that enter with a flat-top weight. Lags up to ceil(sqrt n) plus that
    number are taken; lengths end at ceil(min(3 sqrt n, n / 3)).
    """
    per = series.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy("date").agg(F.avg(x).alias("x"))
    mean = per.agg(F.avg("x").alias("_m"), F.count("*").alias("n"))  # one row
    rows = per.join(mean).select("n", F.row_number().over(Window.orderBy("date")).alias("t"), (F.col("x") - F.col("_m")).alias("e"))  # one row a date
    quiet = F.greatest(F.lit(5), F.floor(F.log10("n")).cast("int"))
    rows = rows.withColumn("kn", quiet).withColumn("top", F.least(F.ceil(F.sqrt("n")).cast("int") + F.col("kn"), F.col("n").cast("int") - 2))
    size = rows.select("n", "kn", "top").distinct()  # one row
    pairs = _lagged(rows, F.col("top")).join(size)
    over = lambda ok, c: F.sum(F.when(ok, F.col(c) * F.col(c)).otherwise(0.0))
    lags = pairs.groupBy("n", "kn", "top", "l").agg(F.sum(F.col("e") * F.col("b")).alias("c"), over(F.col("t") - 1 > F.col("l"), "e").alias("v1"), over(F.col("t") < F.col("n"), "b").alias("v2"))
    lags = lags.withColumns({"acv": F.col("c") / F.col("n"), "loud": F.coalesce(F.abs("c") / F.sqrt(F.nullif(F.col("v1") * F.col("v2"), F.lit(0.0))), F.lit(0.0)) >= 2 * F.sqrt(F.log10("n") / F.col("n"))})
    all_ = lags.groupBy("n", "kn", "top").agg(F.array_sort(F.collect_list(F.struct("l", "acv", "loud"))).alias("a"))  # one row
    starts = F.sequence(F.lit(0), F.greatest(F.col("top") - F.col("kn"), F.lit(0)))
    calm = F.get(F.filter(starts, lambda i: ~F.exists(F.slice("a", i + 1, F.col("kn")), lambda r: r["loud"])), F.lit(0))
    one = all_.withColumn("cut", calm).withColumn("m", F.least(F.when(F.col("cut").isNotNull(), 2 * F.greatest("cut", F.lit(1))).otherwise(F.col("top")), F.col("top")))
    flat = lambda k: F.when(k / F.col("m") <= 0.5, 1.0).otherwise(2 * (1 - k / F.col("m")))
    inside = F.slice("a", F.lit(2), F.col("m"))
    one = one.withColumns({"g": F.aggregate(inside, F.lit(0.0), lambda s, r: s + 2 * flat(r["l"]) * r["l"] * r["acv"]), "lr": F.aggregate(inside, F.get("a", F.lit(0))["acv"], lambda s, r: s + 2 * flat(r["l"]) * r["acv"])})
    most = F.ceil(F.least(3 * F.sqrt("n"), F.col("n") / 3)).cast("double")
    size_of = lambda d: F.least(F.pow(2 * F.col("g") * F.col("g") / F.nullif(d * F.col("lr") * F.col("lr"), F.lit(0.0)), F.lit(1 / 3)) * F.pow(F.col("n").cast("double"), F.lit(1 / 3)), most)
    return one.select("n", "cut", size_of(F.lit(4 / 3)).alias("circular"), size_of(F.lit(2.0)).alias("stationary"))
