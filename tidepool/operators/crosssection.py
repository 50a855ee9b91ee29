"""Within-date operators: standardising, ranks, moments, sector benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    return Window.partitionBy("date")


def zscore(df: DataFrame, c: str, into: str, least: int = 10, clip: float | None = 3.0) -> DataFrame:
    """(x - mean) / sd (ddof 1) within the date; 0 on thin dates or without spread; nulls become 0."""
    x = F.col(c)
    n, mean, sd = F.count(x).over(by_date()), F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date())
    z = F.when((n >= least) & (sd > 0), (x - mean) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
    z = F.coalesce(z, F.lit(0.0))
    return df.withColumn(into, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z)


def moments(df: DataFrame, c: str, least: int = 10) -> DataFrame:
    """mean, sd and count of each date; null moments on thin dates."""
    per = df.groupBy("date").agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.count(c).alias("n"))
    thick = F.col("n") >= least
    return per.select("date", F.when(thick, F.col("m")).alias("mean"), F.when(thick, F.col("s")).alias("sd"), "n")


def causal_moments(per: DataFrame, h: int = 30, look: int = 252, least: int = 20) -> DataFrame:
    """Moments known in time: those of h dates before, averaged over ``look`` dates."""
    w = Window.orderBy("date")  # one row a date
    shifted = per.withColumns({"m1": F.lag("mean", h).over(w), "s1": F.lag("sd", h).over(w)})
    over = w.rowsBetween(1 - look, 0)
    known = lambda c: F.when(F.count(c).over(over) >= least, F.avg(c).over(over))
    return shifted.select("date", known("m1").alias("causal_mean"), known("s1").alias("causal_sd"))


def average_rank(value: Column, *keys: str) -> Column:
    """Ranks from 1 with ties at their average, within keys; null values have none."""
    w = Window.partitionBy(*keys).orderBy(value)
    upto = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # the last rank of a tie, in the same window
    return F.when(value.isNotNull(), (F.rank().over(w) + upto) / 2)


def unit_rank(df: DataFrame, c: str, into: str) -> DataFrame:
    """Average ranks of a date scaled to [-1, 1]; 0 where there is one name."""
    some = df.filter(F.col(c).isNotNull())
    n = F.count("*").over(by_date())
    return some.withColumn(into, F.when(n > 1, 2 * (average_rank(F.col(c), "date") - 1) / F.nullif(n - 1, F.lit(0)) - 1).otherwise(0.0))


def rank_ic(df: DataFrame, truth: str, pred: str, keys: list[str], least: int = 3) -> DataFrame:
    """Spearman correlation of each key with average ranks; null with a constant side or fewer than ``least`` pairs."""
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    ranked = both.select(*keys, average_rank(F.col(truth), *keys).alias("a"), average_rank(F.col(pred), *keys).alias("b"))
    spread = F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    return ranked.groupBy(*keys).agg(F.when(F.count("*") >= least, F.covar_pop("a", "b") / spread).alias("ic"), F.count("*").alias("n"))


def loo_sector_return(df: DataFrame, sectors: DataFrame, least: int = 2) -> DataFrame:
    """Mean return of the other names of the sector on the date; of all other names where the sector has too few."""
    own = df.join(sectors.select("ticker", "sector"), "ticker")
    def others(*keys: str) -> tuple[Column, Column]:
        w = Window.partitionBy(*keys)
        n = F.count("r").over(w) - F.col("r").isNotNull().cast("int")
        return n, (F.sum("r").over(w) - F.coalesce("r", F.lit(0.0))) / F.nullif(n, F.lit(0))
    (n1, m1), (n2, m2) = others("date", "sector"), others("date")
    return own.withColumns({"peers": n1, "benchmark": F.when(n1 >= least, m1).when(n2 >= least, m2), "fallback": n1 < least})


def impute_median(df: DataFrame, c: str, into: str) -> DataFrame:
    """Nulls become the date's median, or 0 where it has none."""
    return df.withColumn(into, F.coalesce(F.col(c), F.percentile(F.col(c), F.lit(0.5)).over(by_date()), F.lit(0.0)))


def within_date_residual(df: DataFrame, y: str, x: str, into: str, least: int = 3) -> DataFrame:
    """Residual of an ordinary regression of y on x within the date; null with few rows or no spread."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(ok, F.col(y)), F.when(ok, F.col(x))
    n, var = F.count(yy).over(by_date()), F.var_pop(xx).over(by_date())
    slope = F.covar_pop(yy, xx).over(by_date()) / F.nullif(var, F.lit(0.0))
    return df.withColumn(into, F.when((n >= least) & (var > 1e-12), yy - F.avg(yy).over(by_date()) - slope * (xx - F.avg(xx).over(by_date()))))
