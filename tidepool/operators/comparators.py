"""Comparators without a model: constants learned from a fold's own training rows, their table and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the panel that each comparator reads.
COLUMNS = {"zero": (), "train_mean": (), "majority": (), "always_up": (), "market": (), "beta_market": (), "single_factor": ("roc",), "ridge_factors": ("roc", "volume_roc"),
           "regime_ridge": ("beta_vol", "beta_drawdown"), "news_ridge": ("n_articles", "mean_score")}


def constants(train: DataFrame, y: str = "target") -> DataFrame:
    """fold, train_mean and majority (1 if half of the labels or more are up, else -1); one row a fold."""
    up = F.avg((F.col(y) > 0).cast("double"))
    return train.groupBy("fold").agg(F.avg(y).alias("train_mean"), F.when(up >= 0.5, 1.0).otherwise(-1.0).alias("majority"))


def constant_predictions(train: DataFrame, test: DataFrame, y: str = "target") -> DataFrame:
    """Test rows (fold, date, ticker, y_true) with the predictions zero, train_mean, majority and always_up."""
    return test.join(constants(train, y), "fold").withColumns({"zero": F.lit(0.0), "always_up": F.lit(1.0)})


def comparison(metrics: DataFrame) -> DataFrame:
    """comparator, folds, mae and hit_rate, means over folds. Folds are added in their order, so comparators that are equal in every
    fold have equal means whatever the order of the rows. A comparator has one row a fold."""
    rows = F.array_sort(F.collect_list(F.struct("fold", "mae", "hit_rate")))

    def mean(c: str) -> Column:
        some = F.filter(F.col("_r"), lambda x: x[c].isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda total, x: total + x[c]) / F.size(some)).alias(c)

    return metrics.groupBy("comparator").agg(F.count("*").alias("folds"), rows.alias("_r")).select("comparator", "folds", mean("mae"), mean("hit_rate"))


def best(table: DataFrame, metric: str, name: str = "comparator") -> DataFrame:
    """The name with the largest finite metric, ties to the first name; no row without one."""
    ok = table.filter(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) != float("inf")))
    return ok.agg(F.min_by(name, F.struct(-F.col(metric), name)).alias("best"), F.max(metric).alias("value")).filter("best is not null")


def ridge_of_two(train: DataFrame, a: str, b: str, y: str = "target", alpha: float = 1.0) -> DataFrame:
    """fold, intercept and the coefficients of a ridge on two columns, nulls as 0, in closed form: one aggregation, no driver."""
    p, q = F.coalesce(F.col(a), F.lit(0.0)), F.coalesce(F.col(b), F.lit(0.0))
    s = train.filter(F.col(y).isNotNull()).withColumns({"_p": p, "_q": q}).groupBy("fold").agg(
        F.count("*").alias("n"), F.avg("_p").alias("mp"), F.avg("_q").alias("mq"), F.avg(y).alias("my"),
        *[F.covar_pop(u, v).alias(k) for k, u, v in (("pp", "_p", "_p"), ("qq", "_q", "_q"), ("pq", "_p", "_q"), ("py", "_p", y), ("qy", "_q", y))])
    n = F.col("n")
    pp, qq, pq, py, qy = (F.col(c) * n for c in ("pp", "qq", "pq", "py", "qy"))
    det = (pp + alpha) * (qq + alpha) - pq * pq
    wp, wq = ((qq + alpha) * py - pq * qy) / det, ((pp + alpha) * qy - pq * py) / det
    return s.select("fold", (F.col("my") - F.col("mp") * wp - F.col("mq") * wq).alias("intercept"), wp.alias("w1"), wq.alias("w2"))


def purge_for(horizon: Column, floor: int = 63) -> Column:
    """Purge, and equal embargo, of a horizon in sessions; a horizon or floor that is not positive is an error, never a fold without a gap."""
    if floor <= 0:
        raise ValueError("the floor must be positive")
    return F.when(horizon > 0, F.greatest(horizon, F.lit(floor))).otherwise(F.raise_error(F.lit("a horizon must be positive")).cast("int"))


def series_folds(counts: DataFrame, key: str, n: str = "n", n_folds: int = 5, min_train: int = 100, horizon: int = 30, embargo: int = 30) -> DataFrame:
    """Purged folds of each single series from its number of rows: key, fold, train_end, test_start, test_end (positions).

    Folds that would train on fewer than half of min_train rows go; rows after the last full step are never tested."""
    step = F.floor((F.col(n) - min_train) / n_folds).cast("int")
    f = counts.select(key, step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")).filter("step > 0")
    f = f.withColumn("test_start", min_train + F.col("fold") * F.col("step"))
    f = f.withColumns({"train_end": F.col("test_start") - horizon - embargo, "test_end": F.col("test_start") + F.col("step")})
    return f.filter(F.col("train_end") >= min_train // 2).select(key, "fold", "train_end", "test_start", "test_end")


def leakage(train: DataFrame, test: DataFrame, horizon: int, pos: str = "pos") -> DataFrame:
    """fold, last_train, first_test and ok: whether the last training label ends before the first test row."""
    a, b = train.groupBy("fold").agg(F.max(pos).alias("last_train")), test.groupBy("fold").agg(F.min(pos).alias("first_test"))
    return a.join(b, "fold").withColumn("ok", F.col("last_train") + horizon < F.col("first_test"))


def assert_no_leakage(train: DataFrame, test: DataFrame, horizon: int, pos: str = "pos") -> None:
    """Raise if a fold's training labels reach its test rows."""
    bad = leakage(train, test, horizon, pos).filter("not ok").limit(5).collect()
    if bad:
        raise ValueError(f"training labels reach test rows: {[r.asDict() for r in bad]}")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def positive_chance(theta: Column, variance: Column) -> Column:
    """P(theta > 0) of a normal posterior; without variance 1, 0.5 or 0 by the sign."""
    return F.when(variance > 0, normal_cdf(theta / F.sqrt(variance))).otherwise(F.when(theta > 0, 1.0).when(theta < 0, 0.0).otherwise(0.5))
