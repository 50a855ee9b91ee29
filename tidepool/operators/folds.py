"""Purged walk-forward folds on the shared date grid, comparators and fold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.tables import deal


def date_grid(df: DataFrame) -> DataFrame:
    """date, pos: the distinct dates numbered from 0 (one row a date)."""
    return df.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def fold_table(grid: DataFrame, n_folds: int = 5, min_train: int = 500, horizon: int = 30, embargo: int = 30) -> DataFrame:
    """fold, train_end, test_start, test_end as positions: train is [0, train_end), a purge of horizon + embargo before test.

    The step is an integer division, so up to n_folds - 1 trailing dates are never tested; folds that would train on fewer
    than half of min_train dates go.
    """
    folds = grid.agg(F.count("*").alias("d")).select(F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"), F.floor((F.col("d") - min_train) / n_folds).cast("int").alias("step"))
    folds = folds.filter("step > 0").withColumn("test_start", (min_train + F.col("fold") * F.col("step")).cast("int"))
    folds = folds.withColumn("train_end", F.col("test_start") - horizon - embargo).withColumn("test_end", F.col("test_start") + F.col("step"))
    return folds.filter(F.col("train_end") >= min_train // 2).select("fold", "train_end", "test_start", "test_end")


def train_rows(df: DataFrame, grid: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows once for each fold that trains on them. folds has a handful of rows by its parameter and grid one a date, so they are broadcast."""
    return df.join(F.broadcast(grid), "date").join(F.broadcast(folds), F.col("pos") < F.col("train_end"))


def test_rows(df: DataFrame, grid: DataFrame, folds: DataFrame) -> DataFrame:
    return df.join(F.broadcast(grid), "date").join(F.broadcast(folds), (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")))


def market_mean(train: DataFrame, y: str = "target") -> DataFrame:
    """fold, mu: mean over dates of per-date means, so dates weigh the same."""
    return train.groupBy("fold", "date").agg(F.avg(y).alias("m")).groupBy("fold").agg(F.avg("m").alias("mu"))


def betas(train: DataFrame, y: str = "target", least: int = 20) -> DataFrame:
    """fold, ticker, beta: population covariance with the date's mean over its variance; 1 with few rows or no spread."""
    w = train.withColumn("m", F.avg(y).over(Window.partitionBy("fold", "date"))).filter(F.col(y).isNotNull())
    beta = F.covar_pop(y, "m") / F.nullif(F.var_pop("m"), F.lit(0.0))
    return w.groupBy("fold", "ticker").agg(F.coalesce(F.when(F.count("*") >= least, beta), F.lit(1.0)).alias("beta"))


def training_sums(rows: DataFrame, folds: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """fold, keys and sums over each fold's training rows, which are prefixes of time: rows (with pos) are summed once by the
    stretch between two folds' ends, and the few stretches of a key are added up, so no row is repeated for a fold."""
    ends = folds.agg(F.array_sort(F.collect_list("train_end")).alias("_ends"))  # one row
    cut = rows.join(F.broadcast(ends)).withColumn("_s", F.size(F.filter("_ends", lambda e: e <= F.col("pos"))))
    parts = cut.groupBy(*keys, "_s").agg(*[x.alias(c) for c, x in sums.items()])
    numbered = folds.select("fold", "train_end").join(F.broadcast(ends)).select("fold", (F.array_position("_ends", F.col("train_end")) - 1).alias("_k"))
    return parts.join(F.broadcast(numbered), F.col("_s") <= F.col("_k")).groupBy("fold", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def floor_predictions(labelled: DataFrame, n_folds: int = 5, min_train: int = 500, horizon: int = 30, embargo: int = 30, least: int = 20, tasks: int | None = None) -> DataFrame:
    """Test rows of each fold with the predictions of the floors: market (mu) and beta_market (beta times mu).

    mu is the mean over training dates of their means, beta a ticker's population covariance with the dates' means over their
    variance, 1 with few rows or no spread; both come from sums that every row enters once. ``tasks``: to how
    many tasks the rows are dealt (the session's number by default).
    """
    grid = date_grid(labelled)
    folds = fold_table(grid, n_folds, min_train, horizon, embargo)
    y = F.col("target")
    own = deal(labelled.filter(y.isNotNull()).select("date", "ticker", "target"), tasks, "date")
    placed = own.join(F.broadcast(grid), "date").withColumn("_m", F.avg(y).over(Window.partitionBy("date")))
    dates = placed.groupBy("date", "pos").agg(F.first("_m").alias("_m"))
    mu = training_sums(dates, folds, [], {"_n": F.count("*"), "_x": F.sum("_m")}).select("fold", (F.col("_x") / F.col("_n")).alias("mu"))
    m = F.col("_m")
    s = training_sums(placed, folds, ["ticker"], {"_n": F.count("*"), "_y": F.sum(y), "_x": F.sum(m), "_xy": F.sum(y * m), "_xx": F.sum(m * m)})
    spread = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n")
    beta = (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")) / F.when(spread > 1e-12 * F.col("_xx"), spread)
    beta = s.select("fold", "ticker", F.coalesce(F.when(F.col("_n") >= least, beta), F.lit(1.0)).alias("beta"))
    test = placed.join(F.broadcast(folds), (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end"))).select("fold", "date", "pos", "ticker", y.alias("y_true"))
    out = deal(test, tasks, "fold", "ticker").join(F.broadcast(mu), "fold").join(beta, ["fold", "ticker"], "left")  # mu has one row a fold
    return out.withColumns({"market": F.col("mu"), "beta_market": F.coalesce("beta", F.lit(1.0)) * F.col("mu")}).drop("mu", "beta")


def fold_metrics(preds: DataFrame, names: list[str]) -> DataFrame:
    """fold, comparator, n, mae, rmse, hit_rate (percent of equal signs; zero counts as not up)."""
    long = preds.unpivot(["fold", "date", "ticker", "y_true"], names, "comparator", "y_pred")
    err = F.col("y_pred") - F.col("y_true")
    hit = F.avg(((F.col("y_pred") > 0) == (F.col("y_true") > 0)).cast("double")) * 100
    return long.groupBy("fold", "comparator").agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), hit.alias("hit_rate"))


def annotate_floors(results: DataFrame, market: str = "market") -> DataFrame:
    """Each comparator's mae against the market floor of its fold: percent better and whether it beats it.

    The floor is read off the same rows, never computed again: a second sum in another order may differ in its last bits, and
    then the market would beat itself.
    """
    floor = F.max(F.when(F.col("comparator") == market, F.col("mae"))).over(Window.partitionBy("fold"))
    out = results.withColumn("floor_mae", floor)
    return out.withColumns({"mae_vs_market": 100 * (1 - F.col("mae") / F.nullif(F.col("floor_mae"), F.lit(0.0))), "beats_market": F.col("mae") < F.col("floor_mae")}).drop("floor_mae")


def single_factor(train: DataFrame, x: str, y: str = "target", least: int = 30) -> DataFrame:
    """fold, slope, intercept of an ordinary regression on one factor, nulls as 0; both 0 with few rows or no spread."""
    xx = F.coalesce(F.col(x), F.lit(0.0))
    rows = train.filter(F.col(y).isNotNull()).withColumn("_x", xx)
    fit = rows.groupBy("fold").agg(F.count("*").alias("n"), (F.covar_pop(y, "_x") / F.nullif(F.var_pop("_x"), F.lit(0.0))).alias("b"), F.avg(y).alias("my"), F.avg("_x").alias("mx"))
    slope = F.when(F.col("n") >= least, F.coalesce("b", F.lit(0.0))).otherwise(0.0)
    return fit.select("fold", slope.alias("slope"), F.when(F.col("n") >= least, F.col("my") - slope * F.col("mx")).otherwise(0.0).alias("intercept"))


def ridge(train: DataFrame, xs: list[str], y: str = "target", alpha: float = 1.0) -> dict[int, tuple[float, list[float]]]:
    """Intercept and coefficients of a ridge for each fold from its sums of products: (k + 2)^2 / 2 numbers a fold travel."""
    import numpy as np

    z = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in xs], F.col(y)]
    sums = [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    out = {}
    for r in train.filter(F.col(y).isNotNull()).groupBy("fold").agg(*sums).collect():  # one row a fold
        g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(z))] for i in range(len(z))], float)
        n, k = g[0, 0], len(xs)
        mean = g[0, 1:] / n
        c = g[1:, 1:] - n * np.outer(mean, mean)
        w = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k])
        out[r["fold"]] = (float(mean[k] - mean[:k] @ w), w.tolist())
    return out
