"""Hyperparameters chosen on purged inner folds: candidates are rows beside the folds, so all are scored in one plan."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import crosssection as xs

#: Score of a fold whose predictions have no ordering: a fixed value, worse than any rank correlation.
NO_ORDERING = 1.0


def own_folds(rows: DataFrame, key: str, n_folds: int = 3, horizon: int = 30) -> DataFrame:
    """key, fold, train_end, test_start, test_end: purged folds on each key's own rows (pos from 0), the gap twice the horizon.

    The first test begins at max(120, rows div 3); a fold that trains on less than half of that goes.
    """
    return _cut(rows.groupBy(key).agg(F.count("*").alias("n")), n_folds, horizon).select(key, "fold", "train_end", "test_start", "test_end")


def _cut(sized: DataFrame, n_folds: int, horizon: int) -> DataFrame:
    """``sized`` (n, the number of the key's rows) once for each fold of :func:`own_folds`, with its bounds."""
    cut = sized.withColumn("_first", F.greatest(F.lit(120), F.floor(F.col("n") / 3))).filter("n > _first")
    cut = cut.withColumn("_step", F.greatest(F.lit(1), F.floor((F.col("n") - F.col("_first")) / n_folds))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = F.col("_first") + F.col("fold") * F.col("_step")
    cut = cut.withColumns({"train_end": start - 2 * horizon, "test_start": start, "test_end": F.least(start + F.col("_step"), F.col("n"))})
    return cut.filter((F.col("train_end") >= F.floor(F.col("_first") / 2)) & (F.col("test_end") > F.col("test_start"))).drop("_first", "_step")


def purged_cv(rows: DataFrame, key: str, x: str, y: str, alphas: list[float], n_folds: int = 3, horizon: int = 30, least_train: int = 50, least_test: int = 10) -> DataFrame:
    """key, alpha, mae, rank_ic (its negative mean, so smaller is better for both) of a ridge on one column by purged inner folds.

    rows: key, date, x, y. Sums of products of a fold's training rows serve all candidates; test rows meet every candidate as
    rows. All of it are windows within a key, so the rows are read once and not shuffled again. A fold without an ordering costs NO_ORDERING; folds with too few rows are left out; rank correlations are taken within folds.
    """
    own = Window.partitionBy(key)
    placed = rows.withColumns({"pos": F.row_number().over(own.orderBy("date")) - 1, "n": F.count("*").over(own)}).withColumn("_x", F.coalesce(F.col(x), F.lit(0.0)))
    some = _cut(placed.filter(F.col(y).isNotNull()).select(key, "pos", "n", "_x", y), n_folds, horizon)
    train, test = F.col("pos") < F.col("train_end"), (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end"))
    tx, ty, w = F.when(train, F.col("_x")), F.when(train, F.col(y)), Window.partitionBy(key, "fold")
    sums = {"_n": F.count(tx), "_mx": F.avg(tx), "_my": F.avg(ty), "_vx": F.var_pop(tx), "_cxy": F.covar_pop(tx, ty), "_m": F.sum(test.cast("int"))}
    both = some.filter(train | test).withColumns({c: v.over(w) for c, v in sums.items()}).withColumns({"_xx": F.col("_vx") * F.col("_n"), "_xy": F.col("_cxy") * F.col("_n")})
    both = both.filter(test & (F.col("_n") >= least_train) & (F.col("_m") >= least_test)).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    pred = both.withColumn("_p", F.col("_my") + F.col("_xy") / (F.col("_xx") + F.col("alpha")) * (F.col("_x") - F.col("_mx")))
    cell = [key, "alpha", "fold"]
    ranked = pred.select(*cell, F.abs(F.col("_p") - F.col(y)).alias("_err"), xs.average_rank(F.col(y), *cell).alias("a"), xs.average_rank(F.col("_p"), *cell).alias("b"))
    ic = F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    scored = ranked.groupBy(*cell).agg(F.avg("_err").alias("_e"), F.coalesce(-F.when(F.count("*") >= 3, ic), F.lit(NO_ORDERING)).alias("_i"))
    return scored.groupBy(key, "alpha").agg(F.avg("_e").alias("mae"), F.avg("_i").alias("rank_ic"))


def best(scores: DataFrame, key: str, by: str) -> DataFrame:
    """The candidate with the smallest score of each key, ties to the smallest alpha."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(by, "alpha"))
    return scores.withColumn("_n", n).filter("_n = 1").drop("_n")


def density_search(score: Callable[[float], float], low: float, high: float, trials: int = 30, seed: int = 7, first: int = 8, good: float = 0.25, draws: int = 24) -> tuple[float, float, list[tuple[float, float]]]:
    """(point, score, history): smallest score on [low, high] by tree-structured Parzen estimates, seeded and bounded.

    After ``first`` uniform points, those with the best scores and the others are each a mixture of normals on a floor of the
    uniform density; of ``draws`` points from the first the one with the largest ratio of densities is tried next. A score that
    is no number counts as worst.
    """
    rng, seen = random.Random(seed), []
    for t in range(trials):
        if t < first:
            x = rng.uniform(low, high)
        else:
            ranked = sorted(seen, key=lambda p: p[1])
            n = max(2, math.ceil(good * len(ranked)))
            fine, rest = [p for p, _ in ranked[:n]], [p for p, _ in ranked[n:]]
            width = max((high - low) / math.sqrt(len(seen)) / 2, (high - low) / 50)
            density = lambda points, u: (1 / (high - low) + sum(math.exp(-((u - p) / width) ** 2 / 2) / width / 2.5066282746310002 for p in points)) / (len(points) + 1)
            x = max((min(high, max(low, rng.gauss(rng.choice(fine), width))) for _ in range(draws)), key=lambda u: density(fine, u) / density(rest, u))
        s = score(x)
        seen.append((x, s if math.isfinite(s) else math.inf))
    x, s = min(seen, key=lambda p: p[1])
    return x, s, seen
