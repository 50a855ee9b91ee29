"""Inference and calibration: multiplicity, shrinkage, long-run variance, conformal intervals, reliability."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.10, dependent: bool = False) -> DataFrame:
    """Step-up mask ``significant`` over all rows (dependent: the bound that holds under any dependence)."""
    w = Window.orderBy(p)  # one row a hypothesis
    m = F.count("*").over(Window.partitionBy())
    ranked = df.withColumns({"_r": F.row_number().over(w), "_m": m})
    ranked = ranked.withColumn("_h", F.sum(1.0 / F.col("_r")).over(Window.partitionBy()) if dependent else F.lit(1.0))  # 1 + 1/2 + ... + 1/m, once
    bound = F.lit(q) / F.col("_h")
    ranked = ranked.withColumn("_ok", F.when(F.col(p) <= bound * F.col("_r") / F.col("_m"), F.col("_r")))
    return ranked.withColumn("significant", F.col("_r") <= F.coalesce(F.max("_ok").over(Window.partitionBy()), F.lit(0))).drop("_r", "_m", "_h", "_ok")


def dersimonian_laird(df: DataFrame, x: str, var: str) -> DataFrame:
    """k, mean, q and tau2 = max(0, (q - (k - 1)) / c) of effects with their variances."""
    w = 1 / F.col(var)
    s = df.agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(x)).alias("wx"), F.sum(w * F.col(x) * F.col(x)).alias("wxx"))
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    c = F.nullif(F.col("w") - F.col("w2") / F.col("w"), F.lit(0.0))
    return s.select("k", (F.col("wx") / F.col("w")).alias("mean"), q.alias("q"), F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / c).alias("tau2"))


def shrink(x: Column, var: Column, mean: Column, tau2: Column) -> Column:
    """Posterior mean of an effect: B mean + (1 - B) x with B = var / (var + tau2)."""
    b = var / F.nullif(var + tau2, F.lit(0.0))
    return b * mean + (1 - b) * x


def driscoll_kraay(per_date: DataFrame, x: str, lags: int = 30) -> DataFrame:
    """Mean, standard error with Bartlett weights over ``lags`` dates, and t of a series with one row a date."""
    w = Window.orderBy("date")
    e = per_date.filter(F.col(x).isNotNull()).withColumn("_e", F.col(x) - F.avg(x).over(Window.partitionBy()))
    e = e.withColumns({f"_l{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    s = e.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.sum(F.col("_e") ** 2).alias("g0"), *[F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    long = F.col("g0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0))
    se = F.sqrt(F.greatest(long, F.lit(0.0))) / F.col("n")
    return s.select("n", "mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"))


#: Shares at which a bucketed column is cut; between two cuts the buckets are equally wide.
CUTS = (0.005, 0.1, 0.25, 0.5, 0.75, 0.9, 0.995)


def bucketed(df: DataFrame, keys: list[str], x: str, buckets: int = 200, few: bool = False) -> DataFrame:
    """Rows with _b, the bucket of x: equal values share one, buckets are in the order of x, ``buckets`` of them between two cuts.

    The cuts are approximate quantiles of the keys (``few``: so few keys that the cuts are broadcast). Ranks inside a bucket plus the counts of the buckets before it are exact
    whatever the cuts, and no key is sorted in one task. Every step (compare, subtract, divide, floor) keeps the order of doubles.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(x, F.lit(np.array(CUTS)), 2000).alias("_cuts"))
    v, cut = F.col(x), [F.get("_cuts", F.lit(i)) for i in range(len(CUTS))]
    place = F.when(v <= cut[0], 0)
    for i in range(1, len(CUTS)):
        part = (v - cut[i - 1]) / F.nullif(cut[i] - cut[i - 1], F.lit(0.0)) * (buckets - 1)
        place = place.when(v <= cut[i], 1 + (i - 1) * buckets + F.floor(part).cast("int"))
    return df.join(F.broadcast(cuts) if few else cuts, keys).withColumn("_b", place.otherwise(1 + (len(CUTS) - 1) * buckets)).drop("_cuts")


def quantiles(df: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """One row, ``q``: the exact quantiles of the non-null x at ``shares``, interpolated between neighbours; null without any.

    Equal values are counted first, then buckets; only the buckets that hold the neighbours are sorted, so no task sees all rows.
    """
    values = bucketed(df.filter(F.col(x).isNotNull()).select(F.lit(0).alias("_g"), F.col(x).cast("double").alias("_x")).groupBy("_g", "_x").agg(F.count("*").alias("_c")), ["_g"], "_x", few=True)
    per = values.groupBy("_b").agg(F.sum("_c").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # at most one row a bucket
    per = per.withColumns({"_upto": upto, "_all": F.sum("_n").over(Window.partitionBy())})
    at = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") + 1 for a in at for f in (F.floor, F.ceil)]))
    per = per.withColumn("_k", F.explode(ranks)).filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
    inside = values.join(F.broadcast(per.select("_b", "_k", "_all", (F.col("_upto") - F.col("_n")).alias("_before"))), "_b")  # a row a rank
    run = F.col("_before") + F.sum("_c").over(Window.partitionBy("_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_run", run).groupBy("_k", "_all").agg(F.min(F.when(F.col("_run") >= F.col("_k"), F.col("_x"))).alias("_v"))
    one = found.agg(F.max("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))  # one row a rank
    value = lambda k: F.try_element_at("_m", k.cast("long") + 1)
    return one.select(F.array(*[value(F.floor(a)) + (value(F.ceil(a)) - value(F.floor(a))) * (a - F.floor(a)) for a in at]).alias("q"))


def nth_smallest(df: DataFrame, keys: list[str], x: str, nth: Column) -> DataFrame:
    """keys, n, value: the nth smallest non-null x of each key, nth an expression of n (the key's count).

    Equal values are counted first; only the bucket that holds the nth value is sorted.
    """
    values = bucketed(df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_c")), keys, "_x")
    w = Window.partitionBy(*keys)
    per = values.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))  # at most one row a bucket
    per = per.withColumns({"n": F.sum("_n").over(w), "_upto": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))})
    per = per.withColumn("_k", nth).filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))).withColumn("_before", F.col("_upto") - F.col("_n"))
    inside = values.join(per.select(*keys, "_b", "n", "_k", "_before"), [*keys, "_b"])
    run = F.col("_before") + F.sum("_c").over(w.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_run", run).groupBy(*keys, "n").agg(F.min(F.when(F.col("_run") >= F.col("_k"), F.col("_x"))).alias("value"))


def distributed_rank(df: DataFrame, keys: list[str], x: str, into: str) -> DataFrame:
    """Average ranks of non-null x within keys that may each hold most rows: counts of equal values, ranked by bucket."""
    values = bucketed(df.filter(F.col(x).isNotNull()).select(*keys, x).groupBy(*keys, x).agg(F.count("*").alias("_c")), keys, x)
    w = Window.partitionBy(*keys)
    per = values.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("_upto", upto).join(per, [*keys, "_b"])
    rank = F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2
    return df.join(ranked.select(*keys, x, rank.alias(into)), [*keys, x])


def conformal_quantile(df: DataFrame, keys: list[str], y: str, pred: str, coverage: float = 0.8, least: int = 20) -> DataFrame:
    """keys, n, q: the k-th smallest absolute residual, k = min(n, ceil((n + 1) coverage)); null below ``least`` residuals."""
    r = df.select(*keys, F.abs(F.col(y) - F.col(pred)).alias("r"))
    out = nth_smallest(r, keys, "r", F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(coverage))))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("value")).alias("q"))


def expanding_coverage(preds: DataFrame, y: str, pred: str, coverage: float = 0.8) -> DataFrame:
    """fold, n, coverage: share of a fold's residuals within the quantile of all folds before it."""
    r = preds.select("fold", F.abs(F.col(y) - F.col(pred)).alias("r"))
    later = r.select(F.col("fold").alias("f")).distinct()
    before = r.join(F.broadcast(later), F.col("fold") < F.col("f")).select(F.col("f"), F.lit(0.0).alias("z"), "r")
    q = conformal_quantile(before, ["f"], "r", "z", coverage).select("f", "q")
    return r.join(F.broadcast(q), F.col("fold") == F.col("f")).groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("r") <= F.col("q")).cast("double")).alias("coverage"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(p) - (F.col(y) > 0).cast("double")) ** 2).alias("brier"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, up_share over right-closed bins, the lowest value in the first."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col(y) > 0).cast("double")).alias("up_share"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, clipped to [0, 1]."""
    p, d = hits / F.nullif(n, F.lit(0)), 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def t_statistic(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    se = F.nullif(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.avg(x) / se).alias("t"))


def effective_size(n: int, horizon: int) -> float:
    return max(n / horizon, 1.0)


def metric_block(preds: DataFrame, y: str, pred: str, horizon: int = 30, least_folds: int = 3) -> DataFrame:
    """One row: n, n_eff, ic (mean over folds of the rank correlation, null below ``least_folds`` scored folds), t, mae, rmse and
    naive_hit, the percentage that the more frequent direction alone would reach. Zero is not up."""
    both = preds.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).select("fold", F.col(y).alias("_y"), F.col(pred).alias("_p"))
    ranked = distributed_rank(distributed_rank(both, ["fold"], "_y", "_a"), ["fold"], "_p", "_b2")
    ic = F.covar_pop("_a", "_b2") / F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b2"), F.lit(0.0))
    ics = ranked.groupBy("fold").agg(ic.alias("ic")).agg(F.when(F.count("ic") >= least_folds, F.avg("ic")).alias("ic"))
    up, err = F.avg((F.col("_y") > 0).cast("double")), F.col("_p") - F.col("_y")
    all_rows = both.agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), (F.greatest(up, 1 - up) * 100).alias("naive_hit"))
    size = F.greatest(F.col("n") / horizon, F.lit(1.0))
    return all_rows.join(ics).select("n", size.alias("n_eff"), "ic", (F.col("ic") * F.sqrt(F.greatest(size - 1, F.lit(1.0)))).alias("t"), "mae", "rmse", "naive_hit")  # one row each


def rank_product(df: DataFrame, y: str, pred: str) -> DataFrame:
    """product per row: p t over the root of the date's mean p^2 times its mean t^2, of ranks with mean 0."""
    day = Window.partitionBy("date")
    scale = F.sqrt(F.avg(F.col(pred) ** 2).over(day) * F.avg(F.col(y) ** 2).over(day))
    return df.withColumn("product", F.col(pred) * F.col(y) / F.nullif(scale, F.lit(0.0)))


def cell_degeneracy(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """keys, n, mode_share (share of the most frequent exact value) and unique_fraction, by counts of equal values."""
    per = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_c"))
    return per.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.max("_c") / F.sum("_c")).alias("mode_share"), (F.count("*") / F.sum("_c")).alias("unique_fraction"))


def coverage_gate(coverage: DataFrame, overall: tuple[float, float] = (0.75, 0.85), each: tuple[float, float] = (0.70, 0.90)) -> DataFrame:
    """fold, n, coverage, ok for each fold that has one and, under fold -1, for all of them together."""
    some = coverage.filter("coverage is not null")
    whole = some.agg(F.lit(-1).alias("fold"), F.sum("n").alias("n"), (F.sum(F.col("coverage") * F.col("n")) / F.sum("n")).alias("coverage"))
    rows = some.select("fold", "n", "coverage").withColumn("ok", F.col("coverage").between(*each))
    return rows.union(whole.filter("n is not null").withColumn("ok", F.col("coverage").between(*overall)))


def expected_best_sharpe(trials: int, spread: float = 1.0) -> float:
    """Expected largest Sharpe ratio of so many trials without skill (0 for one trial)."""
    from statistics import NormalDist

    if trials < 2:
        return 0.0
    euler, q = 0.5772156649015329, NormalDist().inv_cdf
    return spread * ((1 - euler) * q(1 - 1 / trials) + euler * q(1 - 1 / (trials * math.e)))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))
