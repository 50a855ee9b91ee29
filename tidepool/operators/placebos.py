"""Placebos: permutations within dates, constant levels, planted signals and the bands of nothing. Draws are md5 values of a
seed and the row's keys, so every engine and every rerun draws alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import crosssection as xs


def draw(*parts: Column) -> Column:
    """32 hexadecimal digits for these parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform(digest: Column, at: int = 1) -> Column:
    """A number in (0, 1) from 12 digits of a draw."""
    return (F.conv(F.substring(digest, at, 12), 16, 10).cast("long") + 0.5) / float(16**12)


def normal(digest: Column) -> Column:
    """A standard normal number from a draw (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(digest))) * F.cos(2 * math.pi * uniform(digest, 13))


def permute_within(df: DataFrame, keys: list[str], by: str, columns: list[str], seed: Column) -> DataFrame:
    """``df`` with ``columns`` permuted jointly among the rows of each key: the i-th row takes those of the i-th in drawn order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    drawn = F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, *[F.col(k) for k in keys], F.col(by)), by))
    there = df.select(*keys, drawn.alias("_i"), F.struct(*columns).alias("_x"))
    rest = df.withColumn("_i", place).drop(*columns)
    return rest.join(there, [*keys, "_i"]).select(*[F.col(f"_x.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def constant_levels(df: DataFrame, by: str, seed: int) -> DataFrame:
    """One normal level for each value of ``by``: a prediction without any information in time."""
    return df.withColumn("level", normal(draw(F.lit(seed), F.col(by))))


def planted(truth: DataFrame, ic: Column, seed: int, y: str = "y_true") -> DataFrame:
    """``truth`` and y_pred, ic times the z-score of y within the date plus noise of weight sqrt(1 - ic^2)."""
    w = Window.partitionBy("date")
    z = (F.col(y) - F.avg(y).over(w)) / F.nullif(F.stddev_pop(y).over(w), F.lit(0.0))
    return truth.withColumn("y_pred", ic * z + F.sqrt(1 - ic * ic) * normal(draw(F.lit(seed), F.col("date"), F.col("ticker"))))


def null_band(preds: DataFrame, draws: int, every: int, least: int, seed: int, y: str = "y_true") -> DataFrame:
    """fold, n_rebalances, names (median), null_mean, null_sd, null_p95_abs: each fold's own band of the mean rank correlation
    under permutations within its rebalance dates. A permutation is a row for each draw and name, so it spreads like any other."""
    some = preds.filter(F.col(y).isNotNull()).select("fold", "date", "ticker", y)
    days = some.select("fold", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy("date")) - 1).filter(F.col("k") % every == 0).select("fold", "date")
    scored = some.join(days, ["fold", "date"])
    n = Window.partitionBy("fold", "date")
    ranked = scored.withColumns({"n": F.count("*").over(n), "r": xs.average_rank(F.col(y), "fold", "date")})
    per = ranked.groupBy("fold", "date").agg(F.count("*").alias("n")).groupBy("fold").agg(F.count("*").alias("n_rebalances"), F.percentile("n", F.lit(0.5)).alias("names"))
    many = ranked.filter(F.col("n") >= least).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    twin = permute_within(many.withColumn("p", F.col("r")), ["draw", "fold", "date"], "ticker", ["p"], F.lit(seed))
    ics = twin.groupBy("fold", "draw", "date").agg((F.covar_pop("r", "p") / F.nullif(F.stddev_pop("r") * F.stddev_pop("p"), F.lit(0.0))).alias("ic"))
    means = ics.groupBy("fold", "draw").agg(F.avg("ic").alias("m"))
    band = means.groupBy("fold").agg(F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"), F.percentile(F.abs("m"), F.lit(0.95)).alias("null_p95_abs"))
    return per.join(band, "fold")


def block_surrogate(df: DataFrame, key: str, block: int, seed: int, x: str = "x") -> DataFrame:
    """A moving-block surrogate of each key's series in time (date, ``x``): blocks drawn with replacement at overlapping starts,
    so it keeps the persistence of a real series and nothing of its timing. Adds surrogate.

    A series of n values takes n div block + 1 starts below max(n - block, 1) and is cut to n; one shorter than a block stays as
    it is. Places find their source by an equi-join, so a long series is not gathered.
    """
    n = F.count("*").over(Window.partitionBy(key))
    rows = df.withColumns({"_i": F.row_number().over(Window.partitionBy(key).orderBy("date")) - 1, "_n": n})
    j = F.floor(F.col("_i") / block)
    start = F.pmod(F.conv(F.substring(draw(F.lit(seed), F.col(key), j), 1, 12), 16, 10).cast("long"), F.greatest(F.col("_n") - block, F.lit(1)))
    there = rows.select(key, F.col("_i").alias("_from"), F.col(x).alias("surrogate"))
    return rows.withColumn("_from", start + F.pmod(F.col("_i"), F.lit(block))).join(there, [key, "_from"]).drop("_i", "_n", "_from")
