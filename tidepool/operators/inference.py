"""Resampling and multiplicity control over many instruments: replicates are rows, so they spread like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_bootstrap_means(df: DataFrame, x: str, replicates: int = 200, block: int = 30, seed: int = 7, tasks: int | None = None) -> DataFrame:
    """fold, ticker, replicate, mean: circular moving-block resamples of the dates of each fold, the same for all tickers.

    df: fold, ticker, date and x. A replicate draws ceil(dates / block) starts (md5 of seed, fold, replicate and place, so every
    rerun and engine draws alike); what all tickers share on a date stays together, as joint tests need. How often a date is
    drawn is one small table, a row a date, which is broadcast; a row counts as often as its date. Dates that a ticker lacks
    do not count and are not made up. ``tasks``: to how many tasks the rows are dealt (the session's number by default); a
    ticker's replicates stay in its task.
    """
    by = Window.partitionBy("fold")
    grid = df.select("fold", "date").distinct().withColumns({"pos": F.row_number().over(by.orderBy("date")) - 1, "days": F.count("*").over(by)})  # one row a date
    size = grid.select("fold", "days").distinct()
    draws = size.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("days") / block).cast("int") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("fold", "replicate", "_j")]))
    start = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("days")).cast("int")
    last = F.least(start + block, F.col("days") + F.least(F.col("days"), F.lit(block))) - 1
    drawn = draws.select("fold", "replicate", "days", F.explode(F.sequence(start, last)).alias("_p")).groupBy("fold", F.pmod("_p", "days").cast("int").alias("pos"), "replicate").agg(F.count("*").alias("w"))
    times = drawn.groupBy("fold", "pos").agg(F.collect_list(F.struct("replicate", "w")).alias("_w")).join(grid, ["fold", "pos"]).select("fold", "date", "_w")  # one row a date
    rows = df.filter(F.col(x).isNotNull()).select("fold", "ticker", "date", F.col(x).alias("_x"))
    rows = rows.repartition(tasks, "ticker") if tasks else rows.repartition("ticker")
    many = rows.join(F.broadcast(times), ["fold", "date"]).select("fold", "ticker", "_x", F.explode("_w").alias("_d"))
    out = many.groupBy("fold", "ticker", F.col("_d.replicate").alias("replicate")).agg(F.sum(F.col("_x") * F.col("_d.w")).alias("_s"), F.sum("_d.w").alias("_n"))
    return out.select("fold", "ticker", "replicate", (F.col("_s") / F.col("_n")).alias("mean"))


def romano_wolf(stats: DataFrame, boot: DataFrame, key: str, t: str = "t", bt: str = "bt") -> DataFrame:
    """key, t, p_adjusted: step-down max-T. stats has one row a hypothesis, boot (key, replicate, bt) the centred statistics.

    Per replicate the maximum over the hypotheses not yet stepped past is a running maximum from the weakest up.
    """
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy(F.col(t).desc(), F.col(key))))  # one row a hypothesis
    down = Window.partitionBy("replicate").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    top = boot.join(ranked, key).withColumn("top", F.max(bt).over(down))
    p = top.groupBy(key, t, "rank").agg(((F.sum((F.col("top") >= F.col(t)).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))
    return p.select(key, t, F.max("p").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("p_adjusted"))


def grade(theta, p_positive, significant, break_even: float = 0.0051, threshold: float = 0.9):
    """STRONG: significant, above the break-even and likely positive; ANTI_SIGNAL: significant and negative; WEAK: likely positive; else INSUFFICIENT."""
    return (F.when(significant & (theta < 0), "ANTI_SIGNAL").when(significant & (theta > break_even) & (p_positive >= threshold), "STRONG")
            .when((theta > break_even) & (p_positive >= 0.5), "WEAK").otherwise("INSUFFICIENT"))
