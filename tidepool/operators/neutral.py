"""Residuals within dates, the report on them and the gate that must pass before any of it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import crosssection as xs

#: fixed values of the gate: a residual rank correlation within TOLERANCE, or a t below MAX_T, is no leak
TOLERANCE, MAX_T = 0.02, 2.0


def neutralise(panel: DataFrame, basis: DataFrame, y: str = "y_true", by: str = "basis") -> DataFrame:
    """``panel`` with y replaced by its residual on the basis (date, ticker, ``by``) within each date.

    Dates on which the basis is constant or missing are refused and go, never passed through; r2 is the date's share explained.
    """
    day = Window.partitionBy("date")
    both = panel.join(basis.select("date", "ticker", F.col(by).alias("_b")), ["date", "ticker"])
    own = xs.within_date_residual(both, y, "_b", "_r")
    return own.filter("_r is not null").withColumn("r2", 1 - F.var_pop("_r").over(day) / F.nullif(F.var_pop(y).over(day), F.lit(0.0))).withColumn(y, F.col("_r")).drop("_r", "_b")


def refused_dates(panel: DataFrame, neutral: DataFrame) -> DataFrame:
    """Dates of the panel that :func:`neutralise` refused."""
    return panel.select("date").distinct().join(neutral.select("date").distinct(), "date", "left_anti")


def residual_report(panel: DataFrame, every: int = 30, quantiles: int = 5) -> DataFrame:
    """One row: n_rebalances, n_without_ordering, ic (mean rank correlation on rebalance dates) and t, null below three rebalances.

    Only statistics that no scale changes are taken, since a residual has mean 0 on every date. Rebalance dates are every
    ``every``-th with a scored row; thin dates are no rebalances, equal predictions no ordering.
    """
    some = panel.filter(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
    days = some.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("_d") % every == 0).select("date")  # one row a date
    day = Window.partitionBy("date")
    rows = some.join(days, "date").withColumns({"_n": F.count("*").over(day), "_s": F.max("y_pred").over(day) - F.min("y_pred").over(day)}).filter(F.col("_n") >= max(10, 2 * quantiles))
    flat = rows.filter("_s = 0").agg(F.count_distinct("date").alias("n_without_ordering"))  # one row
    ics = xs.rank_ic(rows.filter("_s > 0"), "y_true", "y_pred", ["date"]).agg(F.count("ic").alias("n_rebalances"), F.avg("ic").alias("_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic") / F.sqrt(F.count("ic")), F.lit(0.0))).alias("_t"))
    enough = F.col("n_rebalances") >= 3
    return ics.join(flat).select("n_rebalances", "n_without_ordering", F.when(enough, F.col("_ic")).alias("ic"), F.when(enough, F.col("_t")).alias("t"))


def calibration_gate(report: DataFrame, tolerance: float = TOLERANCE, max_t: float = MAX_T) -> DataFrame:
    """``report`` with passed and computable, for the ordering of the basis itself against its own residual.

    Such an ordering must score about 0; where it does not, the basis is not what it is taken for and nothing else may be read.
    It fails closed: a report that could not be computed does not pass, and says so.
    """
    computable = F.col("ic").isNotNull() & F.col("t").isNotNull()
    return report.withColumns({"passed": F.coalesce((F.abs("t") < max_t) | (F.abs("ic") <= tolerance), F.lit(False)) & computable, "computable": computable})
