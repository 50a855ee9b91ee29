"""One model for all names: boosted trees on features standardised within dates, fitted per purged fold and once for use."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import crosssection as xs
from tidepool.operators import folds
from tidepool.operators.pooling import written
from tidepool.sources.tables import deal


def prepare(panel: DataFrame, features: list[str], target: str = "target", least: int = 10) -> DataFrame:
    """The panel as the model sees it: features standardised within the date, the label too, its moments beside it (y_raw, mean, sd).

    All of it uses a date's own rows, so it may be done before any split. Labels of dates without spread are null.
    """
    out = reduce(lambda df, c: xs.zscore(df, c, c), features, panel)
    out = out.join(F.broadcast(xs.moments(panel, target, least).select("date", "mean", "sd")), "date", "left").withColumn("y_raw", F.col(target))  # moments: one row a date
    return out.withColumn(target, (F.col("y_raw") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))


def _model(rows: DataFrame, features: list[str], target: str, params: dict) -> PipelineModel:
    shape = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")
    tree = GBTRegressor(featuresCol="_v", labelCol=target, predictionCol="y_pred", seed=7, **params)
    return PipelineModel([shape, tree.fit(shape.transform(rows))])


def walk_forward(prepared: DataFrame, features: list[str], target: str = "target", *, n_folds: int = 5, min_train: int = 500, horizon: int = 30, params: dict | None = None, least_rows: int = 100, tasks: int | None = None) -> DataFrame:
    """fold, date, ticker, y_true, y_raw, y_pred out of sample: trees fitted on each fold's training rows alone.

    Purge and embargo are both the horizon. Folds come from a table of a handful of rows; each fit is a Spark job over its
    training rows, and only models reach the driver. The panel is written once and read again by every fit. ``tasks``: to how
    many tasks a fit's rows are dealt (splits of files by default); a fit holds its rows, so their number should grow with the panel. A panel that yields no fold is an error.
    """
    prepared = deal(written(prepared), tasks, "date").sortWithinPartitions("date", "ticker")
    grid = folds.date_grid(prepared)
    table = folds.fold_table(grid, n_folds, min_train, horizon, horizon).collect()  # one row a fold
    some = prepared.filter(F.col(target).isNotNull()).join(F.broadcast(grid), "date")
    out = []
    for f in table:
        train = some.filter(F.col("pos") < f["train_end"])
        test = some.filter((F.col("pos") >= f["test_start"]) & (F.col("pos") < f["test_end"]))
        if train.count() < least_rows:
            continue
        done = _model(train, features, target, params or {}).transform(test)
        out.append(done.select(F.lit(f["fold"]).alias("fold"), "date", "ticker", F.col(target).alias("y_true"), "y_raw", "y_pred"))
    if not out:
        raise ValueError("no fold: the panel is too short or has no labels")
    return reduce(DataFrame.union, out)


def fit_final(prepared: DataFrame, features: list[str], target: str = "target", *, params: dict | None = None, least_rows: int = 1000) -> PipelineModel:
    """The model for use, on every row whose label is known; it is never scored on them. Fewer than ``least_rows`` are refused."""
    rows = prepared.filter(F.col(target).isNotNull())
    n = rows.count()
    if n < least_rows:
        raise ValueError(f"{n} labelled rows are too few to fit")
    return _model(rows, features, target, params or {})


def predict_on(model: PipelineModel, prepared: DataFrame, day) -> DataFrame:
    """date, ticker, y_pred of one date from that date's rows alone; a date without rows is an error."""
    rows = prepared.filter(F.col("date") == F.lit(day).cast("date"))
    if rows.isEmpty():
        raise ValueError(f"no rows on {day}")
    return model.transform(rows).select("date", "ticker", "y_pred")
