"""Registered queries of the panel loader."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import loading
from tidepool.plans.catalog import _CENTS, DAY, LAB, W, labelled, query, shown, sql_of
from tidepool.plans.study import _OPEN, _calendar
from tidepool.sources import tables

_MACRO = f"""macro AS (SELECT * FROM (SELECT date, level, level / nullif(lag(level, 5) OVER (ORDER BY date), 0) - 1 AS level_5, level / nullif(lag(level, 20) OVER (ORDER BY date), 0) - 1 AS level_20
 FROM (SELECT CAST(o_orderdate AS DATE) AS date, {_CENTS('o_totalprice')} / 100 / count(*) AS level FROM orders GROUP BY 1)) WHERE level_5 IS NOT NULL AND level_20 IS NOT NULL)"""


def _macro(spark, d):
    return loading.changes(tables.macro(spark, d), "level", (5, 20))


@query(f"WITH {_MACRO} SELECT {DAY}, level, round(level_5, 6) AS level_5, round(level_20, 6) AS level_20 FROM macro")
def macro_changes(spark, d):
    return shown(_macro(spark, d), "date level", "level_5 level_20")


@query(sql_of(f"""SELECT ticker, CAST(p.date AS VARCHAR) AS date, close, round(roc, 6) AS roc, round(ret_5, 6) AS ret_5, round(target, 6) AS target, CAST(NULL AS DOUBLE) AS excess,
 level, round(level_5, 6) AS level_5, round(level_20, 6) AS level_20
 FROM (SELECT * FROM (SELECT ticker, date, close, roc, target, coalesce(close / lag(close, 5) OVER {W} - 1, 0) AS ret_5 FROM lab) WHERE {_OPEN}) p ASOF LEFT JOIN macro m ON p.date >= m.date""", LAB, _MACRO))
def panel_load(spark, d):
    """The loader over all signals: roc stays null where unknown, ret_5 counts 0, the table has no excess label."""
    w = Window.partitionBy("ticker").orderBy("date")
    signals = labelled(spark, d).withColumn("ret_5", F.col("close") / F.lag("close", 5).over(w) - 1)
    panel = loading.load_panel(signals, _calendar(spark), ["roc", "ret_5"], nullable=["roc"], targets=["target", "excess"], macro=_macro(spark, d))
    return shown(panel, "ticker date close level", "roc ret_5 target excess level_5 level_20")
