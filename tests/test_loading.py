"""The panel loader: its SQL, dirty values, pruning, days without a session."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from tests.test_panel import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.operators import loading, sessions
from tidepool.plans import catalog
from tidepool.plans import loading as plans  # noqa: F401


@pytest.mark.parametrize("name", ["macro_changes", "panel_load"])
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())


def test_loader_cleans_numbers_prunes_and_drops_closed_days(spark, tmp_path):
    day = dt.date(2024, 1, 25)
    raw = spark.createDataFrame([('{"closed_weekdays": {"2024-01-26": "closed"}, "weekend_sessions": {}, "years": [2024]}',)], "raw string")
    rows = [(day, "a", 1.0, "2.5", float("inf"), float("nan"), "x"), (day, "b", 1.0, "junk", None, 0.5, "x"), (dt.date(2024, 1, 26), "a", 1.0, "1", 1.0, 1.0, "x"),
            (dt.date(2024, 1, 24), "a", 1.0, "1", 1.0, 1.0, "x")]
    path = str(tmp_path / "signals")
    spark.createDataFrame(rows, "date date, ticker string, close double, f string, g double, target double, unused string").write.parquet(path)
    signals, cal = spark.read.parquet(path), sessions.decode(raw)
    macro = spark.createDataFrame([(dt.date(2024, 1, 20), 7.0), (dt.date(2024, 1, 26), 9.0)], "date date, level double")
    got = loading.load_panel(signals, cal, ["f", "g"], nullable=["g"], targets=["target", "excess"], optional=["benchmark"], macro=macro, start="2024-01-25")
    out = {r["ticker"]: r for r in got.collect()}
    assert set(out) == {"a", "b"} and got.columns == ["date", "ticker", "close", "f", "g", "target", "excess", "benchmark", "level"]
    assert (out["a"]["f"], out["a"]["g"], out["a"]["target"], out["a"]["level"]) == (2.5, None, None, 7.0)
    assert (out["b"]["f"], out["b"]["g"], out["b"]["target"], out["b"]["excess"]) == (0.0, None, 0.5, None)
    one = loading.load_panel(signals, cal, ["f"], tickers=["b"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r["ticker"] for r in one.collect()] == ["b"] and "unused" not in plan and "EqualTo(ticker,b)" in plan
    assert loading.load_panel(signals.limit(0), cal, ["f"], macro=macro).count() == 0
    with pytest.raises(AnalysisException):
        loading.load_panel(signals, cal, ["absent"])


def test_changes_need_all_steps(spark):
    rows = [(dt.date(2024, 1, 1 + i), float(v)) for i, v in enumerate([1, 2, 0, 4, 5])]
    got = loading.changes(spark.createDataFrame(rows, "date date, v double"), "v", (1, 2)).collect()
    assert [(r["v"], r["v_1"], r["v_2"]) for r in got] == [(0.0, -1.0, -1.0)]  # no change from 0, none before the second row
