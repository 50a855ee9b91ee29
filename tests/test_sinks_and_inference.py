"""Guarded writes, event parsers, resampling."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import events
from tidepool.operators import inference, sinks


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_window_replace_and_label_guard(spark):
    schema = "ticker string, date date, y double"
    old = spark.createDataFrame([("a", day(i), 1.0) for i in range(5)] + [("b", day(0), 1.0)], schema)
    good = spark.createDataFrame([("a", day(i), 2.0) for i in range(3, 7)], schema)
    out = {(x["ticker"], x["date"]): x["y"] for x in sinks.guarded_replace(old, good, ["y"]).collect()}
    assert len(out) == 8 and out["a", day(2)] == 1.0 and out["a", day(3)] == 2.0 and out["b", day(0)] == 1.0
    bad = spark.createDataFrame([("a", day(3), None)], schema)
    with pytest.raises(sinks.RefusedWrite):
        sinks.guarded_replace(old, bad, ["y"])


def test_interval_sync(spark):
    forever = dt.date(9999, 12, 31)
    now = spark.createDataFrame([("a", day(0), forever), ("b", day(0), forever), ("c", day(0), day(3))], "ticker string, effective_from date, effective_to date")
    out = {tuple(x) for x in sinks.sync_intervals(now, spark.createDataFrame([("a",), ("c",)], "ticker string"), F.lit("2024-02-01").cast("date")).collect()}
    feb = dt.date(2024, 2, 1)
    assert out == {("a", day(0), forever), ("b", day(0), feb), ("c", day(0), day(3)), ("c", feb, forever)}


def test_upserts_and_revisions(spark):
    old = spark.createDataFrame([(1, 1, 5.0), (2, 1, None)], "k int, at int, v double")
    new = spark.createDataFrame([(1, 2, 5.0 + 1e-12), (2, 2, 3.0), (3, 2, 1.0)], "k int, at int, v double")
    assert {x["k"]: x["at"] for x in sinks.upsert(old, new, ["k"], "at").collect()} == {1: 2, 2: 2, 3: 2}
    assert [x["k"] for x in sinks.insert_ignore(old, new.union(new), ["k"]).collect()] == [3]
    assert [(x["k"], x["field"], x["old_value"], x["new_value"]) for x in sinks.revisions(old, new, ["k"], ["v"]).collect()] == [(2, "v", None, 3.0)]


def test_event_parsers(spark):
    df = spark.createDataFrame([("Bonus 1:1 / Split Rs 10 to Rs 2", "20,1,ABC,EQ,100,40,40.0", "Acme, Inc,OLD,NEW,05-Jan-2024"), ("Dividend", "20,1,ABC,EQ,100,40", "bad")], "s string, d string, c string")
    a, b = df.select(events.action_factor(F.col("s")).alias("f"), events.delivery_rows(F.col("d")).alias("d"), events.symbol_change(F.col("c")).alias("c")).collect()
    assert a["f"] == 10.0 and a["d"]["delivered"] == 40.0 and tuple(a["c"]) == ("Acme, Inc", "OLD", "NEW", dt.date(2024, 1, 5))
    assert b["f"] is None and b["d"] is None and b["c"]["company"] is None
    said = {"Bonus 3:5": 1.6, " Bonus 1:2": 1.5, "Face Value Split From Rs.10/- To Rs.2/-": 5.0, "Face Value Split (Sub-Division) - From Rs 2/- Per Share To Re 1/- Per Share": 2.0, "Sub-Division Rs 10 To Rs 5": 2.0,
            "Bonus 1:1/Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share": 10.0, "Rights 1:15 @ Premium Rs 1247": None, "Dividend - Rs 10 Per Share": None, "Bonus 1:0": None}
    got = spark.createDataFrame([(t,) for t in said], "s string").select("s", events.action_factor(F.col("s")).alias("f"), events.action_kind(F.col("s")).alias("k")).collect()
    assert {x["s"]: x["f"] for x in got} == said and {x["k"] for x in got if "Bonus 1:1/" in x["s"]} == {"bonus"}


def test_seasonal_surprise(spark):
    ends = [dt.date(y, m, d) for y in range(2015, 2021) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    eps = [float((i * 7) % 11) for i in range(len(ends))]
    out = {x["period_end"]: x["sue"] for x in events.seasonal_surprise(spark.createDataFrame([("s", e, v) for e, v in zip(ends, eps)], "symbol string, period_end date, eps double")).collect()}
    change = [None] * 4 + [b - a for a, b in zip(eps, eps[4:])]
    for i, e in enumerate(ends):
        past = [c for c in change[max(0, i - 8):i] if c is not None]
        want = change[i] / np.std(past, ddof=1) if change[i] is not None and len(past) >= 4 else None
        assert out[e] == want or abs(out[e] - want) < 1e-9


def test_block_bootstrap_keeps_the_mean_and_sees_spread(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=200)
    df = spark.createDataFrame([(f, t, i, float(v)) for i, v in enumerate(x) for f, t, v in ((0, "a", v), (0, "twin", v), (1, "a", -v), (1, "c", 2.0)) if (f, t) != (1, "c") or i % 3], "fold int, ticker string, date int, x double")
    out = inference.block_bootstrap_means(df, "x", 400, 5).toPandas()
    a = out[(out.fold == 0) & (out.ticker == "a")].sort_values("replicate")["mean"].to_numpy()
    assert len(a) == 400 and abs(a.mean() - x.mean()) < 0.02 and 0.6 < a.std() / (x.std() / np.sqrt(200)) < 1.4
    assert np.allclose(a, out[out.ticker == "twin"].sort_values("replicate")["mean"])  # all tickers draw the same dates
    assert np.allclose(out[out.ticker == "c"]["mean"], 2.0)
    other = out[(out.fold == 1) & (out.ticker == "a")].sort_values("replicate")["mean"].to_numpy()
    assert abs(np.corrcoef(a, other)[0, 1]) < 0.2  # folds draw on their own


def test_romano_wolf_finds_the_planted_one(spark):
    r = np.random.default_rng(2)
    stats = spark.createDataFrame([("hit", 6.0)] + [(f"n{i}", float(v)) for i, v in enumerate(r.normal(size=9))], "k string, t double")
    names = [x["k"] for x in stats.collect()]
    draws = r.normal(size=(200, 10))
    boot = spark.createDataFrame([(k, b, float(draws[b, j])) for b in range(200) for j, k in enumerate(names)], "k string, replicate int, bt double")
    out = inference.romano_wolf(stats, boot, "k").toPandas().sort_values("t", ascending=False)
    assert out.p_adjusted.iloc[0] < 0.01 and out.p_adjusted.iloc[1] > 0.05 and out.p_adjusted.is_monotonic_increasing
