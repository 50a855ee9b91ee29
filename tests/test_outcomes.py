"""Ranks of big keys, benchmarks, announcements, resolved forecasts and book checks against brute force and planted cases."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.operators import announcements, benchmarks, portfolio, statistics


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 1), rng.paretovariate(0.5)]))) for _ in range(3000)]
    rows += [("ties", 1.0)] * 40 + [("one", -2.5)] + [("small", float(x)) for x in (3, 1, 2)] + [("hot", None)]
    return spark.createDataFrame(rows, "k string, x double")


def test_ranks_of_big_keys_equal_plain_average_ranks(values):
    got = {(r.k, r.x): r.rank for r in statistics.distributed_rank(values, ["k"], "x", "rank").collect()}
    pdf = values.toPandas().dropna()
    pdf["rank"] = pdf.groupby("k").x.rank(method="average")
    assert got == {(r.k, r.x): r["rank"] for _, r in pdf.iterrows()}


def test_nth_smallest_equals_a_sort(values):
    pdf = values.toPandas().dropna()
    for share in (0.01, 0.5, 0.8, 1.0):
        got = {r.k: (r.n, r.value) for r in statistics.nth_smallest(values, ["k"], "x", F.ceil(F.col("n") * F.lit(share))).collect()}
        want = {k: (len(g), sorted(g.x)[math.ceil(len(g) * share) - 1]) for k, g in pdf.groupby("k")}
        assert got == want


def test_nth_smallest_of_nothing_is_nothing(values):
    assert statistics.nth_smallest(values.filter("false"), ["k"], "x", F.lit(1)).count() == 0


def test_metric_block_of_a_perfect_forecast(spark):
    rows = [(f, float(i + f), float(2 * i)) for f in range(3) for i in range(20)]
    m = statistics.metric_block(spark.createDataFrame(rows, "fold int, y double, p double"), "y", "p", 30).first()
    assert m.n == 60 and m.ic == pytest.approx(1.0) and m.n_eff == pytest.approx(2.0)
    two = statistics.metric_block(spark.createDataFrame(rows[:40], "fold int, y double, p double"), "y", "p", 30).first()
    assert two.ic is None


def test_usable_sessions_before_and_after_the_close(spark):
    d = dt.datetime
    cal = spark.createDataFrame([(dt.date(2024, 1, x),) for x in (1, 2, 3, 8)], "date date")
    e = spark.createDataFrame([(1, d(2024, 1, 2, 10)), (2, d(2024, 1, 2, 15)), (3, d(2024, 1, 5, 9)), (4, d(2024, 1, 5, 22)), (5, d(2024, 1, 8, 15))], "id int, ts timestamp")
    got = {r.id: (r.session and r.session.day, r.timing) for r in announcements.usable_sessions(e, cal).collect()}
    assert got == {1: (2, "intraday"), 2: (3, "after_close"), 3: (8, "non_trading_day"), 4: (8, "non_trading_day"), 5: (None, "after_close")}


def test_event_window_expires_and_caps_its_age(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    s = spark.createDataFrame([(1, day, i) for i, day in enumerate(days)], "ticker long, date date, pos long")
    a = spark.createDataFrame([(1, 5, 0.7)], "ticker long, pos long, sue double")
    got = {r.pos: (r.value, r.age, r.missing) for r in announcements.event_window(s, a, "sue").collect()}
    assert got[4] == (0.0, 63, 1) and got[5] == (0.7, 0, 0) and got[34] == (0.7, 29, 0) and got[35] == (0.0, 30, 0) and got[79] == (0.0, 63, 0)


def test_share_factors_multiply_up_to_the_day(spark):
    day = lambda m: dt.date(2024, m, 1)
    actions = spark.createDataFrame([(1, day(2), 2.0), (1, day(2), 5.0), (1, day(4), 3.0), (2, day(1), 7.0)], "ticker long, ex_date date, factor double")
    rows = spark.createDataFrame([(1, day(m)) for m in (1, 2, 3, 4)] + [(3, day(1))], "ticker long, date date")
    got = {(r.ticker, r.date.month): round(r.factor, 9) for r in announcements.share_factors(rows, actions, "date").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 10.0, (1, 3): 10.0, (1, 4): 30.0, (3, 1): 1.0}


def test_a_void_in_the_window_empties_the_excess(spark):
    rows = [(1, dt.date(2024, 1, i + 1), 100.0 + i, None if i in (0, 5) else 0.01) for i in range(10)]
    lev = benchmarks.benchmark_level(spark.createDataFrame(rows, "ticker long, date date, close double, benchmark double"))
    got = {r.date.day - 1: r.benchmark_target for r in benchmarks.excess_label(lev, 2).collect()}
    assert got[0] == pytest.approx(0.02) and got[2] == pytest.approx(0.02) and got[3] is None and got[4] is None and got[5] == pytest.approx(0.02) and got[9] is None


def test_series_forecasts_read_nothing_after_their_row(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), math.exp(0.01 * i)) for i in range(150)]
    f = lambda part: benchmarks.series_comparators(spark.createDataFrame(part, "ticker long, date date, close double"), 30, 60, 50)
    whole, cut = f(rows).orderBy("date").collect(), f(rows[:100]).orderBy("date").collect()
    assert whole[:100] == cut
    assert cut[99].series_drift == pytest.approx(0.3) and cut[99].series_last_return == pytest.approx(0.3) and cut[40].series_drift == 0.0


def test_resolved_forecasts_take_the_newest_and_leave_those_done(spark):
    day = dt.date(2024, 1, 1)
    f = spark.createDataFrame([(1, day, 0.1, 1), (1, day, -0.1, 2), (2, day, 0.0, 1), (3, day, 0.2, 1), (4, day, 0.2, 1)], "ticker long, date date, pred double, issued int")
    done = spark.createDataFrame([(4, day)], "ticker long, date date")
    lab = spark.createDataFrame([(t, day, 10.0, y, day) for t, y in ((1, -0.2), (2, 0.1), (3, None), (4, 0.1))], "ticker long, date date, close double, target double, resolved_on date")
    got = {r.ticker: (r.pred, r.direction_ok, r.inside) for r in announcements.resolve_forecasts(f, done, lab, F.lit(0.05), [F.col("issued").desc()]).collect()}
    assert got == {1: (-0.1, True, False), 2: (0.0, None, False)}


def test_ties_at_the_cut_are_arbitrary(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, float(x)) for x in (9, 5, 5, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    r = portfolio.tie_decided(spark.createDataFrame(rows, "date date, p double"), "p").first()
    assert r.n == 15 and r.top_arbitrary == pytest.approx(2 / 3)
    few = portfolio.tie_decided(spark.createDataFrame(rows[:2], "date date, p double"), "p").first()
    assert few.top_arbitrary == 1.0


def test_costs_gate_and_luck(spark):
    assert portfolio.one_way_cost("buy", 0.001, 0.0002, 0.0001, 0.0) == pytest.approx(0.001318)
    assert portfolio.one_way_cost("sell", 0.001, 0.0002, 0.0001, 0.0) == pytest.approx(0.001118)
    assert portfolio.break_even_ic(0.8, 0.3474) == pytest.approx(0.8 * 0.002225 / 0.3474)
    with pytest.raises(ValueError):
        portfolio.one_way_cost("hold", 0, 0, 0, 0)
    with pytest.raises(ValueError):
        portfolio.break_even_ic(1.0, 0.0)
    assert statistics.expected_best_sharpe(1) == 0.0 and statistics.expected_best_sharpe(10) < statistics.expected_best_sharpe(100)
    cov = spark.createDataFrame([(1, 100, 0.8), (2, 300, 0.95), (0, 50, None)], "fold int, n long, coverage double")
    got = {r.fold: (r.n, r.ok) for r in statistics.coverage_gate(cov).collect()}
    assert got == {1: (100, True), 2: (300, False), -1: (400, False)}


def test_breaks_and_relative_candles(spark):
    bars = pd.DataFrame({"ticker": 1, "date": [dt.date(2024, 1, i) for i in (1, 2, 3)], "open": 2.0, "high": 4.0, "low": 1.0, "close": 2.0, "adj_close": [2.0, 2.0, 1.0], "volume": 5.0, "level": [2.0, 0.0, -1.0]})
    b = spark.createDataFrame(bars)
    assert [r.date.day for r in benchmarks.adjustment_breaks(b).collect()] == [3]
    got = benchmarks.relative_candles(b, F.col("level")).orderBy("date").collect()
    assert [r.close for r in got] == [1.0, None, None] and [r.volume for r in got] == [5.0] * 3
