"""Identities, cells, null spreads and intervals of a median against plain loops."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import cells, identity, signals, windows


def test_lists_need_every_column(spark):
    df = spark.createDataFrame([(" ABC ", " Abc Limited ", "Metals "), ("", "none", "x"), (None, "none", "x")], "`Symbol` string, `Company Name` string, `Industry` string")
    assert [tuple(r) for r in identity.constituents(df).collect()] == [("ABC.NS", "Abc Limited", "Metals")]
    with pytest.raises(ValueError, match="industry"):
        identity.constituents(df.withColumnRenamed("Industry", "Sector"))


def test_names_states_and_verdicts(spark):
    rows = [("A.NS", "a", None, "STRONG", "EW-LOO:MARKET"), ("A.NS", " A Limited", float("nan"), "x", "EW-LOO:Oil & Gas"), ("A.NS", None, 0.0, None, "^I"), ("A.NS", "  ", 2.0, "WEAK", "^J"), ("A.NS", "AB", 1.0, "INSUFFICIENT", None)]
    df = spark.createDataFrame(rows, "t string, c string, s double, g string, b string")
    got = [tuple(r) for r in df.select(identity.unresolved(F.col("t"), F.col("c")), identity.tri_state(F.col("s")), identity.verdict(F.col("g")), identity.benchmark_name(F.col("b"), {"^I": "Index"})).collect()]
    assert got == [(True, None, "APPROVED", "the rest of the universe (equal-weighted)"), (False, None, None, "Oil & Gas peers (equal-weighted)"), (True, False, None, "Index"), (True, True, "FLAGGED", "^J"), (False, True, "REJECTED", None)]


def test_tables_are_cut_to_a_universe_that_is_not_empty(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "ticker long"), spark.createDataFrame([(5,)], "x long")
    u = spark.createDataFrame([(1,), (1,)], "ticker long")
    kept, counts = identity.clean_tables({"a": a, "b": b}, u)
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 1), ("b", 1, 0)} and kept["a"].count() == 2 and kept["b"].count() == 1
    with pytest.raises(ValueError):
        identity.clean_tables({"a": a}, u.limit(0))


def test_cells_without_ordering_count_and_score_nothing(spark):
    rng = np.random.default_rng(0)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(120)]
    rows = []
    for i, d in enumerate(days):
        for t in range(12):
            y = float(rng.normal())
            rows.append((i // 60, d, t, y, 1.0 if t < 3 else y + float(rng.normal())))
    m = cells.cell_metrics(spark.createDataFrame(rows, "fold int, date date, ticker long, y_true double, y_pred double"), 10).first()
    assert (m["cells"], m["constant_cells"], m["degeneracy_rate"], m["tickers"], m["n"], m["n_rebalances"]) == (24, 6, 0.25, 12, 1440, 12)
    assert m["cs_rank_ic"] > 0.3 and m["ts_rank_ic"] > 0.5 and m["reb_t"] > 3 and m["unique_fraction"] == pytest.approx((6 / 60 + 18) / 24)


def test_predictions_that_know_nothing_spread_around_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(date(2020, 1, 1) + timedelta(days=i), t, float(rng.normal())) for i in range(60) for t in range(20)]
    out = cells.null_spread(spark.createDataFrame(rows, "date date, ticker long, y_true double"), 30, 10, 3).first()
    assert (out["dates"], out["rows"]) == (60, 1200) and abs(out["mean"]) < 0.02 and 0.01 < out["se"] < 0.06  # about 1 / sqrt(60 x 19)


def test_median_r2_of_block_resamples_equals_a_loop(spark):
    import hashlib

    rng = np.random.default_rng(2)
    n, k = 90, 5
    y = rng.normal(size=n)
    x = 0.5 * y[:, None] + rng.normal(size=(n, k))
    x[10:20, 1] = np.nan
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(n)]
    rows = [(s, days[i], None if np.isnan(x[i, s]) else float(x[i, s]), float(y[i])) for i in range(n) for s in range(k)]
    got = {r["draw"]: r["median_r2"] for r in cells.median_r2(spark.createDataFrame(rows, "series long, date date, x double, y double"), 4, 12, 7).collect()}

    def median(at):
        out = []
        for s in range(k):
            ok = ~np.isnan(x[at, s])
            out.append(np.corrcoef(x[at, s][ok], y[at][ok])[0, 1] ** 2)
        return np.median(out)

    assert got[0] == pytest.approx(median(np.arange(n)))
    for draw in range(1, 5):
        starts = [int(hashlib.md5(f"7|{draw}|{j}".encode()).hexdigest()[:12], 16) % (n - 12) for j in range(n // 12)]
        assert got[draw] == pytest.approx(median(np.concatenate([np.arange(s, s + 12) for s in starts])))
    short = spark.createDataFrame([r for r in rows if r[1] < days[10]], "series long, date date, x double, y double")
    assert [r["draw"] for r in cells.median_r2(short, 4, 12, 7).collect()] == [0]


def test_the_frame_holds_every_signal_of_every_row(spark):
    rng = np.random.default_rng(3)
    rows = [(t, date(2020, 1, 1) + timedelta(days=i), *[float(v) for v in 100 + rng.normal(size=4)], float(rng.integers(1, 9))) for t in range(2) for i in range(80)]
    b = spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, volume double")
    out = signals.signals(b)
    assert out.count() == 160 and set(signals.SIGNALS) < set(out.columns)
    own = {(r["ticker"], r["date"]): r["sma"] for r in windows.bollinger(b).collect()}
    assert all(r["sma"] == own[r["ticker"], r["date"]] for r in out.collect())
