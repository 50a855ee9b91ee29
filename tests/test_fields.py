"""Delivery files, horizons and running betas: refusals and plain loops."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import events
from tidepool.operators import comparators, folds, windows

GOOD = "title\r\n10,MTO,05012024,x\r\n20,1,ACME ,EQ,1000,600,60.0\r\n20,2,BETA,BE,n/a,5,1\r\nend"


@pytest.mark.parametrize("file, status", [(GOOD, "ok"), (GOOD.replace("05012024", "06012024"), "wrong_date"), (GOOD.replace("05012024", "x"), "wrong_date"), (GOOD.replace("10,MTO", "11,MTO"), "no_header"),
                                          (GOOD.replace("BETA,BE", "BETA,EXTRA,BE"), "bad_record"), ("10,MTO,05012024,x", "no_records"), ("", "no_header")])
def test_delivery_files_are_read_whole_or_refused(spark, file, status):
    r = spark.createDataFrame([(file, date(2024, 1, 5))], "file string, day date").select(events.delivery_file(F.col("file"), F.col("day")).alias("f")).first()["f"]
    assert r["status"] == status and (r["rows"] is None) == (status != "ok")
    if status == "ok":
        assert [tuple(x) for x in r["rows"]] == [("ACME", "EQ", 1000.0, 600.0, 60.0), ("BETA", "BE", None, 5.0, 1.0)]


def test_a_horizon_without_a_gap_is_an_error(spark):
    df = spark.createDataFrame([(5,), (90,)], "h int")
    assert [r[0] for r in df.select(comparators.purge_for(F.col("h"))).collect()] == [63, 90]
    with pytest.raises(ValueError):
        comparators.purge_for(F.col("h"), 0)
    with pytest.raises(Exception, match="must be positive"):
        df.union(spark.createDataFrame([(0,)], "h int")).select(comparators.purge_for(F.col("h"))).collect()


def test_running_betas_equal_frames(spark):
    rng = np.random.default_rng(0)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(90)]
    rows = [(t, d, None if rng.random() < 0.05 else float(100 * np.exp(rng.normal(0, 0.05)))) for t in range(4) for d in days] + [(9, d, 50.0) for d in days]
    out = windows.rolling_beta(spark.createDataFrame(rows, "ticker long, date date, close double"), 20, 8).toPandas().sort_values(["ticker", "date"])
    for _, g in out.groupby("ticker"):
        r, m, b = (g[c].to_numpy(float) for c in ("r", "m", "beta"))
        for i in range(len(g)):
            own = slice(max(0, i - 19), i + 1)
            ok = ~np.isnan(r[own])
            if ok.sum() < 8:
                assert np.isnan(b[i])
            else:
                c = np.cov(r[own][ok], m[own][ok])
                assert b[i] == pytest.approx(c[0, 1] / c[1, 1], rel=1e-8, abs=1e-10)


def test_floors_from_sums_equal_floors_from_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(date(2020, 1, 1) + timedelta(days=i), t, None if rng.random() < 0.1 else float(rng.normal(0.01 * t, 1))) for i in range(200) for t in range(6) if t < 5 or i > 150]
    lab = spark.createDataFrame(rows, "date date, ticker long, target double")
    got = {(r["fold"], r["date"], r["ticker"]): (r["market"], r["beta_market"]) for r in folds.floor_predictions(lab, 3, 80, 5, 5).collect()}
    grid = folds.date_grid(lab)
    table = folds.fold_table(grid, 3, 80, 5, 5)
    some = lab.filter("target is not null")
    train = folds.train_rows(some, grid, table)
    mu = {r["fold"]: r["mu"] for r in folds.market_mean(train).collect()}
    beta = {(r["fold"], r["ticker"]): r["beta"] for r in folds.betas(train).collect()}
    want = {(r["fold"], r["date"], r["ticker"]): (mu[r["fold"]], beta.get((r["fold"], r["ticker"]), 1.0) * mu[r["fold"]]) for r in folds.test_rows(some, grid, table).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
