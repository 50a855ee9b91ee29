"""Surprises in time, books, residuals, long-run variance and surrogates against closed forms and plain loops."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import holding, longrun, neutral, placebos, surprises

ENDS = [date(2019 + i // 4, 3 * (i % 4) + 3, (31, 30, 30, 31)[i % 4]) for i in range(16)]


def _quarters(spark, eps, late=None, basis="standalone", ticker=1, lag=40):
    rows = [(ticker, basis, e, float(x), datetime.combine(e, datetime.min.time()) + timedelta(days=lag)) for e, x in zip(ENDS, eps)]
    if late is not None:
        i, to = late
        rows[i] = (*rows[i][:4], rows[to][4] + timedelta(days=1))
    return spark.createDataFrame(rows, "ticker long, basis string, period_end date, eps double, disclosed timestamp")


def _sues(spark, quarters, actions=(), breaks=()):
    a = spark.createDataFrame(list(actions), "ticker long, ex_date date, kind string, factor double")
    b = spark.createDataFrame(list(breaks), "ticker long, day date")
    return {r["period_end"]: r for r in surprises.point_in_time_surprises(quarters, a, b).collect()}


def test_surprises_match_a_hand_computation(spark):
    eps = 10 + np.random.default_rng(1).normal(0, 1, 16).cumsum()
    out = _sues(spark, _quarters(spark, eps))
    d = eps[4:] - eps[:-4]
    assert out[ENDS[15]]["sue"] == pytest.approx(d[11] / np.std(d[3:11], ddof=1)) and out[ENDS[15]]["n_sigma"] == 8
    assert out[ENDS[7]]["sue"] is None and out[ENDS[7]]["n_sigma"] == 3 and out[ENDS[8]]["sue"] is not None


def test_a_split_changes_no_surprise_and_late_news_do_not_count(spark):
    eps = 10 + np.random.default_rng(2).normal(0, 1, 16).cumsum()
    ex = ENDS[9] + timedelta(days=45)
    halved = np.where(np.arange(16) >= 10, eps / 2, eps)
    plain, split = _sues(spark, _quarters(spark, eps)), _sues(spark, _quarters(spark, halved), [(1, ex, "bonus", 2.0), (1, ex, "demerger", 9.0)])
    naive = _sues(spark, _quarters(spark, halved))
    for e in ENDS[8:]:
        assert split[e]["sue"] == pytest.approx(plain[e]["sue"])
    assert any(abs(naive[e]["sue"] - plain[e]["sue"]) > 0.1 for e in ENDS[10:14])
    late = _sues(spark, _quarters(spark, eps, late=(11, 15)))
    assert late[ENDS[15]]["n_sigma"] < 8 and late[ENDS[15]]["sue"] != pytest.approx(plain[ENDS[15]]["sue"])
    same = _sues(spark, _quarters(spark, eps).union(_quarters(spark, eps + 5, lag=60)))  # a restatement replaces nothing
    assert same[ENDS[15]]["sue"] == pytest.approx(plain[ENDS[15]]["sue"])


def test_a_merger_voids_every_difference_across_it(spark):
    eps = 10 + np.random.default_rng(4).normal(0, 1, 16).cumsum()
    out = _sues(spark, _quarters(spark, eps), breaks=[(1, date(2021, 7, 1))])
    void = {e for e in ENDS[4:] if out[e]["diff"] is None}
    assert void == {date(2021, 9, 30), date(2021, 12, 31), date(2022, 3, 31), date(2022, 6, 30)}
    edge = _sues(spark, _quarters(spark, eps), breaks=[(1, date(2021, 6, 30))])
    assert {e for e in ENDS[4:] if edge[e]["diff"] is None} == {date(2021, 6, 30), date(2021, 9, 30), date(2021, 12, 31), date(2022, 3, 31)}


def test_announcements_prefer_consolidated_surprises(spark):
    eps = 10 + np.random.default_rng(5).normal(0, 1, 16).cumsum()
    both = _quarters(spark, eps).union(_quarters(spark, eps * 1.5 + np.arange(16) % 3, basis="consolidated", lag=50).filter("period_end > '2020-01-01'"))
    none = spark.createDataFrame([], "ticker long, ex_date date, kind string, factor double")
    s = surprises.point_in_time_surprises(both, none, spark.createDataFrame([], "ticker long, day date"))
    out = {r["period_end"]: (r["basis"], r["disclosed"].date()) for r in surprises.announced(s).collect()}
    assert out[ENDS[15]] == ("consolidated", ENDS[15] + timedelta(days=50)) and out[ENDS[9]] == ("standalone", ENDS[9] + timedelta(days=40)) and out[ENDS[5]] == (None, ENDS[5] + timedelta(days=40))


def test_event_columns_age_and_lapse(spark):
    sessions = spark.createDataFrame([(1, date(2024, 1, 1) + timedelta(days=i), i) for i in range(100)] + [(2, date(2024, 1, 1), 0)], "ticker long, date date, pos int")
    events = spark.createDataFrame([(1, 10, 2.0), (1, 50, None)], "ticker long, pos int, sue double")
    out = {r["pos"]: tuple(r)[3:] for r in surprises.event_features(sessions, events).filter("ticker = 1").collect()}
    assert out[9] == (None, None, 1.0, None) and out[10] == (2.0, 0.0, 0.0, 2.0) and out[39] == (2.0, 29.0, 0.0, 2.0) and out[40] == (0.0, 30.0, 0.0, 2.0)
    assert out[50] == (None, 0.0, 1.0, 2.0) and out[99] == (None, 49.0, 1.0, 2.0)


def test_announcement_returns_leave_out_splits_and_the_market(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(12)]
    price = {1: [100 * 1.01**i for i in range(12)], 2: [50.0] * 12}
    bars = spark.createDataFrame([(t, d, p) for t, ps in price.items() for d, p in zip(days, ps)], "ticker long, date date, close double")
    at = datetime(2024, 1, 6, 18)
    e = spark.createDataFrame([(1, date(2023, 12, 31), 1.5, at), (2, date(2023, 12, 31), -1.0, at.replace(hour=9)), (1, date(2023, 9, 30), None, at), (2, date(2023, 9, 30), 1.0, datetime(2024, 1, 1, 9)), (3, date(2023, 12, 31), 1.0, at)], "ticker long, period_end date, sue double, disclosed timestamp")
    none = spark.createDataFrame([], "ticker long, ex_date date")
    got = {(r["ticker"], r["period_end"]): (r["ann_ret"], r["sessions"]) for r in surprises.announcement_returns(e, none, bars).collect()}
    step = np.log(1.01)
    assert set(got) == {(1, date(2023, 12, 31)), (2, date(2023, 12, 31))}
    assert got[1, date(2023, 12, 31)] == (pytest.approx(2 * step - step), 2) and got[2, date(2023, 12, 31)] == (pytest.approx(-step / 2), 1)
    split = spark.createDataFrame([(1, date(2024, 1, 7)), (2, date(2024, 1, 5))], "ticker long, ex_date date")
    assert [r["ticker"] for r in surprises.announcement_returns(e, split, bars).collect()] == [2]


def test_cohorts_net_before_they_trade(spark):
    rng = np.random.default_rng(3)
    legs = [(p, int(t), leg) for p in range(0, 40, 4) for leg, ts in (("top", rng.choice(8, 3, False)), ("bottom", 8 + rng.choice(8, 2, False))) for t in ts]
    r = rng.normal(size=(50, 16))
    df = spark.createDataFrame(legs, "pos int, ticker long, leg string")
    returns = spark.createDataFrame([(p, t, float(r[p, t])) for p in range(50) for t in range(16)], "pos int, ticker long, r double")
    got = {x["pos"]: x for x in holding.cohort_book(df, returns, 8, 2, cost=0.01).collect()}
    w = np.zeros((60, 16))
    for p, t, leg in legs:
        w[p + 1:p + 9, t] += (1 / 3 if leg == "top" else -1 / 2) / 2
    for p in range(1, 50):
        turn = np.abs(w[p] - w[p - 1]).sum() / 2
        if turn or w[p].any():
            assert got[p]["gross"] == pytest.approx((w[p] * r[p]).sum(), abs=1e-12) and got[p]["turnover"] == pytest.approx(turn, abs=1e-12) and got[p]["net"] == pytest.approx((w[p] * r[p]).sum() - 0.01 * turn, abs=1e-12)
    one = spark.createDataFrame([(p, t, leg) for p in (0, 4) for t, leg in ((1, "top"), (2, "bottom"))], "pos int, ticker long, leg string")
    flat = {x["pos"]: x["turnover"] for x in holding.cohort_book(one, returns, 4, 1).collect()}
    assert flat == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0, 9: 1.0}  # what is dropped and taken up again is not traded


def _panel(strength=1.0, alpha=0.0, seed=0, names=24, dates=12):
    rng = np.random.default_rng(seed)
    b, edge = np.linspace(0.5, 1.8, names), rng.normal(size=names)
    out = []
    for d in range(dates):
        y = strength * b * (0.02 + 0.01 * rng.normal()) + alpha * edge * 0.02 + rng.normal(scale=0.01, size=names)
        out += [(date(2024, 1, 1) + timedelta(days=d), i, float(y[i]), float(b[i]), float(edge[i])) for i in range(names)]
    return out


def _frames(spark, rows, pred, basis=lambda b: b):
    p = spark.createDataFrame([(d, i, y, b if pred == "beta" else e) for d, i, y, b, e in rows], "date date, ticker long, y_true double, y_pred double")
    return p, spark.createDataFrame([(d, i, basis(b)) for d, i, _, b, _ in rows], "date date, ticker long, basis double")


def test_neutralising_takes_the_beta_ordering_and_leaves_an_edge(spark):
    p, b = _frames(spark, _panel(), "beta")
    n = neutral.neutralise(p, b)
    report = neutral.residual_report(n, every=1)
    gate = neutral.calibration_gate(report).first()
    assert gate["n_rebalances"] == 12 and abs(gate["ic"]) < 0.1 and gate["passed"] and gate["computable"]
    assert n.agg(F.avg("r2")).first()[0] > 0.3
    p, b = _frames(spark, _panel(alpha=3.0), "edge")
    assert neutral.residual_report(neutral.neutralise(p, b), every=1).first()["ic"] > 0.3


@pytest.mark.parametrize("scale, shift", [(0.02, 0.0), (-3.0, 1.5)])
def test_residuals_do_not_change_with_the_scale_of_the_basis(spark, scale, shift):
    rows = _panel()
    own = {(r["date"], r["ticker"]): r["y_true"] for r in neutral.neutralise(*_frames(spark, rows, "edge")).collect()}
    other = {(r["date"], r["ticker"]): r["y_true"] for r in neutral.neutralise(*_frames(spark, rows, "edge", lambda b: shift + scale * b)).collect()}
    assert own.keys() == other.keys() and max(abs(own[k] - other[k]) for k in own) < 1e-10


def test_a_constant_basis_is_refused_and_a_misaligned_one_fails(spark):
    rows = _panel()
    p, b = _frames(spark, rows, "beta")
    dead = b.withColumn("basis", F.when(F.col("date") == "2024-01-01", 0.0).otherwise(F.col("basis")))
    n = neutral.neutralise(p, dead)
    assert [r["date"] for r in neutral.refused_dates(p, n).collect()] == [date(2024, 1, 1)]
    nothing = neutral.calibration_gate(neutral.residual_report(neutral.neutralise(p, b.withColumn("basis", F.lit(1.0))), every=1)).first()
    assert not nothing["passed"] and not nothing["computable"]
    shuffled = dict(zip(range(24), np.random.default_rng(1).permutation(24)))
    wrong = spark.createDataFrame([(d, int(shuffled[i]), x) for d, i, _, x, _ in rows], "date date, ticker long, basis double")
    assert not neutral.calibration_gate(neutral.residual_report(neutral.neutralise(p, wrong), every=1)).first()["passed"]


def test_panel_variance_matches_its_closed_form(spark):
    rng = np.random.default_rng(7)
    rows = [(date(2020, 1, 1) + timedelta(days=d), float(v)) for d in range(90) for v in rng.normal(size=rng.integers(1, 6)) + np.sin(d / 5)]
    got = longrun.driscoll_kraay_panel(spark.createDataFrame([*rows, (date(2021, 1, 1), None), (date(2021, 1, 1), float("nan"))], "date date, x double"), "x").first()
    x = np.array([v for _, v in rows])
    days = sorted({d for d, _ in rows})
    e = np.array([sum(v - x.mean() for d, v in rows if d == day) for day in days])
    bw = int(np.floor(4 * (len(days) / 100) ** (2 / 9)))
    s = e @ e + sum(2 * (1 - k / (bw + 1)) * (e[k:] @ e[:-k]) for k in range(1, bw + 1))
    assert (got["n"], got["dates"], got["bandwidth"]) == (len(x), 90, bw) and got["mean"] == pytest.approx(x.mean())
    assert got["se"] == pytest.approx(np.sqrt(s * len(x) / (len(x) - 1)) / len(x))
    assert longrun.driscoll_kraay_panel(spark.createDataFrame(rows, "date date, x double"), "x", 0).first()["se"] == pytest.approx(np.sqrt(e @ e * len(x) / (len(x) - 1)) / len(x))


def _block_length(x):
    n, e = len(x), x - x.mean()
    kn = max(5, int(np.log10(n)))
    top = int(np.ceil(np.sqrt(n))) + kn
    acv = np.array([e[i:] @ e[:n - i] / n for i in range(top + 1)])
    loud = [abs(e[i:] @ e[:n - i]) / np.sqrt((e[i + 1:] @ e[i + 1:]) * (e[:n - i - 1] @ e[:n - i - 1])) >= 2 * np.sqrt(np.log10(n) / n) for i in range(top + 1)]
    cut = next((i - kn for i in range(kn, top + 1) if not any(loud[i - kn:i])), None)
    m = min(2 * max(cut, 1) if cut is not None else top, top)
    lam = lambda k: 1 if k / m <= 0.5 else 2 * (1 - k / m)
    g, lr = sum(2 * lam(k) * k * acv[k] for k in range(1, m + 1)), acv[0] + sum(2 * lam(k) * acv[k] for k in range(1, m + 1))
    most = np.ceil(min(3 * np.sqrt(n), n / 3))
    return cut, min((2 * g * g / (4 / 3 * lr * lr)) ** (1 / 3) * n ** (1 / 3), most), min((2 * g * g / (2 * lr * lr)) ** (1 / 3) * n ** (1 / 3), most)


@pytest.mark.parametrize("n, rho", [(300, 0.0), (300, 0.8), (64, 0.95), (400, -0.5)])
def test_block_lengths_follow_the_dependence(spark, n, rho):
    rng = np.random.default_rng(n)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + rng.normal()
    got = longrun.block_length(spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, x double"), "x").first()
    cut, circular, stationary = _block_length(x)
    assert got["cut"] == cut and got["circular"] == pytest.approx(circular) and got["stationary"] == pytest.approx(stationary)


def test_surrogates_are_blocks_of_the_series(spark):
    rows = [(k, date(2020, 1, 1) + timedelta(days=i), float(100 * k + i)) for k, n in ((1, 200), (2, 7), (3, 10), (4, 11)) for i in range(n)]
    out = placebos.block_surrogate(spark.createDataFrame(rows, "k long, date date, x double"), "k", 10, 4).orderBy("k", "date").collect()
    of = {k: [r["surrogate"] - 100 * k for r in out if r["k"] == k] for k in (1, 2, 3, 4)}
    assert [len(v) for v in of.values()] == [200, 7, 10, 11] and of[2] == list(range(7)) and of[3] == list(range(10))
    starts = [of[1][i] for i in range(0, 200, 10)]
    assert all(of[1][i:i + 10] == [starts[i // 10] + j for j in range(10)] for i in range(0, 200, 10))
    assert len({s % 10 for s in starts}) > 3 and max(starts) <= 190  # starts overlap


def test_announcement_returns_compute_their_inputs_once(spark):
    import datetime as dt

    seen = {n: spark.sparkContext.accumulator(0) for n in ("bars", "events")}

    def counted(df, name, c):
        acc = seen[name]
        return df.withColumn(c, F.udf(lambda v: acc.add(1) or v, "double").asNondeterministic()(c))

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    bars = counted(spark.createDataFrame([(t, day(i), 10.0 + i + t) for t in (1, 2) for i in range(10)], "ticker long, date date, close double"), "bars", "close")
    events = counted(spark.createDataFrame([(1, day(0), 1.5, dt.datetime(2024, 1, 4, 10)), (2, day(0), 0.5, dt.datetime(2024, 1, 5, 18)), (1, day(1), 1.0, dt.datetime(2023, 1, 5, 18))],
                                           "ticker long, period_end date, sue double, disclosed timestamp"), "events", "sue")
    out = surprises.announcement_returns(events, spark.createDataFrame([], "ticker long, ex_date date"), bars).collect()
    assert sorted((x["ticker"], x["sessions"]) for x in out) == [(1, 1), (2, 2)]
    assert (seen["bars"].value, seen["events"].value) == (20, 3)
