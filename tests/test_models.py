"""Probes, tuning, pooled trees, run logs and snapshots against dense algebra, plain loops and planted signals."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import folds, pooled, probe, runlog, snapshots, tuning

SCHEMA = "pos int, x array<double>, y double"


def _data(n_dates=80, per=6, k=5, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n_dates * per, k)) * np.arange(1, k + 1) + 3
    z[:, 4] = 7.0  # no spread
    y = z[:, 0] * 0.5 - z[:, 1] * 0.1 + rng.normal(size=len(z))
    return np.repeat(np.arange(n_dates), per), z, y


def _dense(pos, z, y, train, test, alpha):
    mean, sd = z[train].mean(axis=0), z[train].std(axis=0)
    sd[sd < 1e-8] = 1
    s = (z[train] - mean) / sd
    w = np.linalg.solve(s.T @ s + alpha * np.eye(z.shape[1]), s.T @ (y[train] - y[train].mean()))
    return (z[test] - mean) / sd @ w + y[train].mean()


def test_probes_equal_dense_ridges_chosen_on_purged_folds(spark):
    pos, z, y = _data()
    rows = [(int(p), v.tolist(), float(t)) for p, v, t in zip(pos, z, y)] + [(3, None, 1.0), (4, [1.0] * 5, None), (5, [float("nan")] * 5, 1.0), (6, [1.0] * 4, 1.0), (7, [1.0] * 5, float("inf"))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    alphas = (0.1, 10.0, 1e3, 1e5)
    fits = probe.fit_probe(df, 80, 5, n_folds=3, min_train=40, horizon=4, inner_folds=2, inner_min_train=10, alphas=alphas)
    assert [(f.test_start, f.test_end) for f in fits] == [(40, 53), (53, 66), (66, 79)]
    got = probe.predict_probe(df, fits)
    for f in fits:
        end = f.test_start - 8
        scores = []
        for a, b, c in probe.purged_folds(end, 2, 10, 4, 4):
            scores.append([np.mean((_dense(pos, z, y, pos < a, (pos >= b) & (pos < c), al) - y[(pos >= b) & (pos < c)]) ** 2) for al in alphas])
        assert f.alpha == (alphas[int(np.argmin(np.mean(scores, axis=0)))] if scores else 1e5) and f.rows == (pos < end).sum()
        test = (pos >= f.test_start) & (pos < f.test_end)
        mine = sorted(r["y_pred"] for r in got.filter(F.col("fold") == f.fold).filter("y is not null").collect())
        assert mine == pytest.approx(sorted(_dense(pos, z, y, pos < end, test, f.alpha)), abs=1e-9)
    few = probe.fit_probe(df.filter("pos < 2"), 80, 5, n_folds=3, min_train=40, horizon=4)
    assert all(f.alpha is None for f in few) and {r["y_pred"] for r in probe.predict_probe(df, few).collect()} == {0.0}
    with pytest.raises(ValueError):
        probe.moments(df, [0, 1], 5000)


def test_squared_errors_follow_from_moments(spark):
    pos, z, y = _data(seed=2)
    df = spark.createDataFrame([(int(p), v.tolist(), float(t)) for p, v, t in zip(pos, z, y)], SCHEMA)
    a, b = probe.moments(df, [0, 50, 80], 5)
    w, mean, sd, y0 = probe.ridge_path(a, (5.0,))
    assert probe.squared_error(b, w[0], mean, sd, y0) == pytest.approx(np.mean((_dense(pos, z, y, pos < 50, pos >= 50, 5.0) - y[pos >= 50]) ** 2))
    x, s, seen = tuning.density_search(lambda t: probe.squared_error(b, *[q if i else q[0] for i, q in enumerate(probe.ridge_path(a, (10.0**t,)))]), -2, 6, trials=40)
    grid = min(probe.squared_error(b, *[q if i else q[0] for i, q in enumerate(probe.ridge_path(a, (10.0**t,)))]) for t in np.linspace(-2, 6, 400))
    assert len(seen) == 40 and s <= grid * 1.002


def test_the_search_is_seeded_bounded_and_survives_bad_scores():
    f = lambda x: math.nan if x < 0 else (x - 3.3) ** 2
    one, two = tuning.density_search(f, -5, 5, trials=60), tuning.density_search(f, -5, 5, trials=60)
    assert one == two and abs(one[0] - 3.3) < 0.3 and all(-5 <= x <= 5 for x, _ in one[2])
    assert sum(abs(x - 3.3) < 1.5 for x, _ in one[2][30:]) > sum(abs(x - 3.3) < 1.5 for x, _ in tuning.density_search(lambda x: 0.0, -5, 5, trials=60)[2][30:])


def test_purged_cv_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=n)
    y = 0.4 * x + rng.normal(size=n)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(n)]
    rows = [(1, d, float(a), float(b)) for d, a, b in zip(days, x, y)] + [(2, d, 1.0, float(b)) for d, b in zip(days, y)] + [(3, d, 1.0, 1.0) for d in days[:100]]
    got = {(r["k"], r["alpha"]): r for r in tuning.purged_cv(spark.createDataFrame(rows, "k long, date date, x double, y double"), "k", "x", "y", [1.0, 1e4]).collect()}
    assert {k for k, _ in got} == {1, 2} and got[2, 1.0]["rank_ic"] == tuning.NO_ORDERING
    first, step = max(120, n // 3), (n - max(120, n // 3)) // 3
    for alpha in (1.0, 1e4):
        maes, ics = [], []
        for f in range(3):
            s = first + f * step
            if s - 60 < first // 2:
                continue
            tr, te = slice(0, s - 60), slice(s, min(s + step, n))
            xc = x[tr] - x[tr].mean()
            p = y[tr].mean() + (xc @ (y[tr] - y[tr].mean())) / (xc @ xc + alpha) * (x[te] - x[tr].mean())
            maes.append(np.abs(p - y[te]).mean())
            ranks = lambda v: v.argsort().argsort()
            ics.append(-np.corrcoef(ranks(p), ranks(y[te]))[0, 1])
        assert got[1, alpha]["mae"] == pytest.approx(np.mean(maes)) and got[1, alpha]["rank_ic"] == pytest.approx(np.mean(ics))
    top = tuning.best(spark.createDataFrame([(1, 2.0, 0.5), (1, 1.0, 0.5), (1, 3.0, 0.6)], "k long, alpha double, mae double"), "k", "mae").collect()
    assert [(r["k"], r["alpha"]) for r in top] == [(1, 1.0)]


def test_trees_find_a_planted_signal_and_see_no_future(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(120):
        a, b = rng.normal(size=(2, 15))
        y = np.where(a > 0, 1.0, -1.0) * (1 + 0.2 * rng.normal(size=15))
        rows += [(date(2020, 1, 1) + timedelta(days=d), i, float(a[i]), float(b[i]), float(y[i])) for i in range(15)]
    panel = spark.createDataFrame(rows, "date date, ticker long, a double, b double, target double")
    prepared = pooled.prepare(panel, ["a", "b"]).cache()
    assert prepared.filter("abs(y_raw - (target * sd + mean)) > 1e-9").count() == 0
    args = {"n_folds": 2, "min_train": 60, "horizon": 5, "params": {"maxIter": 4, "maxDepth": 3}}
    out = pooled.walk_forward(prepared, ["a", "b"], **args)
    assert out.stat.corr("y_pred", "y_true") > 0.8 and out.groupBy("fold").count().count() == 2
    grid = folds.date_grid(prepared).collect()
    first = min(r["date"] for r in out.filter("fold = 0").collect())
    gap = [r["date"] for r in grid if r["date"] < first][-10:]
    spoiled = prepared.withColumn("target", F.when(F.col("date") >= gap[0], -F.col("target")).otherwise(F.col("target")))
    key = lambda df: {(r["date"], r["ticker"]): r["y_pred"] for r in df.filter("fold = 0").collect()}
    assert key(pooled.walk_forward(spoiled, ["a", "b"], **args)) == key(out)  # labels in the gap and after it change nothing
    model = pooled.fit_final(prepared, ["a", "b"], params=args["params"])
    assert pooled.predict_on(model, prepared, "2020-03-01").count() == 15
    with pytest.raises(ValueError):
        pooled.predict_on(model, prepared, "2019-01-01")
    with pytest.raises(ValueError):
        pooled.fit_final(prepared.limit(10), ["a", "b"])
    with pytest.raises(ValueError):
        pooled.walk_forward(prepared, ["a", "b"], n_folds=2, min_train=500)


def test_one_writer_wins_a_version(spark, tmp_path):
    log, other = (runlog.RunLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert log.latest() == 0 and log.state().count() == 0
    assert log.start("r1", "weekly", {"rows": 3}) == 1
    seen = other.latest()
    log.start("r2", "daily")
    with pytest.raises(runlog.Conflict):
        other.append(seen, "r3", "RUNNING", "daily")
    assert other.start("r3", "daily") == 3
    for run, status in (("r1", "RUNNING"), ("r9", "OK"), ("r1", "DONE")):
        with pytest.raises(ValueError):
            log.append(log.latest(), run, status)
    log.finish("r1", "OK", {"ic": 0.02})
    with pytest.raises(ValueError):
        log.finish("r1", "FAILED")
    now = {r["run_id"]: r for r in log.state().collect()}
    assert (now["r1"]["status"], now["r1"]["metrics"], now["r1"]["facts"], now["r1"]["job"]) == ("OK", '{"ic": 0.02}', '{"rows": 3}', "weekly") and now["r2"]["status"] == "RUNNING" and now["r2"]["finished_at"] is None
    assert {r["run_id"]: r["status"] for r in log.state(upto=2).collect()} == {"r1": "RUNNING", "r2": "RUNNING"}
    log._claim(5)  # a writer that was lost after its claim
    assert log.state().count() == 3 and log.start("r4", "daily") == 6


def test_gradings_are_stored_once_and_lists_open_intervals(spark):
    store = spark.createDataFrame([], "run_id string, graded_at timestamp, ticker long, grade string")
    one, two = (spark.createDataFrame(r, "ticker long, grade string") for r in ([(1, "WEAK"), (2, "STRONG")], [(1, "STRONG")]))
    store = runlog.store_grading(store, one, "a", "2024-01-01")
    store = runlog.store_grading(runlog.store_grading(store, two, "b", "2024-01-02"), one, "a", "2024-01-03")
    assert {tuple(r) for r in runlog.latest_grades(store).collect()} == {(1, "STRONG", "WEAK", "b"), (2, "STRONG", None, "a")}
    d = lambda s: date.fromisoformat(s)
    iv = spark.createDataFrame([(1, d("2020-01-01"), d("2020-12-31")), (2, d("2020-01-01"), d("9999-12-31"))], "ticker long, effective_from date, effective_to date")
    lists = spark.createDataFrame([(d("2021-03-01"), 1), (d("2020-12-31"), 1), (d("2021-02-01"), 1), (d("2021-02-01"), 1), (d("2021-02-01"), 2), (d("2021-02-01"), 3)], "day date, ticker long")
    got = {(r["ticker"], r["effective_from"]) for r in runlog.merge_snapshots(iv, lists).collect()}
    assert got == {(1, d("2020-01-01")), (1, d("2021-02-01")), (2, d("2020-01-01")), (3, d("2021-02-01"))}
    assert runlog.merge_snapshots(runlog.merge_snapshots(iv, lists), lists).count() == 4


def test_a_changed_value_refuses_the_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 3}", None if i % 4 else float(i)) for i in range(50)], "id long, name string, v double")
    path = f"file://{tmp_path}/snap"
    snapshots.write_snapshot({"a": df, "b": df.limit(0)}, path, "id", files=3)
    back = snapshots.load_snapshot(spark, path)
    assert back["a"].count() == 50 and back["b"].count() == 0
    assert snapshots.digest(df).first() == snapshots.digest(df.orderBy(F.desc("id")).repartition(7)).first()
    for other in (df.union(df.limit(1)), df.withColumn("v", F.coalesce("v", F.lit(0.0))), df.filter("id > 0")):
        assert snapshots.digest(other).first() != snapshots.digest(df).first()
    back["a"].withColumn("name", F.when(F.col("id") == 7, "x").otherwise(F.col("name"))).write.parquet(f"{path}/new")
    import shutil

    shutil.rmtree(tmp_path / "snap" / "a")
    shutil.move(str(tmp_path / "snap" / "new"), str(tmp_path / "snap" / "a"))
    with pytest.raises(snapshots.Mismatch):
        snapshots.load_snapshot(spark, path)
