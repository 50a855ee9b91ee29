"""Calendars, placebos, comparators, records and the gate: registered SQL, guards that must fire, planted cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_panel import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.operators import comparators, placebos, quality, records, sessions
from tidepool.plans import catalog, extra, ledger, more, study  # noqa: F401

NAMES = ["session_filter", "calendar_live_merge", "constant_comparators", "best_comparator", "regime_ridge", "joint_permutation", "synthetic_predictions", "gate_driver", "announcement_pick", "merged_splits",
         "split_windows", "universe_audit_scan", "positive_chance", "block_bootstrap", "romano_wolf", "recursive_indicators", "news_window_features", "action_factors"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())


def days_of(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(x) if x else None,) for x in days], "date date")


def test_calendar_decides_sessions_and_refuses_uncovered_years(spark):
    raw = spark.createDataFrame([('{"closed_weekdays": {"2024-01-26": "Republic Day"}, "weekend_sessions": {"2024-01-20": "drill"}, "years": [2024]}',)], "raw string")
    cal = sessions.decode(raw)
    df = days_of(spark, "2024-01-25", "2024-01-26", "2024-01-20", "2024-01-21", None)
    got = {str(x["date"]): x["is_session"] for x in sessions.with_session(df, cal).collect()}
    assert got == {"2024-01-25": True, "2024-01-26": False, "2024-01-20": True, "2024-01-21": False, "None": False}
    kept, dropped = sessions.drop_non_sessions(df, cal)
    assert kept.count() == 2 and {str(x["date"]) for x in dropped.collect()} == {"2024-01-26", "2024-01-21", "None"}
    with pytest.raises(sessions.CalendarNotCurrent):
        sessions.with_session(days_of(spark, "2025-01-02"), cal)
    longer = sessions.merge_live(cal, days_of(spark, "2025-01-02", "2025-01-04", "2024-03-01"), F.lit("2024-12-31").cast("date"), 2025)
    assert not sessions.with_session(days_of(spark, "2025-01-02"), longer).first()["is_session"]
    assert {str(x["date"]) for x in longer.filter("kind = 'closed'").collect()} == {"2024-01-26", "2025-01-02"}  # a Saturday is no closure


def test_placebos_move_values_and_nothing_else(spark):
    rows = [(0, d, t, float(100 * d + t), float(t)) for d in range(6) for t in range(30)]
    df = spark.createDataFrame(rows, "fold int, date int, ticker int, y_true double, x double")
    out = placebos.permute_within(df, ["date"], "ticker", ["y_true", "x"], F.lit(3)).toPandas()
    assert len(out) == 180 and (out.y_true - 100 * out.date == out.x).all() and (out.x != out.ticker).mean() > 0.8
    assert sorted(map(tuple, out[["date", "x"]].to_numpy().tolist())) == sorted((float(r[1]), r[4]) for r in rows)
    band = placebos.null_band(df, 60, 1, 10, 1).first()
    assert band["n_rebalances"] == 6 and abs(band["null_mean"]) < 0.06 and 0.04 < band["null_sd"] < 0.13
    planted = placebos.planted(df, F.lit(0.5), 2).toPandas()
    assert 0.3 < np.mean([np.corrcoef(g.y_true, g.y_pred)[0, 1] for _, g in planted.groupby("date")]) < 0.7
    z = spark.range(4000).select(placebos.normal(placebos.draw(F.col("id"))).alias("z")).toPandas().z
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_leakage_is_seen_and_raises(spark):
    rows = lambda a, b: spark.createDataFrame([(0, i) for i in range(a, b)], "fold int, pos int")
    comparators.assert_no_leakage(rows(0, 10), rows(40, 50), 30)
    with pytest.raises(ValueError):
        comparators.assert_no_leakage(rows(0, 11), rows(40, 50), 30)


def test_comparators_and_chances(spark):
    import math

    t = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", float("nan")), ("d", None)], "comparator string, m double")
    assert comparators.best(t, "m").first()["best"] == "a" and comparators.best(t.filter("m is null"), "m").count() == 0
    z = spark.createDataFrame([(x / 7, 1.0) for x in range(-40, 41)] + [(0.0, 0.0), (-1.0, 0.0)], "theta double, v double")
    for r in z.withColumn("p", comparators.positive_chance(F.col("theta"), F.col("v"))).collect():
        want = 0.5 * (1 + math.erf(r["theta"] / math.sqrt(2))) if r["v"] else {0.0: 0.5, -1.0: 0.0}[r["theta"]]
        assert abs(r["p"] - want) < 1e-7


def test_gate_outlives_a_check_that_raises(spark):
    ok = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "ticker long, date date")
    twice = ok.union(ok)
    report = quality.drive(spark, {"a": lambda: quality.duplicate_keys(ok), "b": lambda: quality.duplicate_keys(twice), "c": lambda: ok.select("none")})
    assert {x["check"]: x["status"] for x in report.collect()} == {"a": "PASS", "b": "FAIL", "c": "FAIL"}
    assert {x["list"]: x["checks"] for x in quality.status_lists(report).collect()} == {"failures": "b,c", "warnings": None}


def test_each_gate_check_sees_its_defect(spark):
    r = np.random.default_rng(0)
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0, 11.0, 9.0, 10.0 + r.random(), 50.0) for t in range(12) for i in range(40)]
    cols = "ticker long, date date, open double, high double, low double, close double, volume double"
    base = spark.createDataFrame(rows, cols)
    lab = lambda b: b.withColumns({"roc": F.col("close") / 10, "target": F.col("close") / 100})
    universe = spark.createDataFrame([(t,) for t in range(12)], "ticker long")
    none = base.limit(0)

    def bad(bars, labelled, u=universe):
        return {n for n, c in quality.panel_checks(bars, labelled, u, none, "2024-02-12", 30).items() if c().first()["n_bad"]}

    assert bad(base, lab(base)) == set()
    assert "duplicate_keys" in bad(base.union(base.limit(1)), lab(base))
    late = base.withColumn("date", F.date_add("date", 9))
    assert "future_dates" in bad(late, lab(base)) and "stale" in bad(base.filter("date < '2024-01-20'"), lab(base))
    assert "finite_features" in bad(base, lab(base).withColumn("roc", F.lit(float("inf"))))
    more = universe.union(spark.createDataFrame([(99,)], "ticker long"))
    assert {"label_coverage", "benchmark_coverage"} <= bad(base, lab(base), more)
    jump = base.withColumn("close", F.when(F.col("date") > "2024-01-20", F.col("close") * 2).otherwise(F.col("close")))
    assert "price_breaks" in bad(jump, lab(base)) and "target_distribution" in bad(base, lab(base).withColumn("target", F.lit(2.0)))
    assert "sessions_contiguous" in bad(base.filter("not (ticker = 1 and date = '2024-01-09')"), lab(base))
    assert "flat_days" in bad(base.withColumns({"open": F.col("close"), "high": F.lit(1.0), "low": F.lit(1.0)}), lab(base))
    assert "silent_neutrals" in bad(base, lab(base).withColumn("roc", F.lit(0.0)))


def test_guards_on_deletion_and_coverage(spark):
    stored = spark.createDataFrame([(i,) for i in range(10)], "k int")
    assert records.prune(stored, stored.filter("k < 8"), "k").count() == 8
    for universe in (stored.filter("k < 7"), stored.limit(0)):
        with pytest.raises(ValueError):
            records.prune(stored, universe, "k")
    records.assert_coverage(stored.filter("k < 5"), stored, "k")
    with pytest.raises(ValueError):
        records.assert_coverage(stored.filter("k < 4"), stored, "k")


def test_comparators_equal_in_every_fold_tie_whatever_the_order_of_rows(spark):
    rates = [(0, 0.1), (1, 0.2), (2, 0.3)]
    rows = [(f, "early", 1.0, x) for f, x in reversed(rates)] + [(f, "late", 1.0, x) for f, x in rates]  # 0.3 + 0.2 + 0.1 < 0.1 + 0.2 + 0.3
    metrics = spark.createDataFrame(rows, "fold int, comparator string, mae double, hit_rate double").coalesce(1)
    table = comparators.comparison(metrics)
    assert len({x["hit_rate"] for x in table.collect()}) == 1
    assert comparators.best(table, "hit_rate").first()["best"] == "early"
