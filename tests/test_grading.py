"""Pooling, grades and their control of multiplicity on panels whose truth is planted."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import grading


def _reml(x, v):
    tau2 = max(np.var(x, ddof=1) - np.mean(v), 0)
    for _ in range(200):
        w = 1 / (v + tau2)
        mu = (w * x).sum() / w.sum()
        new = max((w**2 * ((x - mu) ** 2 + 1 / w.sum() - v)).sum() / (w**2).sum(), 0)
        if abs(new - tau2) < 1e-12:
            return new
        tau2 = new
    return tau2


def test_pooling_runs_side_by_side_for_all_keys(spark):
    rng = np.random.default_rng(0)
    sets = {0: (rng.normal(0.1, 0.3, 30), rng.uniform(0.01, 0.1, 30)), 1: (np.full(5, 0.2), np.full(5, 0.1)), 2: (rng.normal(0, 0.05, 12), np.full(12, 0.5)), 3: (np.array([0.4]), np.array([0.1]))}
    rows = [(k, float(a), float(b)) for k, (x, v) in sets.items() for a, b in zip(x, v)] + [(0, None, 0.1), (0, 1.0, None), (0, 9.0, 0.0), (0, float("nan"), 0.1)]
    got = {r["k0"]: r for r in grading.pool(spark.createDataFrame(rows, "k0 int, x double, v double"), ["k0"]).collect()}
    for k, (x, v) in sets.items():
        if len(x) < 2:
            assert got[k]["tau2"] == 0 and got[k]["mu"] is None
            continue
        tau2 = _reml(x, v)
        w = 1 / (v + tau2)
        q = (x**2 / v).sum() - (x / v).sum() ** 2 / (1 / v).sum()
        assert got[k]["k"] == len(x) and got[k]["tau2"] == pytest.approx(tau2, abs=1e-10) and got[k]["mu"] == pytest.approx((w * x).sum() / w.sum()) and got[k]["mu_var"] == pytest.approx(1 / w.sum()) and got[k]["q"] == pytest.approx(q, abs=1e-9)
    assert got[0]["tau2"] > 0.005 and got[1]["tau2"] == got[2]["tau2"] == 0


def _products(spark, level, names=24, dates=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(d // 60, i, date(2020, 1, 1) + timedelta(days=d), float(level(i) + rng.normal(0, 0.6))) for d in range(dates) for i in range(names) if i != 5 or d < 120]
    return spark.createDataFrame(rows, "fold int, ticker long, date date, product double")


def test_grades_tell_strong_names_from_none_and_short_ones(spark):
    names, panel = grading.grade_panel(_products(spark, lambda i: 0.5 if i < 4 else 0.0), replicates=120, block=5)
    got = {r["ticker"]: r for r in names.collect()}
    assert [got[i]["grade"] for i in range(4)] == ["STRONG"] * 4 and all(got[i]["bh"] and got[i]["by"] and got[i]["rw_p"] < 0.1 for i in range(4))
    assert got[5]["grade"] == "INSUFFICIENT" and got[5]["folds"] == 2 and got[5]["theta"] is None and not got[5]["bh"]
    assert sum(got[i]["grade"] == "STRONG" for i in range(6, 24)) == 0 and {r["source"] for r in got.values()} == {"bootstrap"}
    p = grading.headline(panel).first()
    assert (p["names"], p["usable"], p["strong"], p["degenerate"]) == (24, 23, 4, False) and p["tau2"] > 0.005 and p["text"].startswith("4 of 23 names survive")


def test_a_panel_of_equal_names_is_one_statement(spark):
    names, panel = grading.grade_panel(_products(spark, lambda i: 0.2, seed=3), replicates=60, block=5)
    p = grading.headline(panel).first()
    assert p["degenerate"] and p["text"].startswith("The names cannot be told apart") and p["z"] > 5
    thetas = [r["theta"] for r in names.filter("theta is not null").collect()]
    assert max(thetas) - min(thetas) < 0.1
    few = _products(spark, lambda i: 0.2, names=3, dates=60)
    none = grading.headline(grading.grade_panel(few, replicates=5, block=5)[1]).first()
    assert none["usable"] == 0 and none["degenerate"] and none["text"].startswith("No name can be graded") and none["insufficient"] == 3


def test_the_older_grading_names_backwards_orderings(spark):
    rows = [(i, x, 0.001) for i, x in enumerate([0.4, 0.35, -0.4, -0.3, 0.0, 0.01, 0.05, -0.01])] + [(20, None, None), (21, 0.3, None)]
    got = {r["ticker"]: r["grade"] for r in grading.grade_by_pooling(spark.createDataFrame(rows, "ticker long, x double, v double")).collect()}
    assert got[0] == got[1] == "STRONG" and got[2] == got[3] == "ANTI_SIGNAL" and got[4] == "INSUFFICIENT" and got[20] == got[21] == "INSUFFICIENT"
    bar = {r["ticker"]: r["grade"] for r in grading.grade_by_pooling(spark.createDataFrame(rows, "ticker long, x double, v double"), break_even=0.38).collect()}
    assert bar[0] == "STRONG" and bar[1] == "WEAK"  # real, but below its costs


def test_counts_of_two_gradings(spark):
    old, new = (spark.createDataFrame(r, "ticker long, grade string") for r in ([(1, "A"), (2, "A"), (3, "B")], [(1, "A"), (2, "B"), (4, "B")]))
    assert {tuple(r) for r in grading.clean_up_counts(new, old).collect()} == {("A", "A", 1), ("A", "B", 1), ("B", None, 1), (None, "B", 1)}


def test_ranks_drop_thin_dates(spark):
    rows = [(0, i, date(2020, 1, d), float(i), float(-i)) for d in (1, 2) for i in range(12 if d == 1 else 9)]
    out = grading.ranked_products(spark.createDataFrame(rows, "fold int, ticker long, date date, y double, p double"), "y", "p")
    assert {r["date"] for r in out.collect()} == {date(2020, 1, 1)} and out.agg(F.avg("product")).first()[0] == pytest.approx(-1)
