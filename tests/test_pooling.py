"""Pooling against closed forms and loops; symbol chains; JSON parsers."""

import datetime as dt
import math

import numpy as np

from tidepool.operators import pooling


def test_reml_solves_its_equation(spark):
    r = np.random.default_rng(4)
    v = r.uniform(0.01, 0.05, 40)
    x = 0.2 + r.normal(size=40) * np.sqrt(v + 0.1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, v)], "x double, v double")
    tau2 = pooling.reml_tau2(df, "x", "v")
    w = 1 / (v + tau2)
    mean = (w * x).sum() / w.sum()
    assert abs((w**2 * ((x - mean) ** 2 - v)).sum() / (w**2).sum() + 1 / w.sum() - tau2) < 1e-9 and 0.03 < tau2 < 0.25
    same = spark.createDataFrame([(0.5, 1.0)] * 5, "x double, v double")
    assert pooling.reml_tau2(same, "x", "v") == 0.0
    out = pooling.pooled_interval(df, "x", "v", tau2, 2.0227).first()
    half = 2.0227 * math.sqrt((w * (x - mean) ** 2).sum() / (39 * w.sum()))
    assert math.isclose(out["low"], mean - half) and math.isclose(out["high"], mean + half)


def test_symbol_chains(spark):
    d = lambda y: dt.date(y, 1, 1)
    df = spark.createDataFrame([("A", "B", d(2010)), ("B", "C", d(2015)), ("X", "Y", d(2012)), ("P", "Q", d(2001)), ("Q", "P", d(2002))], "old string, new string, day date")
    out = {tuple(x) for x in pooling.symbol_intervals(df, 5).collect()}
    first, last = dt.date(1900, 1, 1), dt.date(9999, 12, 31)
    assert out == {("C", "C", d(2015), last), ("C", "B", d(2010), d(2015)), ("C", "A", first, d(2010)), ("Y", "Y", d(2012), last), ("Y", "X", first, d(2012))}


def test_json_parsers(spark):
    h = spark.createDataFrame([('{"CM":[{"tradingDate":"26-Jan-2024","description":"Republic"},{"tradingDate":"bad","description":"x"}],"FO":[]}',), ("nonsense",)], "json string")
    assert [tuple(x) for x in pooling.parse_holidays(h).collect()] == [("CM", dt.date(2024, 1, 26), "Republic")]
    f = spark.createDataFrame([('[{"category":"FII/FPI *","date":"05-Feb-2024","netValue":"-1,234.5"},{"category":"DII **","date":"05-Feb-2024","netValue":"n/a"}]',)], "json string")
    assert [tuple(x) for x in pooling.parse_flows(f).collect()] == [(dt.date(2024, 2, 5), "fii", -1234.5)]


def test_long_rename_chains_reach_back_to_the_start(spark):
    rows = [(f"s{i}", f"s{i + 1}", f"{2000 + i}-01-01") for i in range(15)]
    df = spark.createDataFrame(rows, "old string, new string, day string").selectExpr("old", "new", "cast(day as date) as day")
    out = {x["used"]: (str(x["valid_from"]), str(x["valid_to"])) for x in pooling.symbol_intervals(df).collect()}
    assert len(out) == 16 and out["s0"] == ("1900-01-01", "2000-01-01") and out["s15"] == ("2014-01-01", "9999-12-31")
