"""Panel operators: registered SQL, identities, planted signals, guards that must fire, no look-ahead."""

import datetime as dt
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.functions import recursive, text
from tidepool.operators import crosssection, folds, joins, portfolio, quality, statistics, windows
from tidepool.plans import catalog
from tidepool.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float, np.number, np.bool_)) else str(v))
    return sorted(map(repr, df.itertuples(index=False, name=None)))


NAMES = ["bars_daily", "sma_bollinger", "market_state", "cs_zscore", "daily_rank_ic", "asof_fundamentals", "macro_grid_ffill", "next_session", "beta_market_floor", "benjamini_hochberg",
         "expanding_coverage", "gate_report", "article_identity", "latest_forecast_per_day", "revision_log"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())


def panel(spark, names=12, days=150, seed=0, shock=None):
    r = np.random.default_rng(seed)
    rows = []
    for t in range(names):
        price = 100 * np.exp(np.cumsum(0.01 * r.normal(size=days)))
        for i in range(days):
            c = float(price[i] * (shock if shock and i >= 100 else 1))
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, c, float(100 + i)))
    return spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, adj_close double, volume double")


@pytest.mark.parametrize("feature", [windows.bollinger, windows.stochastic, windows.obv, windows.rate_of_change, windows.lag_returns, windows.reversal, recursive.recursive_indicators])
def test_the_future_changes_nothing_before_it(spark, feature):
    past = F.col("date") < F.lit("2020-04-10").cast("date")
    a, b = (feature(panel(spark, 3, shock=s)).filter(past).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True) for s in (None, 3.0))
    pd.testing.assert_frame_equal(a, b)


def test_recursive_indicators_against_a_loop(spark):
    p = panel(spark, 1)
    got = recursive.recursive_indicators(p).toPandas().sort_values("date")
    close = p.orderBy("date").toPandas().close.tolist()
    ema, gain, loss = close[0], None, None
    for i, c in enumerate(close[1:], 1):
        ema += (c - ema) * 2 / 10
        up, down = max(c - close[i - 1], 0.0), max(close[i - 1] - c, 0.0)
        gain, loss = (up, down) if gain is None else (gain + (up - gain) / 14, loss + (down - loss) / 14)
    assert math.isclose(got.ema_9.iloc[-1], ema) and math.isclose(got.rsi_14.iloc[-1], 100 - 100 / (1 + gain / loss)) and got.ema_9.iloc[:8].isna().all()


def test_label_is_the_difference_of_the_price_basis(spark):
    out = windows.forward_label(panel(spark, 2), 30).toPandas().sort_values(["ticker", "date"])
    for _, g in out.groupby("ticker"):
        lp = np.log(g.close.to_numpy())
        assert np.allclose(g.target.to_numpy()[:-30], lp[30:] - lp[:-30]) and g.target.iloc[-30:].isna().all()


def test_folds_leave_a_gap_and_planted_signal_is_seen(spark):
    p = windows.forward_label(panel(spark, 12, 150), 5)
    grid = folds.date_grid(p)
    table = folds.fold_table(grid, 3, 60, 5, 5).toPandas()
    assert (table.train_end + 10 == table.test_start).all() and (table.test_end <= 150).all() and len(table) == 3
    some = p.filter("target is not null")
    planted = some.withColumn("y_pred", F.col("target"))
    ic = crosssection.rank_ic(planted, "target", "y_pred", ["date"]).toPandas()
    assert np.allclose(ic.ic, 1.0)
    book = portfolio.rebalance_books(planted.withColumnRenamed("target", "y_true"), 10)
    report = portfolio.cross_sectional_report(book).toPandas()
    assert len(report) == 15 and (report.spread > 0).all()
    flat = portfolio.rebalance_books(planted.withColumnRenamed("target", "y_true").withColumn("y_pred", F.lit(0.0)), 10)
    assert flat.count() == 0
    path = portfolio.simulate(book).toPandas().sort_values("date")
    assert path.turnover.iloc[0] == 0.5 and (path.net <= path.gross).all()


def test_rank_ic_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("d", 1.0, 2.0), ("d", 2.0, 2.0), ("d", 3.0, 2.0), ("e", 1.0, 1.0)], "date string, a double, b double")
    assert {x["date"]: x["ic"] for x in crosssection.rank_ic(df, "a", "b", ["date"]).collect()} == {"d": None, "e": None}


def test_zscore_edges(spark):
    df = spark.createDataFrame([("thin", float(i)) for i in range(5)] + [("flat", 1.0)] * 12 + [("good", float(i)) for i in range(11)] + [("good", None), ("good", 1000.0)], "date string, x double")
    out = crosssection.zscore(df, "x", "z").toPandas()
    assert (out[out.date != "good"].z == 0).all() and out[out.date == "good"].z.max() == 3.0 and out.z.notna().all()


def test_asof_exact_ties_and_nothing_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 4), (1, 9), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 8, 2.0), (1, None, 9.0)], "k int, r int, v double")
    got = {(x["k"], x["t"]): x["v"] for x in joins.asof_backward(left, right, by=["k"], left_on="t", right_on="r", values=["v"]).collect()}
    assert got == {(1, 5): 1.0, (1, 4): None, (1, 9): 2.0, (2, 3): None}
    strict = {(x["k"], x["t"]): x["v"] for x in joins.asof_backward(left, right, by=["k"], left_on="t", right_on="r", values=["v"], strict=True).collect()}
    assert strict[1, 5] is None and strict[1, 9] == 2.0


def test_conformal_is_an_order_statistic(spark):
    df = spark.createDataFrame([("a", float(i), 0.0) for i in range(1, 31)] + [("b", 1.0, 0.0)], "k string, y double, p double")
    got = {x["k"]: x["q"] for x in statistics.conformal_quantile(df, ["k"], "y", "p", 0.8).collect()}
    assert got == {"a": 25.0, "b": None}  # ceil(31 * 0.8) = 25


def test_multiplicity_and_shrinkage(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.5,), (0.9,)], "p double")
    marks = lambda **o: sum(x["significant"] for x in statistics.benjamini_hochberg(df, "p", 0.1, **o).collect())
    assert marks() == 3 and marks(dependent=True) == 1  # 0.1 / (1 + 1/2 + ... + 1/5) / 5 = 0.0088, doubled 0.0175
    d = spark.createDataFrame([(0.1, 0.01), (0.5, 0.01), (0.9, 0.04)], "x double, v double")
    s = statistics.dersimonian_laird(d, "x", "v").first()
    w = np.array([100, 100, 25.0])
    x = np.array([0.1, 0.5, 0.9])
    mean = (w * x).sum() / w.sum()
    q = (w * (x - mean) ** 2).sum()
    assert math.isclose(s["q"], q) and math.isclose(s["tau2"], (q - 2) / (w.sum() - (w**2).sum() / w.sum()))


def test_driscoll_kraay_without_lags_is_the_plain_error(spark):
    x = [1.0, 2.0, 4.0, 3.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "date int, x double")
    assert math.isclose(statistics.driscoll_kraay(df, "x", 0).first()["se"], np.std(x) / math.sqrt(5))


def test_ridge_equals_the_closed_form(spark):
    r = np.random.default_rng(5)
    a = r.normal(size=(200, 2))
    y = a @ [0.5, -1.0] + 0.1 * r.normal(size=200)
    df = spark.createDataFrame([(0, float(u), float(v), float(t)) for (u, v), t in zip(a, y)], "fold int, u double, v double, target double")
    b, w = folds.ridge(df, ["u", "v"])[0]
    c, m = a - a.mean(axis=0), y - y.mean()
    want = np.linalg.solve(c.T @ c + np.eye(2), c.T @ m)
    assert np.allclose(w, want) and math.isclose(b, y.mean() - a.mean(axis=0) @ want)


def test_gate_fires_on_injected_defects(spark):
    p = panel(spark, 3, 40)
    twice = p.union(p.limit(1))
    assert quality.duplicate_keys(p).first()["status"] == "PASS" and quality.duplicate_keys(twice).first()["status"] == "FAIL"
    assert quality.future_dates(p, "2020-01-05").first()["n_bad"] > 0 and quality.stale(p, "2021-01-01").first()["status"] == "FAIL"
    assert quality.not_finite(p.withColumn("close", F.lit(float("inf"))), ["close"]).first()["status"] == "FAIL"
    broken = p.withColumn("close", F.when(F.col("date") > "2020-01-20", F.col("close") * 2).otherwise(F.col("close")))
    assert quality.price_breaks(broken, p.limit(0)).first()["n_bad"] == 3
    split = p.select("ticker").distinct().withColumn("date", F.lit("2020-01-21").cast("date"))
    assert quality.price_breaks(broken, split).first()["status"] == "PASS"
    gap = quality.contiguous(p.filter("not (ticker = 1 and date = '2020-01-10')"), p.select("date").distinct()).toPandas()
    assert gap.gap.sum() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("https://A.com/x?utm_id=q&ref=Home#t", " The  Title ", "Acme Industries Ltd.", "1,234.5", "<think>no</think> yes <think>open", '```json\n{"a": 1}\n```', " NaN ")], "u string, t string, c string, n string, r string, j string, l string")
    out = df.select(text.article_identity(F.col("u"), F.col("t")).alias("a"), text.article_identity(F.lit("https://a.com/x"), F.lit("")).alias("b"), text.core_name(F.col("c")).alias("c"),
                    text.parse_number(F.col("n")).alias("n"), text.strip_reasoning(F.col("r")).alias("r"), F.get_json_object(text.extract_json(F.col("j")), "$.a").alias("j"),
                    text.clean_label(F.col("l")).alias("l"), text.matches_alias(F.lit("About ACME-Corp."), F.lit("ACME")).alias("m"), text.matches_alias(F.lit("about acme"), F.lit("ACME")).alias("k")).first()
    assert out["a"] == out["b"] and tuple(out)[2:] == ("Acme Industries", 1234.5, "yes", "1", None, True, False)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    (e.repartition(3).write.parquet(f"{tmp_path}/landing"))
    stream = ingest.read_landing(spark, f"{tmp_path}/landing", e.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    ingest.write_once(ingest.fresh_articles(stream, "event_id"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == e.select("event_id").distinct().count()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10 and set(entry.oracle_sql()) <= set(entry.queries())


def test_market_floor_never_beats_itself(spark):
    """Each evaluation of these rows gives another mae, as sums in another order do."""
    import random

    other = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.createDataFrame([(f, c) for f in range(20) for c in ("market", "beta_market")], "fold int, comparator string").withColumn("mae", other())
    own = folds.annotate_floors(rows).filter("comparator = 'market'").collect()
    assert len(own) == 20 and all(x["mae_vs_market"] == 0 and not x["beats_market"] for x in own)
    alone = spark.createDataFrame([(0, "beta_market", 1.0)], "fold int, comparator string, mae double")
    assert folds.annotate_floors(alone).select("mae_vs_market", "beats_market").first() == (None, None)


def test_panel_compare_rounds_as_its_sql(spark, tmp_path):
    day = dt.date(1995, 7, 6)  # close 5607.9665 and adj_close 5607.9664999999995, both 5607.967 as rounded doubles
    lines = [(1, 1, 1, 864, 19.0, 101306.76, 0.06, 0.05, day), (2, 2, 1, 864, 1.0, 10852.57, 0.05, 0.06, day)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert plain(catalog.queries()["panel_compare"](spark, str(tmp_path)).toPandas()) == plain(c.sql(catalog.oracle_sql()["panel_compare"]).df())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dependent_step_up_adds_the_harmonic_sum_once(spark):
    r = np.random.default_rng(3)
    p = np.sort(np.concatenate([r.uniform(0, 1e-4, 40), r.uniform(0, 1, 360)]))
    out = statistics.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p], "p double"), "p", dependent=True)
    m = len(p)
    ok = np.flatnonzero(p <= 0.1 * np.arange(1, m + 1) / m / (1 / np.arange(1, m + 1)).sum())
    assert sorted(x["p"] for x in out.filter("significant").collect()) == p[:ok.max() + 1].tolist()
    assert out.columns == ["p", "significant"] and "sequence" not in plan_of(out)  # a sum over 1 to m in each of m rows


def test_distribution_is_exact_and_never_gathers_the_values(spark):
    r = np.random.default_rng(5)
    for x in (r.normal(size=5000), np.round(r.normal(size=3000), 1), np.array([2.5]), np.array([])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 3, "v double")
        out = quality.distribution(df, "v", 1.5)
        got = out.first()
        want = [round(float(q), 6) for q in np.quantile(x, [0.01, 0.99])] if len(x) else [None, None]
        assert (got["n"], got["beyond"]) == (len(x), int((abs(x) > 1.5).sum()))
        assert [got["q01"], got["q99"]] == pytest.approx(want) if len(x) else [got["q01"], got["q99"]] == want
        assert " percentile(" not in plan_of(out)


def test_hurst_equals_brute_force_and_reads_no_frame_in_a_window(spark):
    r = np.random.default_rng(7)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), float(c)) for t, n in ((1, 100), (2, 79), (3, 78)) for i, c in enumerate(np.exp(np.cumsum(r.normal(size=n))))]
    rows += [(4, dt.date(2020, 1, 1) + dt.timedelta(i), 5.0) for i in range(90)] + [(5, dt.date(2020, 1, 1) + dt.timedelta(i), None if i == 40 else float(i + 1)) for i in range(90)]
    out = windows.hurst(spark.createDataFrame(rows, "ticker int, date date, close double").repartition(3))
    assert out.columns == ["ticker", "date", "close", "hurst"] and "stddev_samp" not in plan_of(out)
    got = {(x["ticker"], x["date"]): x["hurst"] for x in out.collect()}
    assert len(got) == len(rows) and all(got[t, d] is None for t, d, _ in rows if t in (3, 4, 5))
    for t, n in ((1, 100), (2, 79)):
        series = [(d, np.log(c)) for k, d, c in rows if k == t]
        for i, (d, _) in enumerate(series):
            if i < 78:
                assert got[t, d] is None
                continue
            lp = np.array([x for _, x in series[:i + 1]])
            sd = [np.std((lp[k:] - lp[:-k])[-60:], ddof=1) for k in range(2, 20)]
            assert got[t, d] == pytest.approx(min(1, max(0, np.polyfit(np.log(range(2, 20)), np.log(sd), 1)[0])), abs=1e-4)


def test_sliding_aggregates_equal_brute_force(spark):
    r = np.random.default_rng(9)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), None if r.random() < 0.2 else float(r.integers(0, 50))) for t, n in ((1, 23), (2, 7), (3, 8), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker int, date date, v double").repartition(3)
    out = windows.sliding(df, 7, {f: (f, F.col("v")) for f in ("sum", "min", "max")}).withColumn("n", windows.held_in("v", 7))
    got = {(x["ticker"], x["date"]): x for x in out.collect()}
    for t in range(1, 5):
        own = [(d, v) for k, d, v in rows if k == t]
        for i, (d, _) in enumerate(own):
            some = [v for _, v in own[max(0, i - 6):i + 1] if v is not None]
            x = got[t, d]
            assert (x["sum"], x["min"], x["max"], x["n"]) == ((sum(some), min(some), max(some), len(some)) if some else (None, None, None, 0))
