"""Registered queries of benchmarks, announcements, outcomes, comparators, tests and coverage reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import announcements, benchmarks, folds, joins, portfolio, statistics, windows
from tidepool.operators import crosssection as xs
from tidepool.plans.catalog import BOOK, DAY, EMBARGO, FOLDS, FUND, HORIZON, LAB, MIN_TRAIN, MOM, PREDS, RET, SECTORS, W, floors, labelled, query, shown, sql_of
from tidepool.sources import tables

HALF_WIDTH = 0.5  # of the intervals of these queries, as a log return

LOO = f"""loo AS (SELECT ticker, date, close, CASE WHEN n1 >= 2 THEN m1 WHEN n2 >= 2 THEN m2 END AS benchmark FROM (SELECT ticker, date, close,
 count(r) OVER a - (r IS NOT NULL)::INT AS n1, (sum(r) OVER a - coalesce(r, 0)) / nullif(count(r) OVER a - (r IS NOT NULL)::INT, 0) AS m1,
 count(r) OVER b - (r IS NOT NULL)::INT AS n2, (sum(r) OVER b - coalesce(r, 0)) / nullif(count(r) OVER b - (r IS NOT NULL)::INT, 0) AS m2
 FROM ret JOIN sec USING (ticker) WINDOW a AS (PARTITION BY date, sector), b AS (PARTITION BY date)))"""
LEVEL = f"""lev AS (SELECT ticker, date, close, exp(sum(coalesce(benchmark, 0)) OVER w) AS level, sum(void) OVER w AS voids FROM
 (SELECT *, CASE WHEN benchmark IS NULL AND row_number() OVER {W} > 1 THEN 1 ELSE 0 END AS void FROM loo) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))"""
EXCESS = f"""exc AS (SELECT *, target - benchmark_target AS excess FROM (SELECT ticker, date, lead(ln(close), {HORIZON}) OVER {W} - ln(close) AS target,
 CASE WHEN lead(voids, {HORIZON}) OVER {W} = voids THEN lead(ln(level), {HORIZON}) OVER {W} - ln(level) END AS benchmark_target FROM lev))"""


def levels(spark, d):
    own = windows.rolling_beta(tables.bars(spark, d)).select("ticker", "date", "close", "r")
    return benchmarks.benchmark_level(xs.loo_sector_return(own, tables.sectors(spark, d)))


@query(sql_of(f"SELECT ticker, {DAY}, CAST(voids AS BIGINT) AS voids, round(ln(level), 5) AS log_level FROM lev", RET, SECTORS, LOO, LEVEL))
def loo_benchmark_level(spark, d):
    out = levels(spark, d).withColumns({"voids": F.col("voids").cast("long"), "log_level": F.log("level")})
    return shown(out, "ticker date voids", "log_level", 5)


@query(sql_of(f"SELECT ticker, {DAY}, round(benchmark_target, 5) AS benchmark_target, round(excess, 5) AS excess FROM exc", RET, SECTORS, LOO, LEVEL, EXCESS))
def excess_label(spark, d):
    return shown(benchmarks.excess_label(levels(spark, d), HORIZON), "ticker date", "benchmark_target excess", 5)


@query(sql_of(f"""SELECT ticker, {DAY}, round(shift, 5) AS shift FROM (SELECT ticker, date, (adj_close / close) / lag(adj_close / close) OVER {W} - 1 AS shift FROM bars) WHERE abs(shift) > 0.0500001"""))
def adjustment_breaks(spark, d):
    return shown(benchmarks.adjustment_breaks(tables.bars(spark, d), 0.0500001), "ticker date", "shift", 5)


@query(sql_of(f"""SELECT ticker, {DAY}, round(1000 * open / level, 5) AS open, round(1000 * close / level, 5) AS close, volume FROM bars LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date,
 nullif(greatest(avg(o_totalprice), 0), 0) AS level FROM orders GROUP BY 1) USING (date)"""))
def relative_candles(spark, d):
    b = tables.bars(spark, d).join(tables.macro(spark, d), "date", "left")
    out = benchmarks.relative_candles(b, F.col("level")).withColumns({c: 1000 * F.col(c) for c in ("open", "close")})
    return shown(out, "ticker date", "open close volume", 5)


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n >= 90 THEN coalesce(v - b, 0) ELSE 0 END, 5) AS series_last_return, round(CASE WHEN n >= 90 THEN coalesce((v - f) / nullif(n - 1, 0) * 30, 0) ELSE 0 END, 5) AS series_drift
 FROM (SELECT ticker, date, ln(close) AS v, lag(ln(close), 30) OVER {W} AS b, first(ln(close)) OVER w AS f, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 511 PRECEDING))"""))
def series_comparators(spark, d):
    return shown(benchmarks.series_comparators(tables.bars(spark, d), HORIZON), "ticker date", "series_last_return series_drift", 5)


@query(sql_of(f"""SELECT ticker, CAST(last AS VARCHAR) AS date, round(close * exp(p), 4) AS expected, round(close * exp(p - {HALF_WIDTH}), 4) AS low_price, round(close * exp(p + {HALF_WIDTH}), 4) AS high_price
 FROM (SELECT ticker, max(date) AS last, arg_max(close, date) AS close, arg_max(roc, date) / 1000 AS p FROM lab WHERE roc IS NOT NULL GROUP BY ticker)""", LAB))
def price_view(spark, d):
    newest = windows.latest(labelled(spark, d).filter("roc is not null"), ["ticker"], [F.col("date").desc()]).withColumn("pred", F.col("roc") / 1000)
    return shown(benchmarks.price_view(newest, "close", "pred", F.lit(HALF_WIDTH)), "ticker date", "expected low_price high_price", 4)


@query(sql_of(f"SELECT ticker, {DAY}, CAST(resolved_on AS VARCHAR) AS resolved_on FROM (SELECT ticker, date, lead(date, {HORIZON}) OVER {W} AS resolved_on FROM bars) WHERE resolved_on IS NOT NULL"))
def resolution_dates(spark, d):
    return shown(announcements.resolution_dates(tables.bars(spark, d), HORIZON), "ticker date resolved_on", "")


RESOLVED = f"""res AS (SELECT ticker, date, resolved_on, pred, target, CASE WHEN pred <> 0 THEN (pred > 0) = (target > 0) END AS direction_ok,
 close * exp(target) >= close * exp(pred - {HALF_WIDTH}) AND close * exp(target) <= close * exp(pred + {HALF_WIDTH}) AS inside FROM
 (SELECT ticker, date, close, target, lead(date, {HORIZON}) OVER {W} AS resolved_on FROM lab) JOIN (SELECT ticker, date, beta_market AS pred FROM preds) USING (ticker, date)
 WHERE target IS NOT NULL AND NOT (ticker % 7 = 0 AND year(date) < 1996))"""


def resolved(spark, d):
    b = labelled(spark, d)
    p = floors(spark, d).select("ticker", "date", F.col("beta_market").alias("pred"))
    issued = p.withColumn("issued", F.lit(2)).union(p.withColumn("pred", F.lit(9.0)).withColumn("issued", F.lit(1)))  # an older forecast of the same day loses
    labels = announcements.with_resolution(b, HORIZON)
    done = b.filter("ticker % 7 = 0 and year(date) < 1996")
    return announcements.resolve_forecasts(issued, done, labels, F.lit(HALF_WIDTH), [F.col("issued").desc()], tables.tasks(spark, d))


@query(sql_of(f"SELECT ticker, {DAY}, CAST(resolved_on AS VARCHAR) AS resolved_on, direction_ok, inside, round(target, 6) AS target FROM res", *PREDS, RESOLVED))
def outcome_resolution(spark, d):
    return shown(resolved(spark, d), "ticker date resolved_on direction_ok inside", "target")


@query(sql_of("SELECT ticker, count(direction_ok) AS n, round(avg(direction_ok::INT), 6) AS accuracy, round(avg(inside::INT), 6) AS inside FROM res GROUP BY ticker", *PREDS, RESOLVED))
def realised_accuracy(spark, d):
    share = lambda c: F.avg(F.col(c).cast("double"))
    return shown(resolved(spark, d).groupBy("ticker").agg(F.count("direction_ok").alias("n"), share("direction_ok").alias("accuracy"), share("inside").alias("inside")), "ticker n", "accuracy inside")


@query(sql_of(f"SELECT ticker, {DAY}, close FROM bars WHERE (ticker, date) IN (SELECT (CAST(l_suppkey AS BIGINT), CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag = 'R')"))
def matched_rows(spark, d):
    keys = tables.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
    return shown(tables.bars(spark, d).join(keys, ["ticker", "date"], "left_semi"), "ticker date", "close", None)


CAL = "cal AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)"


@query(f"""WITH {CAL}, e AS (SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) < 15 AS early FROM events)
 SELECT event_id, CAST(c.date AS VARCHAR) AS session, CASE WHEN day NOT IN (SELECT date FROM cal) THEN 'non_trading_day' WHEN early THEN 'intraday' ELSE 'after_close' END AS timing
 FROM (SELECT *, CASE WHEN early THEN day ELSE day + 1 END AS least_day FROM e) x ASOF LEFT JOIN cal c ON x.least_day <= c.date""")
def usable_sessions(spark, d):
    e = tables.table(spark, d, "events").select("event_id", "ts")
    cal = e.filter(F.dayofweek("ts").between(2, 6)).select(F.to_date("ts").alias("date")).distinct()
    return shown(announcements.usable_sessions(e, cal), "event_id session timing", "").withColumn("session", F.col("session").cast("string"))


POS = "pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars))"


@query(sql_of(f"""SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, CAST(least(coalesce(b.pos - a.pos, 63), 63) AS INT) AS age, CAST((a.pos IS NULL)::INT AS INT) AS missing, round(CASE WHEN b.pos - a.pos < 30 THEN eps ELSE 0 END, 5) AS value
 FROM (SELECT ticker, date, pos FROM bars JOIN pos USING (date)) b ASOF LEFT JOIN (SELECT f.ticker, f.eps, s.pos FROM (SELECT ticker, eps, CAST(period_end + INTERVAL 60 DAY AS DATE) AS day FROM fund) f
 ASOF JOIN pos s ON f.day <= s.date) a ON b.ticker = a.ticker AND b.pos >= a.pos""", FUND, POS))
def event_window_features(spark, d):
    b = tables.bars(spark, d).select("ticker", "date")
    grid = folds.date_grid(b)
    f = tables.fundamentals(spark, d).select("ticker", "eps", F.date_sub("effective_date", 1).alias("_before"))
    known = joins.next_session(f, grid.select("date"), "_before").join(grid, F.col("next_session") == F.col("date")).select("ticker", "pos", "eps")
    return shown(announcements.event_window(b.join(grid, "date"), known, "eps"), "ticker date age missing", "value", 5)


@query(sql_of(f"""SELECT f.ticker, CAST(f.day AS VARCHAR) AS effective_date, round(coalesce(exp(sum(ln(a.factor))), 1), 5) AS factor FROM (SELECT ticker, CAST(period_end + INTERVAL 60 DAY AS DATE) AS day FROM fund) f
 LEFT JOIN (SELECT ticker, date, 1 + (ticker % 5 + 1) / 10.0 AS factor FROM bars WHERE volume >= 90) a ON a.ticker = f.ticker AND a.date <= f.day GROUP BY 1, 2""", FUND))
def share_factors(spark, d):
    actions = tables.bars(spark, d).filter("volume >= 90").select("ticker", F.col("date").alias("ex_date"), (1 + (F.col("ticker") % 5 + 1) / 10.0).cast("double").alias("factor"))
    rows = tables.fundamentals(spark, d).select("ticker", "effective_date")
    return shown(announcements.share_factors(rows, actions, "effective_date"), "ticker effective_date", "factor", 5)


@query(sql_of("""SELECT count(*) AS n, round(avg((eps IS NOT NULL)::INT), 6) AS covered, count(DISTINCT CASE WHEN eps IS NOT NULL THEN ticker END) AS tickers, CAST(min(CASE WHEN eps IS NOT NULL THEN date END) AS VARCHAR) AS first, CAST(max(CASE WHEN eps IS NOT NULL THEN date END) AS VARCHAR) AS last
 FROM (SELECT b.ticker, b.date, f.eps FROM bars b ASOF LEFT JOIN (SELECT *, CAST(period_end + INTERVAL 60 DAY AS DATE) AS effective_date FROM fund) f ON b.ticker = f.ticker AND b.date >= f.effective_date)""", FUND))
def fundamental_coverage(spark, d):
    j = joins.asof_backward(tables.bars(spark, d).select("ticker", "date"), tables.fundamentals(spark, d), by=["ticker"], left_on="date", right_on="effective_date", values=["eps"])
    has = lambda c: F.when(F.col("eps").isNotNull(), F.col(c))
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.col("eps").isNotNull().cast("double")), 6).alias("covered"), F.countDistinct(has("ticker")).alias("tickers"),
                 F.min(has("date")).cast("string").alias("first"), F.max(has("date")).cast("string").alias("last"))


@query("""SELECT user_id AS ticker, round(greatest(-1, least(1, avg(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * value / 100))), 6) AS sentiment, count(*) AS n FROM
 (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM events WHERE value IS NOT NULL) WHERE CAST(ts AS DATE) = last GROUP BY user_id""")
def aggregate_sentiment(spark, d):
    a = tables.articles(spark, d).filter("score is not null")
    newest = a.join(a.groupBy("ticker").agg(F.max("date").alias("date")), ["ticker", "date"])
    sign = F.when(F.col("source") == "click", 1).when(F.col("source") == "error", -1).otherwise(0)
    mean = F.avg(sign * F.col("score") / 100)
    return shown(newest.groupBy("ticker").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("sentiment"), F.count("*").alias("n")), "ticker n", "sentiment")


@query("SELECT event_type AS scorer, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, scorer LIMIT 1")
def current_scorer(spark, d):
    return tables.articles(spark, d).groupBy(F.col("source").alias("scorer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scorer").limit(1)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) ORDER BY k, year LIMIT 40")
def stratified_draw(spark, d):
    """A round robin over years in an order fixed by a hash; each year's first forty come by a bounded top-k, not a full sort."""
    o = tables.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    w = Window.partitionBy("year").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey")
    return o.withColumn("k", F.row_number().over(w)).filter("k <= 40").orderBy("k", "year").limit(40).drop("k")


@query(sql_of("""SELECT bucket, sha256(string_agg(ticker || ':' || n || ':' || labels || ':' || lo || ':' || hi, ',' ORDER BY ticker)) AS digest FROM (SELECT ticker, ticker % 16 AS bucket, count(*) AS n, count(target) AS labels, min(date) AS lo, max(date) AS hi FROM lab GROUP BY ticker) GROUP BY bucket""", LAB))
def data_fingerprint(spark, d):
    per = labelled(spark, d).groupBy("ticker").agg(F.concat_ws(":", F.col("ticker"), F.count("*"), F.count("target"), F.min("date"), F.max("date")).alias("s"))
    lines = F.array_sort(F.collect_list(F.struct("ticker", "s")))  # one short line an instrument
    return per.groupBy((F.col("ticker") % 16).alias("bucket")).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["s"]), ","), 256).alias("digest"))


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN sd > 0 THEN (target - mean) / sd END, 5) AS z FROM lab JOIN mom USING (date)""", LAB, MOM))
def standardised_label(spark, d):
    lab = labelled(spark, d)
    out = lab.join(xs.moments(lab, "target"), "date")
    return shown(out.withColumn("z", F.when(F.col("sd") > 0, (F.col("target") - F.col("mean")) / F.col("sd"))), "ticker date", "z", 5)


CAUSAL = """causal AS (SELECT date, CASE WHEN count(m1) OVER w >= 20 THEN avg(m1) OVER w END AS causal_mean, CASE WHEN count(s1) OVER w >= 20 THEN avg(s1) OVER w END AS causal_sd FROM
 (SELECT date, lag(mean, 30) OVER (ORDER BY date) AS m1, lag(sd, 30) OVER (ORDER BY date) AS s1 FROM mom) WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))"""


@query(sql_of(f"SELECT ticker, {DAY}, round(roc / 100 * causal_sd + causal_mean, 5) AS y_pred FROM lab LEFT JOIN causal USING (date)", LAB, MOM, CAUSAL))
def invert_predictions(spark, d):
    lab = labelled(spark, d)
    out = lab.join(xs.causal_moments(xs.moments(lab, "target")), "date", "left")
    return shown(out.withColumn("y_pred", F.col("roc") / 100 * F.col("causal_sd") + F.col("causal_mean")), "ticker date", "y_pred", 5)


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(r, 5) AS q FROM (SELECT fold, n, r, i FROM (SELECT fold, abs(y_true - market) / causal_sd AS r, count(*) OVER (PARTITION BY fold) AS n,
 row_number() OVER (PARTITION BY fold ORDER BY abs(y_true - market) / causal_sd) AS i FROM preds JOIN causal USING (date) WHERE causal_sd > 0) WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))) t GROUP BY fold, r""", *PREDS, MOM, CAUSAL)
       .replace("count(*) AS n, round(r, 5)", "max(n) AS n, round(r, 5)"))
def scaled_conformal(spark, d):
    sd = xs.causal_moments(xs.moments(labelled(spark, d), "target")).filter("causal_sd > 0")
    scaled = floors(spark, d).join(sd, "date").select("fold", (F.col("y_true") / F.col("causal_sd")).alias("y"), (F.col("market") / F.col("causal_sd")).alias("p"))
    return shown(statistics.conformal_quantile(scaled, ["fold"], "y", "p"), "fold n", "q", 5)


COVERED = """cov AS (SELECT a.fold, count(*) AS n, avg((abs(a.y_true - a.market) <= q)::INT) AS coverage FROM preds a JOIN (SELECT f, r AS q FROM
 (SELECT g.fold AS f, abs(y_true - market) AS r, count(*) OVER (PARTITION BY g.fold) AS n, row_number() OVER (PARTITION BY g.fold ORDER BY abs(y_true - market)) AS i FROM preds p JOIN (SELECT DISTINCT fold FROM preds) g ON p.fold < g.fold)
 WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))) ON f = a.fold GROUP BY a.fold)"""


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, n, round(coverage, 6) AS coverage, coverage BETWEEN 0.70 AND 0.90 AS ok FROM cov UNION ALL SELECT -1, CAST(sum(n) AS BIGINT), round(sum(coverage * n) / sum(n), 6), sum(coverage * n) / sum(n) BETWEEN 0.75 AND 0.85 FROM cov HAVING count(*) > 0""", *PREDS, COVERED))
def coverage_gate(spark, d):
    out = statistics.coverage_gate(statistics.expanding_coverage(floors(spark, d), "y_true", "market"))
    return out.select("fold", "n", F.round("coverage", 6).alias("coverage"), "ok")


def tested(spark, d):
    lab = labelled(spark, d)
    grid = folds.date_grid(lab)
    return folds.test_rows(lab.filter("target is not null"), grid, folds.fold_table(grid, FOLDS, MIN_TRAIN, HORIZON, EMBARGO)).withColumnRenamed("target", "y_true")


def average_ranks(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2"


IC = "covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)"


@query(sql_of(f"""SELECT count(*) AS n, round(count(*) / 30, 4) AS n_eff, round((SELECT CASE WHEN count(ic) >= 3 THEN avg(ic) END FROM fic), 5) AS ic, round(avg(abs(roc / 100 - y_true)), 6) AS mae, round(sqrt(avg((roc / 100 - y_true) ** 2)), 6) AS rmse,
 round(greatest(avg((y_true > 0)::INT), 1 - avg((y_true > 0)::INT)) * 100, 4) AS naive_hit FROM te WHERE roc IS NOT NULL""", *PREDS,
              f"fic AS (SELECT fold, {IC} AS ic FROM (SELECT fold, {average_ranks('y_true', 'fold')} AS a, {average_ranks('roc', 'fold')} AS b FROM te WHERE roc IS NOT NULL) GROUP BY fold)"))
def metric_block(spark, d):
    m = statistics.metric_block(tested(spark, d).filter("roc is not null").withColumn("pred", F.col("roc") / 100), "y_true", "pred", HORIZON)
    return m.select("n", F.round("n_eff", 4).alias("n_eff"), F.round("ic", 5).alias("ic"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("naive_hit", 4).alias("naive_hit"))


@query(sql_of(f"""SELECT CAST(fold AS INT) AS fold, ticker, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN {IC} END, 5) AS ic FROM (SELECT fold, ticker, {average_ranks('y_true', 'fold, ticker')} AS a, {average_ranks('roc', 'fold, ticker')} AS b FROM te WHERE roc IS NOT NULL) GROUP BY fold, ticker""", *PREDS))
def per_ticker_fold_ics(spark, d):
    return shown(xs.rank_ic(tested(spark, d), "y_true", "roc", ["fold", "ticker"]), "fold ticker n", "ic", 5)


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, ticker, n, round(mode_share, 6) AS mode_share, round(unique_fraction, 6) AS unique_fraction FROM (SELECT fold, ticker, CAST(sum(c) AS BIGINT) AS n, max(c) / sum(c) AS mode_share, count(*) / sum(c) AS unique_fraction FROM
 (SELECT fold, ticker, floor(y_true * 2) AS v, count(*) AS c FROM preds GROUP BY ALL) GROUP BY fold, ticker)""", *PREDS))
def cell_degeneracy(spark, d):
    return shown(statistics.cell_degeneracy(floors(spark, d).withColumn("v", F.floor(F.col("y_true") * 2)), ["fold", "ticker"], "v"), "fold ticker n", "mode_share unique_fraction")


DEMEANED = f"""dem AS (SELECT fold, date, ticker, 2 * (a - 1) / (n - 1) - 1 AS t, 2 * (b - 1) / (n - 1) - 1 AS p FROM (SELECT fold, date, ticker, {average_ranks('y_true', 'date')} AS a, {average_ranks('roc', 'date')} AS b, count(*) OVER (PARTITION BY date) AS n
 FROM te WHERE roc IS NOT NULL) WHERE n >= 20)"""


@query(sql_of(f"SELECT CAST(fold AS INT) AS fold, ticker, {DAY}, round(t, 5) AS t, round(p, 5) AS p, round(p * t / nullif(sqrt(avg(p ** 2) OVER w * avg(t ** 2) OVER w), 0), 5) AS product FROM dem WINDOW w AS (PARTITION BY date)", *PREDS, DEMEANED))
def rank_product_panel(spark, d):
    dealt = tables.deal(tested(spark, d).filter("roc is not null"), tables.tasks(spark, d), "date")
    thick = dealt.withColumn("n", F.count("*").over(Window.partitionBy("date"))).filter("n >= 20")
    ranked = xs.unit_rank(xs.unit_rank(thick, "y_true", "t"), "roc", "p")
    return shown(statistics.rank_product(ranked, "t", "p"), "fold ticker date", "t p product", 5)


FEATURES = ("roc", "ret_1", "ret_5")
FEATS = f"feats AS (SELECT ticker, date, target, roc, close / lag(close) OVER {W} - 1 AS ret_1, close / lag(close, 5) OVER {W} - 1 AS ret_5 FROM lab)"
FEATURE_ICS = "fics AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, date, {IC} AS ic FROM (SELECT date, {average_ranks('target', 'date')} AS a, {average_ranks(c, 'date')} AS b FROM feats WHERE target IS NOT NULL AND {c} IS NOT NULL) GROUP BY date HAVING count(*) >= 20" for c in FEATURES) + ")"


def feature_ics_of(spark, d):
    long = windows.lag_returns(labelled(spark, d)).unpivot(["ticker", "date", "target"], list(FEATURES), "feature", "value")
    return xs.rank_ic(long, "target", "value", ["feature", "date"], 20).filter("ic is not null")


@query(sql_of("SELECT feature, count(ic) AS dates, round(avg(ic), 5) AS mean_ic FROM fics WHERE ic IS NOT NULL GROUP BY feature", LAB, FEATS, FEATURE_ICS))
def feature_ics(spark, d):
    return shown(feature_ics_of(spark, d).groupBy("feature").agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean_ic")), "feature dates", "mean_ic", 5)


_LAGS = range(1, 31)
_WEIGHTS = " + ".join(f"2 * (1 - {k} / 31.0) * coalesce(sum(e * l{k}), 0)" for k in _LAGS)


@query(sql_of(f"""SELECT count(*) AS n, round(avg(x), 5) AS mean, round(sqrt(greatest(0, sum(e * e) + {_WEIGHTS})) / count(*), 5) AS se FROM (SELECT *, {", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in _LAGS)} FROM
 (SELECT date, x, x - avg(x) OVER () AS e FROM (SELECT a.date, b.ic - a.ic AS x FROM fics a JOIN fics b ON a.date = b.date AND a.feature = 'ret_1' AND b.feature = 'ret_5' WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL)))""", LAB, FEATS, FEATURE_ICS))
def paired_ic_test(spark, d):
    wide = feature_ics_of(spark, d).groupBy("date").agg(F.max(F.when(F.col("feature") == "ret_5", F.col("ic"))).alias("b"), F.max(F.when(F.col("feature") == "ret_1", F.col("ic"))).alias("a"))
    return shown(statistics.driscoll_kraay(wide.withColumn("x", F.col("b") - F.col("a")), "x", 30), "n", "mean se", 5)


@query(sql_of(f"""SELECT {DAY}, n, round(CASE WHEN n <= k THEN 1.0 WHEN level > k - above THEN (k - above) / k ELSE 0 END, 6) AS top_arbitrary FROM (SELECT date, n, k, count(*) FILTER (v > cut) AS above, count(*) FILTER (v = cut) AS level FROM
 (SELECT *, min(CASE WHEN r <= k THEN v END) OVER (PARTITION BY date) AS cut FROM (SELECT date, floor(roc / 20) AS v, count(*) OVER (PARTITION BY date) AS n, greatest(2, count(*) OVER (PARTITION BY date) // 5) AS k,
 row_number() OVER (PARTITION BY date ORDER BY floor(roc / 20) DESC) AS r FROM lab WHERE roc IS NOT NULL)) GROUP BY date, n, k)""", LAB))
def tie_decided_legs(spark, d):
    return shown(portfolio.tie_decided(labelled(spark, d).withColumn("v", F.floor(F.col("roc") / 20)), "v"), "date n", "top_arbitrary")


@query(sql_of(f"""SELECT {DAY}, round(hedge, 5) AS hedge, round(gross - hedge * m, 5) AS gross, round(turnover + abs(hedge - coalesce(lag(hedge) OVER (ORDER BY date), 0)) / 2, 5) AS turnover FROM path
 JOIN (SELECT date, avg(coalesce(beta, 1)) AS hedge FROM book LEFT JOIN (SELECT date, ticker, beta_market / nullif(market, 0) AS beta FROM preds) USING (date, ticker) WHERE leg = 'top' GROUP BY date) USING (date)
 JOIN (SELECT date, avg(y_true) AS m FROM preds GROUP BY date) USING (date)""", *PREDS, *BOOK))
def hedged_book(spark, d):
    p = floors(spark, d).withColumn("y_pred", F.col("beta_market"))
    market = p.groupBy("date").agg(F.avg("y_true").alias("market_return"))
    beta = p.select("date", "ticker", (F.col("beta_market") / F.nullif(F.col("market"), F.lit(0.0))).alias("beta"))
    return shown(portfolio.simulate_hedged(portfolio.rebalance_books(p), beta, market), "date", "hedge gross turnover", 5)
