"""Registered queries of the study operators: calendars, comparators, leakage, placebos, gates and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import comparators, folds, joins, placebos, quality, sessions, windows
from tidepool.operators import crosssection as xs
from tidepool.plans.catalog import DAY, EMBARGO, FOLDS, GRID, HORIZON, LAB, MIN_TRAIN, PREDS, RET, W, labelled, query, ridge_sql, rows, shown, sql_of, training
from tidepool.plans.extra import IC, average_ranks, tested
from tidepool.operators.pooling import written
from tidepool.sources import tables

# calendars ---------------------------------------------------------------------------------------------------------

_DAYS = "days AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '1992-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d))"
_CLOSED = "isodow(date) < 6 AND day(date) = 15"
_SPECIAL = "isodow(date) = 6 AND day(date) < 8"
_OPEN = f"CASE WHEN isodow(date) < 6 THEN NOT ({_CLOSED}) ELSE {_SPECIAL} END"


def _raw_calendar(spark):
    """The JSON file of a calendar: closed on the 15th, open on the first Saturday of a month."""
    days = spark.sql("select explode(sequence(date'1992-01-01', date'2001-12-31')) as date")
    dow = F.weekday("date")
    closed, special = (dow < 5) & (F.day("date") == 15), (dow == 5) & (F.day("date") < 8)
    text = lambda c: F.array_sort(F.collect_list(F.when(c, F.date_format("date", "yyyy-MM-dd"))))
    named = lambda c: F.map_from_arrays(text(c), F.transform(text(c), lambda x: F.lit("listed")))
    return days.agg(F.to_json(F.struct(named(closed).alias("closed_weekdays"), named(special).alias("weekend_sessions"), F.array(*[F.lit(y) for y in range(1992, 2002)]).alias("years"))).alias("raw"))


def _calendar(spark):
    return sessions.decode(_raw_calendar(spark))


@query(sql_of(f"""SELECT kind, CAST(date AS VARCHAR) AS date, (SELECT count(*) FROM bars b WHERE b.date = k.date) AS bars FROM (SELECT 'closed' AS kind, date FROM days WHERE {_CLOSED} UNION ALL SELECT 'special', date FROM days WHERE {_SPECIAL}
 UNION ALL SELECT 'year', date FROM days WHERE month(date) = 1 AND day(date) = 1) k""", _DAYS))
def calendar_decode(spark, d):
    """The calendar's days and the bars on each: those on closed days are what a session filter would drop."""
    n = tables.bars(spark, d).groupBy("date").agg(F.count("*").alias("bars"))
    return shown(_calendar(spark).join(n, "date", "left").withColumn("bars", F.coalesce("bars", F.lit(0)).cast("long")), "kind date bars", "")


@query(sql_of(f"SELECT ticker, {DAY}, {_OPEN} AS is_session FROM bars"))
def session_predicate(spark, d):
    return shown(sessions.with_session(tables.bars(spark, d), _calendar(spark)), "ticker date is_session", "")


@query(sql_of(f"SELECT ticker, {DAY}, close FROM bars WHERE {_OPEN}"))
def session_filter(spark, d):
    return shown(sessions.drop_non_sessions(tables.bars(spark, d), _calendar(spark))[0], "ticker date", "close", None)


@query(sql_of(f"SELECT DISTINCT {DAY} FROM bars WHERE NOT ({_OPEN})"))
def session_dropped_dates(spark, d):
    return shown(sessions.drop_non_sessions(tables.bars(spark, d), _calendar(spark))[1], "date", "")


@query("SELECT CAST(year(ts) AS INT) AS year FROM events WHERE year(ts) NOT BETWEEN 1992 AND 2001 GROUP BY 1")
def uncovered_years(spark, d):
    return sessions.uncovered(tables.articles(spark, d), _calendar(spark))


@query(f"""WITH {_DAYS}, ev AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error' AND isodow(CAST(ts AS DATE)) < 6 AND year(ts) = 2024 AND CAST(ts AS DATE) > DATE '2024-01-10')
SELECT 'closed' AS kind, CAST(date AS VARCHAR) AS date FROM days WHERE {_CLOSED} UNION ALL SELECT 'special', CAST(date AS VARCHAR) FROM days WHERE {_SPECIAL}
 UNION ALL SELECT 'year', CAST(date AS VARCHAR) FROM days WHERE month(date) = 1 AND day(date) = 1 UNION ALL SELECT 'year', '2024-01-01' UNION ALL SELECT 'closed', CAST(date AS VARCHAR) FROM ev""")
def calendar_live_merge(spark, d):
    listed = tables.table(spark, d, "events").filter("event_type = 'error'").select(F.to_date("ts").alias("date")).distinct()
    return shown(sessions.merge_live(_calendar(spark), listed, F.lit("2024-01-10").cast("date"), 2024), "kind date", "")


# folds and leakage -------------------------------------------------------------------------------------------------


@query("SELECT p_size AS horizon, CAST(greatest(p_size, 63) AS INT) AS purge, count(*) AS n FROM (SELECT CAST(p_size * 3 AS INT) AS p_size FROM part) GROUP BY p_size")
def horizon_purge(spark, d):
    """The gap of every horizon that the parts name."""
    h = tables.table(spark, d, "part").select((F.col("p_size") * 3).cast("int").alias("horizon"))
    return h.groupBy("horizon").agg(F.count("*").alias("n")).withColumn("purge", comparators.purge_for(F.col("horizon")))


@query(sql_of("""SELECT ticker, CAST(f AS INT) AS fold, CAST(test_start - 60 AS INT) AS train_end, CAST(test_start AS INT) AS test_start, CAST(test_start + step AS INT) AS test_end FROM
 (SELECT ticker, f, step, 100 + f * step AS test_start FROM (SELECT ticker, (count(*) - 100) // 5 AS step FROM bars GROUP BY ticker), range(5) t(f) WHERE step > 0) WHERE test_start - 60 >= 50"""))
def series_folds(spark, d):
    out = comparators.series_folds(tables.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n")), "ticker")
    return out.select("ticker", *[F.col(c).cast("int").alias(c) for c in ("fold", "train_end", "test_start", "test_end")])


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, CAST(max(train_pos) AS INT) AS last_train, CAST(min(test_pos) AS INT) AS first_test, max(train_pos) + 30 < min(test_pos) AS ok FROM (SELECT fold, CASE WHEN pos < train_end THEN pos END AS train_pos,
 CASE WHEN pos >= test_start AND pos < test_end THEN pos END AS test_pos FROM lab JOIN grid USING (date), fold WHERE target IS NOT NULL) GROUP BY fold HAVING max(train_pos) IS NOT NULL AND min(test_pos) IS NOT NULL""", LAB, *GRID))
def leakage_check(spark, d):
    out = comparators.leakage(training(spark, d), tested(spark, d), HORIZON)
    return out.select(*[F.col(c).cast("int").alias(c) for c in ("fold", "last_train", "first_test")], "ok")


_SERIES = f"""sf AS (SELECT ticker, fold, test_start - 60 AS train_end, test_start, test_start + step AS test_end FROM (SELECT ticker, f AS fold, step, 100 + f * step AS test_start FROM (SELECT ticker, (count(*) - 100) // 5 AS step FROM bars GROUP BY ticker), range(5) t(f) WHERE step > 0) WHERE test_start - 60 >= 50),
 ps AS (SELECT ticker, date, target, row_number() OVER {W} - 1 AS pos FROM lab)"""


@query(sql_of("""SELECT t.ticker, CAST(t.fold AS INT) AS fold, count(*) AS n, round(avg(abs(target - m)), 6) AS mae FROM (SELECT ticker, fold, target FROM ps JOIN sf USING (ticker) WHERE pos >= test_start AND pos < test_end AND target IS NOT NULL) t
 JOIN (SELECT ticker, fold, avg(target) AS m FROM ps JOIN sf USING (ticker) WHERE pos < train_end AND target IS NOT NULL GROUP BY ticker, fold HAVING count(*) >= 20) m ON t.ticker = m.ticker AND t.fold = m.fold GROUP BY t.ticker, t.fold""", LAB, _SERIES))
def series_walk_forward(spark, d):
    """The mean of each series' own training labels, tested fold by fold."""
    lab = labelled(spark, d).withColumn("pos", F.row_number().over(windows.by_ticker()) - 1)
    table = comparators.series_folds(lab.groupBy("ticker").agg(F.count("*").alias("n")), "ticker")
    some = lab.filter("target is not null").join(table, "ticker")
    mean = some.filter("pos < train_end").groupBy("ticker", "fold").agg(F.avg("target").alias("m"), F.count("*").alias("k")).filter("k >= 20").drop("k")
    out = some.filter("pos >= test_start and pos < test_end").join(mean, ["ticker", "fold"]).groupBy("ticker", "fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("target") - F.col("m"))).alias("mae"))
    return shown(out, "ticker fold n", "mae")


# comparators -------------------------------------------------------------------------------------------------------

_CONST = """cst AS (SELECT fold, avg(target) AS train_mean, CASE WHEN avg((target > 0)::INT) >= 0.5 THEN 1.0 ELSE -1.0 END AS majority FROM tr GROUP BY fold)"""
_CM = """cm AS (SELECT fold, comparator, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(((y_pred > 0) = (y_true > 0))::INT) * 100 AS hit_rate
 FROM (SELECT fold, y_true, unnest(['zero', 'train_mean', 'majority', 'always_up']) AS comparator, unnest([0.0, train_mean, majority, 1.0]) AS y_pred FROM te JOIN cst USING (fold)) GROUP BY fold, comparator)"""


def _constant_metrics(spark, d):
    test = tested(spark, d).select("fold", "date", "ticker", "y_true")
    return folds.fold_metrics(comparators.constant_predictions(training(spark, d), test), ["zero", "train_mean", "majority", "always_up"])


@query(sql_of("SELECT CAST(fold AS INT) AS fold, comparator, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(hit_rate, 4) AS hit_rate FROM cm", *PREDS, _CONST, _CM))
def constant_comparators(spark, d):
    m = _constant_metrics(spark, d)
    return m.select("fold", "comparator", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("hit_rate", 4).alias("hit_rate"))


@query(sql_of("SELECT comparator, count(*) AS folds, round(avg(mae), 6) AS mae, round(avg(hit_rate), 4) AS hit_rate FROM cm GROUP BY comparator", *PREDS, _CONST, _CM))
def comparison_table(spark, d):
    t = comparators.comparison(_constant_metrics(spark, d))
    return t.select("comparator", "folds", F.round("mae", 6).alias("mae"), F.round("hit_rate", 4).alias("hit_rate"))


@query(sql_of("SELECT comparator AS best, round(v, 4) AS value FROM (SELECT comparator, avg(hit_rate) AS v FROM cm GROUP BY comparator) ORDER BY v DESC, comparator LIMIT 1", *PREDS, _CONST, _CM))
def best_comparator(spark, d):
    return comparators.best(comparators.comparison(_constant_metrics(spark, d)), "hit_rate").select("best", F.round("value", 4).alias("value"))


@query(sql_of(f"SELECT ticker, {DAY}, 0.0 AS zero, CASE WHEN avg((target > 0)::INT) OVER (PARTITION BY ticker) >= 0.5 THEN 1.0 ELSE -1.0 END AS majority, round(coalesce(roc, 0) / 100, 6) AS momentum FROM lab WHERE target IS NOT NULL", LAB).replace("0.0 AS zero", "CAST(0 AS DOUBLE) AS zero"))
def baseline_arrays(spark, d):
    some = labelled(spark, d).filter("target is not null")
    up = F.avg((F.col("target") > 0).cast("double")).over(Window.partitionBy("ticker"))
    return shown(some.withColumns({"zero": F.lit(0.0), "majority": F.when(up >= 0.5, 1.0).otherwise(-1.0), "momentum": F.coalesce("roc", F.lit(0.0)) / 100}), "ticker date", "zero majority momentum")


_BS = f"""rb AS (SELECT ticker, date, r, CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY date) END AS m FROM ret), bt AS (SELECT ticker, date, CASE WHEN count(r) OVER w >= 60 THEN covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0) END AS beta FROM rb WINDOW w AS {rows(252)}),
 mk AS (SELECT date, CASE WHEN count(market) OVER a >= 20 THEN stddev_samp(market) OVER a END * sqrt(252) AS vol, cum - max(cum) OVER (ORDER BY date ROWS 251 PRECEDING) AS drawdown FROM (SELECT date, market, sum(coalesce(market, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT date, avg(r) AS market FROM ret GROUP BY date)) WINDOW a AS (ORDER BY date ROWS 19 PRECEDING)),
 ix AS (SELECT ticker, date, beta * vol AS beta_vol, beta * drawdown AS beta_drawdown FROM bt LEFT JOIN mk USING (date))"""


def interactions(spark, d):
    """ticker, date, beta_vol and beta_drawdown: the rolling beta times the state of the market on the date."""
    b = tables.bars(spark, d)
    state = windows.market_state(b).select("date", "vol", "drawdown")
    beta = windows.rolling_beta(b, 252, 60).select("ticker", "date", "beta")
    return beta.join(state, "date", "left").select("ticker", "date", (F.col("beta") * F.col("vol")).alias("beta_vol"), (F.col("beta") * F.col("drawdown")).alias("beta_drawdown"))


@query(sql_of(f"SELECT ticker, {DAY}, round(beta_vol, 5) AS beta_vol, round(beta_drawdown, 5) AS beta_drawdown FROM ix", RET, _BS))
def beta_state_interactions(spark, d):
    return shown(interactions(spark, d), "ticker date", "beta_vol beta_drawdown", 5)


@query(sql_of(ridge_sql("beta_vol", "beta_drawdown", "(SELECT tr.*, beta_vol, beta_drawdown FROM tr LEFT JOIN ix USING (ticker, date))"), *PREDS, RET, _BS))
def regime_ridge(spark, d):
    train = training(spark, d).join(interactions(spark, d), ["ticker", "date"], "left")
    return shown(comparators.ridge_of_two(train, "beta_vol", "beta_drawdown"), "fold", "intercept w1 w2", 5)


_NEWS = "news AS (SELECT l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS n_articles, avg(l_discount) AS mean_score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _news(spark, d):
    """Counts and mean scores of a ticker's day, from the orders behind its line items."""
    j = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_articles"), F.avg("l_discount").alias("mean_score"))


@query(sql_of(f"SELECT ticker, {DAY}, n_articles, round(mean_score, 5) AS mean_score FROM bars LEFT JOIN news USING (ticker, date)", _NEWS))
def news_attach(spark, d):
    """No news is null, never fewer rows."""
    return shown(tables.bars(spark, d).join(_news(spark, d), ["ticker", "date"], "left"), "ticker date n_articles", "mean_score", 5)


@query(sql_of(ridge_sql("n_articles", "mean_score", "(SELECT tr.*, n_articles, mean_score FROM tr LEFT JOIN news USING (ticker, date))"), *PREDS, _NEWS))
def news_ridge(spark, d):
    train = training(spark, d).join(_news(spark, d), ["ticker", "date"], "left")
    return shown(comparators.ridge_of_two(train, "n_articles", "mean_score"), "fold", "intercept w1 w2", 5)


@query(sql_of("SELECT CAST(fold AS INT) AS fold, count(*) AS n, count(n_articles) AS covered, round(count(n_articles) / count(*), 6) AS coverage FROM te LEFT JOIN news USING (ticker, date) GROUP BY fold", *PREDS, _NEWS))
def news_coverage_by_fold(spark, d):
    out = tested(spark, d).join(_news(spark, d), ["ticker", "date"], "left").groupBy("fold").agg(F.count("*").alias("n"), F.count("n_articles").alias("covered"))
    return out.select("fold", "n", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("coverage"))


# frames ------------------------------------------------------------------------------------------------------------


_NATIONS = 25  # of the nation table, a fixed number


@query(sql_of(f"SELECT {DAY}, " + ", ".join(f"CAST(count(*) FILTER (s_nationkey = {i}) AS BIGINT) AS n{i}, max(coalesce(adj_close, close)) FILTER (s_nationkey = {i}) AS p{i}" for i in range(_NATIONS)) + " FROM bars JOIN supplier ON s_suppkey = ticker GROUP BY date"))
def price_matrix(spark, d):
    """Long to wide over the sectors, which are few and fixed; a matrix of names stays long."""
    b = tables.bars(spark, d).join(tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").cast("int").alias("k")), "ticker")
    wide = b.groupBy("date").pivot("k", list(range(_NATIONS))).agg(F.count("ticker").alias("n"), F.max(F.coalesce("adj_close", "close")).alias("p"))
    return wide.select(F.col("date").cast("string").alias("date"), *[c for i in range(_NATIONS) for c in (F.coalesce(f"{i}_n", F.lit(0)).cast("long").alias(f"n{i}"), F.col(f"{i}_p").alias(f"p{i}"))])


@query(sql_of(f"SELECT ticker, {DAY}, f AS field, v AS value FROM (SELECT ticker, date, unnest(['open', 'close', 'roc']) AS f, unnest([open, close, roc]) AS v FROM lab)", LAB))
def wide_to_long(spark, d):
    """Nulls keep their rows."""
    some = labelled(spark, d).select("ticker", "date", *[F.col(c).cast("double") for c in ("open", "close", "roc")])
    return shown(some.unpivot(["ticker", "date"], ["open", "close", "roc"], "field", "value"), "ticker date field", "value", None)


@query(sql_of(f"SELECT ticker, {DAY}, coalesce(adj_close, close) AS basis, round(coalesce(adj_close, close) / nullif(first_value(coalesce(adj_close, close)) OVER {W}, 0), 5) AS relative FROM bars"))
def price_frame(spark, d):
    b = tables.bars(spark, d).withColumn("basis", F.coalesce("adj_close", "close"))
    first = F.first("basis").over(windows.by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    out = b.withColumn("relative", F.col("basis") / F.nullif(first, F.lit(0.0)))
    return out.select("ticker", F.col("date").cast("string").alias("date"), "basis", F.round("relative", 5).alias("relative"))


@query(sql_of(f"SELECT ticker, {DAY}, open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 60 AS usable FROM bars"))
def usable_candles(spark, d):
    b = tables.bars(spark, d)
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) > 0) for c in ("open", "high", "low", "close")]
    return shown(b.withColumn("usable", ok[0] & ok[1] & ok[2] & ok[3] & F.col("volume").isNotNull() & (F.col("volume") > 60)), "ticker date usable", "")


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS level, 'INDEX' AS benchmark FROM orders GROUP BY 1")
def index_benchmark(spark, d):
    m = tables.macro(spark, d)
    return m.select(F.col("date").cast("string").alias("date"), "level", F.lit("INDEX").alias("benchmark"))


@query(sql_of(f"""SELECT {DAY}, round(vol, 5) AS vol, round((SELECT avg((o.vol <= mk.vol)::INT) FROM mk o WHERE o.date <= mk.date AND o.vol IS NOT NULL), 5) AS percentile FROM mk WHERE vol IS NOT NULL""", RET, _BS))
def regime_percentile(spark, d):
    """Share of the history up to a date at or below its value."""
    s = windows.market_state(tables.bars(spark, d)).filter("vol is not null").select("date", "vol")
    past = s.select(F.col("date").alias("_d"), F.col("vol").alias("_v"))  # one row a date
    out = s.join(past, F.col("_d") <= F.col("date")).groupBy("date", "vol").agg(F.avg((F.col("_v") <= F.col("vol")).cast("double")).alias("percentile"))
    return shown(out, "date", "vol percentile", 5)


@query(sql_of(f"SELECT ticker, {DAY}, round(CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END, 6) AS spread FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)", RET))
def spread_frame(spark, d):
    r = windows.rolling_beta(tables.bars(spark, d))
    w = windows.by_ticker().rowsBetween(-21, -1)
    return shown(r.withColumn("spread", F.when(F.count("r").over(w) >= 21, F.stddev_samp("r").over(w))), "ticker date", "spread")


@query(sql_of("SELECT count(target) AS n, round(stddev_samp(target), 6) AS sd, round(avg(abs(target)), 6) AS mean_abs FROM lab", LAB))
def label_range(spark, d):
    return labelled(spark, d).agg(F.count("target").alias("n"), F.round(F.stddev_samp("target"), 6).alias("sd"), F.round(F.avg(F.abs("target")), 6).alias("mean_abs"))


@query(sql_of(f"SELECT {DAY}, count(r) AS names, round(avg((abs(r) < 0.01)::INT), 6) AS still FROM ret WHERE r IS NOT NULL GROUP BY date HAVING avg((abs(r) < 0.01)::INT) >= 0.02", RET))
def phantom_confirm(spark, d):
    r = windows.rolling_beta(tables.bars(spark, d)).filter("r is not null")
    return shown(r.groupBy("date").agg(F.count("r").alias("names"), F.avg((F.abs("r") < 0.01).cast("double")).alias("still")).filter("still >= 0.02"), "date names", "still")


@query(sql_of(f"SELECT ticker, {DAY}, round(lead(ln(close), 30) OVER {W} - ln(close), 6) AS target FROM bars WHERE day(date) <> 15"))
def corrected_labels(spark, d):
    """Labels after the rows of phantom sessions are gone."""
    return shown(windows.forward_label(tables.bars(spark, d).filter(F.day("date") != 15), HORIZON), "ticker date", "target")


@query(sql_of(f"SELECT {DAY}, n, round(m, 6) AS benchmark FROM (SELECT date, count(target) AS n, avg(target) AS m, row_number() OVER (ORDER BY date) - 1 AS k FROM lab WHERE target IS NOT NULL GROUP BY date) WHERE k % 30 = 0", LAB))
def benchmark_per_rebalance(spark, d):
    per = labelled(spark, d).filter("target is not null").groupBy("date").agg(F.count("target").alias("n"), F.avg("target").alias("benchmark"))
    k = F.row_number().over(Window.orderBy("date")) - 1  # one row a date
    return shown(per.withColumn("k", k).filter("k % 30 = 0"), "date n", "benchmark")


@query(sql_of("SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN date_diff('day', e, date) <= 85 THEN eps END, 5) AS eps FROM (SELECT b.ticker, b.date, max(f.effective_date) AS e, arg_max(f.eps, f.effective_date) AS eps FROM bars b LEFT JOIN fd f ON f.ticker = b.ticker AND f.effective_date <= b.date GROUP BY b.ticker, b.date)",
              "fd AS (SELECT l_suppkey AS ticker, make_date(year(l_shipdate), 12, 31) + 60 AS effective_date, sum(l_extendedprice * l_discount) / sum(l_quantity) AS eps FROM lineitem GROUP BY 1, 2)"))
def staleness_bound(spark, d):
    """A carried value expires after 85 days."""
    j = joins.asof_backward(tables.bars(spark, d).select("ticker", "date"), tables.fundamentals(spark, d), by=["ticker"], left_on="date", right_on="effective_date", values=["eps"])
    return shown(j.withColumn("eps", F.when(F.datediff("date", "effective_date") <= 85, F.col("eps"))), "ticker date", "eps", 5)


# placebos ----------------------------------------------------------------------------------------------------------

_U = lambda h, a: f"((('0x' || substr({h}, {a}, 12))::BIGINT + 0.5) / 281474976710656.0)"
_N = lambda h: f"(sqrt(-2 * ln({_U(h, 1)})) * cos(2 * pi() * {_U(h, 13)}))"


@query(sql_of(f"""SELECT CAST(a.fold AS INT) AS fold, a.ticker, CAST(a.date AS VARCHAR) AS date, round(b.y_true, 6) AS y_true, round(b.roc, 4) AS roc FROM
 (SELECT *, row_number() OVER (PARTITION BY fold, date ORDER BY ticker) AS i FROM te) a JOIN (SELECT *, row_number() OVER (PARTITION BY fold, date ORDER BY md5('5|' || fold || '|' || date || '|' || ticker), ticker) AS i FROM te) b
 ON a.fold = b.fold AND a.date = b.date AND a.i = b.i""", *PREDS))
def joint_permutation(spark, d):
    te = tested(spark, d).select("fold", "date", "ticker", "y_true", "roc")
    out = placebos.permute_within(te, ["fold", "date"], "ticker", ["y_true", "roc"], F.lit(5))
    return out.select("fold", "ticker", F.col("date").cast("string").alias("date"), F.round("y_true", 6).alias("y_true"), F.round("roc", 4).alias("roc"))


_SHUFFLED = f"""sh AS (SELECT a.date, a.ticker, a.y_true, b.roc FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ticker) AS i FROM te WHERE roc IS NOT NULL) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5('6|' || date || '|' || ticker), ticker) AS i FROM te WHERE roc IS NOT NULL) b ON a.date = b.date AND a.i = b.i)"""


@query(sql_of(f"SELECT {DAY}, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN {IC} END, 5) AS ic FROM (SELECT date, {average_ranks('y_true', 'date')} AS a, {average_ranks('roc', 'date')} AS b FROM sh) GROUP BY date", *PREDS, _SHUFFLED))
def shuffle_placebo_ic(spark, d):
    """Rank correlation of each date after its predictions changed places."""
    te = tested(spark, d).filter("roc is not null").select("date", "ticker", "y_true", "roc")
    return shown(xs.rank_ic(placebos.permute_within(te, ["date"], "ticker", ["roc"], F.lit(6)), "y_true", "roc", ["date"]), "date n", "ic", 5)


@query(f"SELECT s_suppkey AS ticker, round({_N('h')}, 6) AS level FROM (SELECT s_suppkey, md5('271828|' || s_suppkey) AS h FROM supplier)")
def constant_placebo(spark, d):
    return shown(placebos.constant_levels(tables.sectors(spark, d), "ticker", 271828), "ticker", "level")


_PLANTED = f"""pl AS (SELECT date, ticker, y_true, g.ic, g.ic * (y_true - avg(y_true) OVER w) / nullif(stddev_pop(y_true) OVER w, 0) + sqrt(1 - g.ic * g.ic) * {_N("md5('9|' || date || '|' || ticker)")} AS y_pred FROM te, (VALUES (0.02::DOUBLE), (0.1), (0.3)) g(ic) WINDOW w AS (PARTITION BY g.ic, date))"""


@query(sql_of(f"SELECT ticker, {DAY}, round(y_pred, 5) AS y_pred FROM pl WHERE ic = 0.1", *PREDS, _PLANTED))
def synthetic_predictions(spark, d):
    return shown(placebos.planted(tested(spark, d).select("date", "ticker", "y_true"), F.lit(0.1), 9), "ticker date", "y_pred", 5)


@query(sql_of(f"""SELECT round(median(spread / ic), 4) AS spread_per_ic FROM (SELECT ic, avg(s) AS spread FROM (SELECT ic, date, avg(y_true) FILTER (p >= 0.8) - avg(y_true) FILTER (p < 0.2) AS s FROM
 (SELECT ic, date, y_true, (row_number() OVER (PARTITION BY ic, date ORDER BY y_pred, ticker) - 1) / count(*) OVER (PARTITION BY ic, date) AS p FROM pl) GROUP BY ic, date) GROUP BY ic)""", *PREDS, _PLANTED))
def spread_per_ic(spark, d):
    """Median over planted correlations of the spread between outer fifths for each unit of correlation."""
    te = tested(spark, d).select("date", "ticker", "y_true").withColumn("ic", F.explode(F.array(*[F.lit(x) for x in (0.02, 0.1, 0.3)])))
    w = Window.partitionBy("ic", "date")
    z = (F.col("y_true") - F.avg("y_true").over(w)) / F.nullif(F.stddev_pop("y_true").over(w), F.lit(0.0))
    p = te.withColumn("y_pred", F.col("ic") * z + F.sqrt(1 - F.col("ic") * F.col("ic")) * placebos.normal(placebos.draw(F.lit(9), F.col("date"), F.col("ticker"))))
    p = p.withColumn("p", (F.row_number().over(w.orderBy("y_pred", "ticker")) - 1) / F.count("*").over(w))
    s = p.groupBy("ic", "date").agg((F.avg(F.when(F.col("p") >= 0.8, F.col("y_true"))) - F.avg(F.when(F.col("p") < 0.2, F.col("y_true")))).alias("s"))
    return s.groupBy("ic").agg((F.avg("s") / F.col("ic")).alias("r")).agg(F.round(F.percentile("r", F.lit(0.5)), 4).alias("spread_per_ic"))


@query(sql_of(f"""SELECT CAST(fold AS INT) AS fold, n_rebalances, names, round(avg(m), 5) AS null_mean, round(stddev_samp(m), 5) AS null_sd, round(quantile_cont(abs(m), 0.95), 5) AS null_p95_abs FROM (SELECT fold, draw, avg(ic) AS m FROM
 (SELECT x.fold, x.draw, x.date, covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0) AS ic FROM dr x JOIN dr y ON x.fold = y.fold AND x.date = y.date AND x.draw = y.draw AND x.i = y.j GROUP BY x.fold, x.draw, x.date) GROUP BY fold, draw)
 JOIN (SELECT fold, count(*) AS n_rebalances, CAST(median(n) AS DOUBLE) AS names FROM (SELECT fold, date, count(*) AS n FROM sc GROUP BY fold, date) GROUP BY fold) USING (fold) GROUP BY fold, n_rebalances, names""", *PREDS,
              "sc AS (SELECT te.* FROM te JOIN (SELECT fold, date FROM (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS k FROM (SELECT DISTINCT fold, date FROM te)) WHERE k % 30 = 0) USING (fold, date))",
              f"""dr AS (SELECT fold, date, draw, r, row_number() OVER (PARTITION BY fold, date, draw ORDER BY ticker) AS i, row_number() OVER (PARTITION BY fold, date, draw ORDER BY md5('3|' || draw || '|' || fold || '|' || date || '|' || ticker), ticker) AS j
              FROM (SELECT fold, date, ticker, {average_ranks('y_true', 'fold, date')} AS r, count(*) OVER (PARTITION BY fold, date) AS n FROM sc), range(1, 21) t(draw) WHERE n >= 10)"""))
def fold_null_band(spark, d):
    return shown(placebos.null_band(tested(spark, d), 20, 30, 10, 3), "fold n_rebalances names", "null_mean null_sd null_p95_abs", 5)


@query(sql_of("""SELECT a.ticker, CAST(a.date AS VARCHAR) AS date, round(b.x, 6) AS surrogate FROM pb a JOIN st ON st.ticker = a.ticker AND st.j = a.i // 30 JOIN pb b ON b.ticker = a.ticker AND b.i = st.start + a.i % 30""", RET,
              f"pb AS MATERIALIZED (SELECT ticker, date, r AS x, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM ret WHERE r IS NOT NULL)",
              "st AS MATERIALIZED (SELECT ticker, j, CAST(('0x' || substr(md5('4|' || ticker || '|' || j), 1, 12))::BIGINT % greatest(n - 30, 1) AS BIGINT) AS start FROM (SELECT DISTINCT ticker, n, i // 30 AS j FROM pb))"))
def block_permutation(spark, d):
    """A surrogate of each name's returns from overlapping blocks of 30, drawn with replacement."""
    r = windows.rolling_beta(tables.bars(spark, d)).filter("r is not null").select("ticker", "date", F.col("r").alias("x"))
    return shown(placebos.block_surrogate(r, "ticker", 30, 4), "ticker date", "surrogate")


# the gate and neutral books ----------------------------------------------------------------------------------------


@query(sql_of("""SELECT ticker, n FROM (SELECT s_suppkey AS ticker, count(roc) AS n FROM supplier LEFT JOIN lab ON ticker = s_suppkey AND ticker % 7 <> 3 GROUP BY 1) WHERE n = 0""", LAB))
def benchmark_coverage(spark, d):
    """Names of the universe without any benchmark value."""
    have = labelled(spark, d).filter("ticker % 7 <> 3").groupBy("ticker").agg(F.count("roc").alias("n"))
    return tables.sectors(spark, d).select("ticker").join(have, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).cast("long").alias("n")).filter("n = 0")


@query(sql_of("SELECT count(*) AS n, round(stddev_samp(target), 6) AS sd, round(quantile_cont(target, 0.01), 6) AS q01, round(quantile_cont(target, 0.99), 6) AS q99, count(*) FILTER (abs(target) > 1.5) AS beyond FROM lab WHERE target IS NOT NULL", LAB))
def target_distribution(spark, d):
    return quality.distribution(labelled(spark, d), "target", 1.5)


@query(sql_of(f"""SELECT "check", n_bad, CASE WHEN n_bad > 0 THEN worst ELSE 'PASS' END AS status FROM (
 SELECT 'duplicate_keys' AS "check", count(*) AS n_bad, 'FAIL' AS worst FROM (SELECT 1 FROM bars GROUP BY ticker, date HAVING count(*) > 1)
 UNION ALL SELECT 'future_dates', count(*) FILTER (date > DATE '1999-01-01'), 'FAIL' FROM bars
 UNION ALL SELECT 'stale', CAST(date_diff('day', max(date), DATE '1999-01-01') > 6 AS INT), 'FAIL' FROM bars
 UNION ALL SELECT 'finite_features', count(*) FILTER (isinf(roc) OR isnan(roc)), 'FAIL' FROM lab
 UNION ALL SELECT 'label_coverage', count(*), 'FAIL' FROM (SELECT s_suppkey, count(target) AS n FROM supplier LEFT JOIN lab ON ticker = s_suppkey GROUP BY 1) WHERE n < 500
 UNION ALL SELECT 'benchmark_coverage', count(*), 'FAIL' FROM (SELECT s_suppkey, count(roc) AS n FROM supplier LEFT JOIN lab ON ticker = s_suppkey GROUP BY 1) WHERE n = 0
 UNION ALL SELECT 'price_breaks', count(*), 'WARN' FROM ret m WHERE abs(r) > 0.35 AND NOT EXISTS (SELECT 1 FROM bars a WHERE a.ticker = m.ticker AND a.volume >= 60 AND abs(date_diff('day', a.date, m.date)) <= 4)
 UNION ALL SELECT 'target_distribution', count(*) FILTER (abs(target) > 1.5), 'WARN' FROM lab
 UNION ALL SELECT 'sessions_contiguous', count(*), 'FAIL' FROM (SELECT ticker FROM bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars)) USING (date) GROUP BY ticker HAVING max(pos) - min(pos) + 1 > count(*))
 UNION ALL SELECT 'flat_days', count(*), 'FAIL' FROM (SELECT 1 FROM bars GROUP BY date HAVING count(*) >= 10 AND avg((open = close AND high = low)::INT) >= 0.9)
 UNION ALL SELECT 'silent_neutrals', count(*), 'WARN' FROM (SELECT ticker FROM lab WHERE roc IS NOT NULL GROUP BY ticker HAVING count(DISTINCT roc) = 1)
 UNION ALL SELECT 'unreadable', 1, 'FAIL')""", RET, LAB))
def gate_driver(spark, d):
    """All eleven checks and one that cannot run, which fails instead of ending the gate."""
    lab, u = written(labelled(spark, d)), tables.sectors(spark, d)  # every check reads the same bars, with their labels
    b = lab.drop("target", "roc", "volume_roc")
    return quality.drive(spark, quality.panel_checks(b, lab, u, b.filter("volume >= 60"), "1999-01-01", 500, tables.tasks(spark, d)) | {"unreadable": lambda: b.select("no_such_column")})


@query(sql_of(f"""SELECT 'failures' AS list, string_agg("check", ',' ORDER BY "check") AS checks FROM g WHERE status = 'FAIL' UNION ALL SELECT 'warnings', string_agg("check", ',' ORDER BY "check") FROM g WHERE status = 'WARN'""",
              """g AS (SELECT 'duplicate_keys' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT 1 FROM bars GROUP BY ticker, date HAVING count(*) > 1)
              UNION ALL SELECT 'stale', CASE WHEN date_diff('day', max(date), DATE '2001-01-01') > 6 THEN 'FAIL' ELSE 'PASS' END FROM bars)"""))
def gate_lists(spark, d):
    b = tables.bars(spark, d)
    return quality.status_lists(quality.drive(spark, {"duplicate_keys": lambda: quality.duplicate_keys(b), "stale": lambda: quality.stale(b, "2001-01-01")}))


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN count(*) OVER w >= 3 AND var_pop(beta) OVER w > 0 THEN roc - avg(roc) OVER w - covar_pop(roc, beta) OVER w / (var_pop(beta) OVER w) * (beta - avg(beta) OVER w) END, 4) AS residual
 FROM (SELECT ticker, date, roc, beta FROM lab JOIN bt USING (ticker, date) WHERE roc IS NOT NULL AND beta IS NOT NULL) WINDOW w AS (PARTITION BY date)""", LAB, RET, _BS))
def rolling_basis_residual(spark, d):
    """A signal without what the rolling beta explains within the date."""
    beta = windows.rolling_beta(tables.bars(spark, d), 252, 60).select("ticker", "date", "beta").filter("beta is not null")
    both = labelled(spark, d).filter("roc is not null").join(beta, ["ticker", "date"])
    return shown(xs.within_date_residual(both, "roc", "beta", "residual"), "ticker date", "residual", 4)
