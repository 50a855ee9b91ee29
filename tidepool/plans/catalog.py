"""Registered queries of the panel operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import recursive, text
from tidepool.operators import crosssection as xs
from tidepool.operators import comparators, folds, joins, portfolio, quality, statistics, windows
from tidepool.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HORIZON, FOLDS, MIN_TRAIN, EMBARGO = 30, 5, 500, 30
TODAY = "1999-01-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def shown(df: DataFrame, keys: str, values: str, digits: int | None = 6) -> DataFrame:
    """Keys as they are (dates as text) and values as doubles, rounded unless ``digits`` is None."""
    kinds = dict(df.dtypes)
    k = [F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in keys.split()]
    x = lambda c: F.col(c).cast("double")
    return df.select(*k, *[(x(c) if digits is None else F.round(x(c), digits)).alias(c) for c in values.split()])


#: Sums of amounts are taken in whole hundredths, so they are exact in any order of the rows.
_CENTS = lambda c: f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE)"
_CLOSE = f"{_CENTS('l_extendedprice')} / {_CENTS('l_quantity')}"
BARS = f"""bars AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, {_CLOSE} AS close,
 ({_CLOSE}) * (1 + {_CENTS('l_tax')} / 100 / count(*) - {_CENTS('l_discount')} / 100 / count(*)) AS adj_close, {_CENTS('l_quantity')} / 100 AS volume FROM lineitem GROUP BY 1, 2)"""
W = "(PARTITION BY ticker ORDER BY date)"
DAY = "CAST(date AS VARCHAR) AS date"


def rows(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def sql_of(body: str, *more: str) -> str:
    return "WITH " + ", ".join([BARS, *more]) + " " + body


@query(sql_of(f"SELECT ticker, {DAY}, open, high, low, close, volume FROM bars"))
def bars_daily(spark, d):
    return shown(tables.bars(spark, d), "ticker date", "open high low close volume", None)


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n = 20 THEN m END, 6) AS sma, round(CASE WHEN n = 20 THEN m + 2 * s END, 6) AS upper, round(CASE WHEN n = 20 THEN m - 2 * s END, 6) AS lower,
 round(CASE WHEN n = 20 THEN 4 * s / m END, 6) AS width FROM (SELECT ticker, date, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM bars WINDOW w AS {rows(20)})"""))
def sma_bollinger(spark, d):
    return shown(windows.bollinger(tables.bars(spark, d)), "ticker date", "sma upper lower width")


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n = 14 THEN 100 * (close - lo) / nullif(hi - lo, 0) END, 6) AS stoch_k, round(CASE WHEN n = 14 THEN -100 * (hi - close) / nullif(hi - lo, 0) END, 6) AS williams_r
 FROM (SELECT *, count(*) OVER w AS n, min(low) OVER w AS lo, max(high) OVER w AS hi FROM bars WINDOW w AS {rows(14)})"""))
def stochastic_williams(spark, d):
    return shown(windows.stochastic(tables.bars(spark, d)), "ticker date", "stoch_k williams_r")


@query(sql_of(f"""SELECT ticker, {DAY}, round(sum(v) OVER {W}, 6) AS obv FROM (SELECT *, CASE WHEN close < lag(close) OVER {W} THEN -volume ELSE volume END AS v FROM bars)"""))
def obv(spark, d):
    return shown(windows.obv(tables.bars(spark, d)), "ticker date", "obv")


@query(sql_of(f"""SELECT ticker, {DAY}, round(100 * (close / lag(close, 10) OVER {W} - 1), 6) AS roc,
 round(CASE WHEN lag(volume, 10) OVER {W} > 0 THEN volume / lag(volume, 10) OVER {W} - 1 ELSE 0 END, 6) AS volume_roc FROM bars"""))
def roc_volume(spark, d):
    return shown(windows.rate_of_change(tables.bars(spark, d)), "ticker date", "roc volume_roc")


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n >= 50 THEN CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END END, 6) AS proximity
 FROM (SELECT *, count(close) OVER w AS n, min(close) OVER w AS lo, max(close) OVER w AS hi FROM bars WINDOW w AS {rows(252)})"""))
def prox_52w(spark, d):
    return shown(windows.proximity(tables.bars(spark, d)), "ticker date", "proximity")


@query(sql_of(f"SELECT ticker, {DAY}, round(close / lag(close, 1) OVER {W} - 1, 6) AS ret_1, round(close / lag(close, 5) OVER {W} - 1, 6) AS ret_5 FROM bars"))
def lag_returns(spark, d):
    return shown(windows.lag_returns(tables.bars(spark, d)), "ticker date", "ret_1 ret_5")


@query(sql_of(f"SELECT ticker, {DAY}, round(CASE WHEN count(close) OVER w = 50 THEN 100 * (close - avg(close) OVER w) / avg(close) OVER w END, 6) AS sma_deviation FROM bars WINDOW w AS {rows(50)}"))
def sma_deviation(spark, d):
    return shown(windows.sma_deviation(tables.bars(spark, d)), "ticker date", "sma_deviation")


_LAGS = range(2, 20)
_DIFFS = ", ".join(f"ln(close) - lag(ln(close), {k}) OVER {W} AS d{k}" for k in _LAGS)
_SDS = ", ".join(f"CASE WHEN count(d{k}) OVER w = 60 THEN stddev_samp(d{k}) OVER w END AS s{k}" for k in _LAGS)
_PAIRS = " UNION ALL ".join(f"SELECT ticker, date, ln({k}) AS x, CASE WHEN s{k} > 0 THEN ln(s{k}) END AS y FROM s" for k in _LAGS)


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN count(y) = 18 THEN greatest(0, least(1, regr_slope(y, x))) END, 4) AS hurst FROM ({_PAIRS}) GROUP BY ticker, date""",
              f"d AS (SELECT ticker, date, {_DIFFS} FROM bars)", f"s AS (SELECT ticker, date, {_SDS} FROM d WINDOW w AS {rows(60)})"))
def hurst_slope(spark, d):
    return shown(windows.hurst(tables.bars(spark, d)), "ticker date", "hurst", 4)


@query(sql_of(f"SELECT ticker, {DAY}, high * (adj_close / close) AS high, low * (adj_close / close) AS low, adj_close AS close FROM bars"))
def adjusted_bars(spark, d):
    return shown(windows.adjust(tables.bars(spark, d)), "ticker date", "high low close", None)


LAB = f"lab AS (SELECT *, lead(ln(close), {HORIZON}) OVER {W} - ln(close) AS target, 100 * (close / lag(close, 10) OVER {W} - 1) AS roc FROM bars)"


def labelled(spark, d) -> DataFrame:
    return windows.forward_label(windows.rate_of_change(tables.bars(spark, d)), HORIZON)


@query(sql_of(f"SELECT ticker, {DAY}, round(target, 6) AS target FROM lab", LAB))
def forward_label(spark, d):
    return shown(labelled(spark, d), "ticker date", "target")


@query(sql_of(f"""SELECT {DAY}, round(market, 6) AS market, round(dispersion, 6) AS dispersion, round(breadth, 6) AS breadth, round(CASE WHEN n20 = 20 THEN s20 * sqrt(252) END, 6) AS vol,
 round(CASE WHEN n20 = 20 AND n60 = 60 THEN s20 / nullif(s60, 0) END, 6) AS vol_ratio, round(cum - max(cum) OVER (ORDER BY date ROWS 251 PRECEDING), 6) AS drawdown FROM m""",
              f"""r AS (SELECT *, ln(close / lag(close) OVER {W}) AS r, CASE WHEN count(close) OVER w = 50 AND close > avg(close) OVER w THEN 1 ELSE 0 END AS above FROM bars WINDOW w AS {rows(50)})""",
              "p AS (SELECT date, avg(r) AS market, stddev_samp(r) AS dispersion, sum(above) / count(close) AS breadth FROM r GROUP BY date)",
              """m AS (SELECT *, sum(coalesce(market, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum, count(market) OVER a AS n20, stddev_samp(market) OVER a AS s20, count(market) OVER b AS n60, stddev_samp(market) OVER b AS s60
              FROM p WINDOW a AS (ORDER BY date ROWS 19 PRECEDING), b AS (ORDER BY date ROWS 59 PRECEDING))"""))
def market_state(spark, d):
    return shown(windows.market_state(tables.bars(spark, d)), "date", "market dispersion breadth vol vol_ratio drawdown")


RET = f"ret AS (SELECT ticker, date, close, ln(close / lag(close) OVER {W}) AS r FROM bars)"


@query(sql_of(f"SELECT ticker, {DAY}, round(CASE WHEN count(r) OVER w >= 60 THEN covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0) END, 5) AS beta FROM b WINDOW w AS {rows(252)}",
              RET, "b AS (SELECT ticker, date, r, CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY date) END AS m FROM ret)"))
def rolling_beta(spark, d):
    return shown(windows.rolling_beta(tables.bars(spark, d)), "ticker date", "beta", 5)


@query(sql_of(f"SELECT ticker, {DAY}, round(CASE WHEN count(r) OVER w = 5 THEN -sum(r) OVER w END, 6) AS reversal FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", RET))
def reversal_features(spark, d):
    return shown(windows.reversal(tables.bars(spark, d)), "ticker date", "reversal")


_RECURSIVE = f"""WITH RECURSIVE {BARS}, n AS (SELECT ticker, date, high, low, close, lag(close) OVER {W} AS before, row_number() OVER {W} AS i FROM bars),
v AS (SELECT *, greatest(close - before, 0) AS gain, greatest(before - close, 0) AS loss, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM n),
e AS (SELECT ticker, date, i, close AS e9, close AS e12, close AS e21, close AS e26, close AS e50, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, tr AS atr, CAST(NULL AS DOUBLE) AS sig FROM v WHERE i = 1
 UNION ALL SELECT x.ticker, x.date, x.i, x.e9, x.e12, x.e21, x.e26, x.e50, x.ag, x.al, x.atr, CASE WHEN x.i < 26 THEN NULL WHEN x.i = 26 THEN x.e12 - x.e26 ELSE x.sig + (x.e12 - x.e26 - x.sig) * 0.2::DOUBLE END FROM (SELECT v.ticker, v.date, v.i, e.sig,
 e.e9 + (v.close - e.e9) * 2 / 10 AS e9, e.e12 + (v.close - e.e12) * 2 / 13 AS e12, e.e21 + (v.close - e.e21) * 2 / 22 AS e21, e.e26 + (v.close - e.e26) * 2 / 27 AS e26, e.e50 + (v.close - e.e50) * 2 / 51 AS e50,
 CASE WHEN e.ag IS NULL THEN v.gain ELSE e.ag + (v.gain - e.ag) / 14 END AS ag, CASE WHEN e.al IS NULL THEN v.loss ELSE e.al + (v.loss - e.al) / 14 END AS al, e.atr + (v.tr - e.atr) / 14 AS atr FROM e JOIN v ON v.ticker = e.ticker AND v.i = e.i + 1) x)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN i >= 9 THEN e9 END, 4) AS ema_9, round(CASE WHEN i >= 21 THEN e21 END, 4) AS ema_21, round(CASE WHEN i >= 50 THEN e50 END, 4) AS ema_50, round(CASE WHEN i >= 34 THEN e12 - e26 - sig END, 4) AS macd_diff,
 round(CASE WHEN i >= 15 THEN CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END, 4) AS rsi_14, round(CASE WHEN i >= 14 THEN atr END, 4) AS atr_14 FROM e"""


@query(_RECURSIVE)
def recursive_indicators(spark, d):
    return shown(recursive.recursive_indicators(tables.bars(spark, d)), "ticker date", " ".join(recursive.INDICATORS), 4)


@query(sql_of(f"""SELECT ticker, {DAY}, round(coalesce(CASE WHEN n >= 10 AND s > 0 THEN greatest(-3, least(3, coalesce((roc - m) / s, 0))) ELSE 0 END, 0), 5) AS z
 FROM (SELECT *, count(roc) OVER w AS n, avg(roc) OVER w AS m, stddev_samp(roc) OVER w AS s FROM lab WINDOW w AS (PARTITION BY date))""", LAB))
def cs_zscore(spark, d):
    return shown(xs.zscore(labelled(spark, d), "roc", "z"), "ticker date", "z", 5)


MOM = "mom AS (SELECT date, CASE WHEN count(target) >= 10 THEN avg(target) END AS mean, CASE WHEN count(target) >= 10 THEN stddev_samp(target) END AS sd, count(target) AS n FROM lab GROUP BY date)"


@query(sql_of(f"SELECT {DAY}, round(mean, 6) AS mean, round(sd, 6) AS sd, CAST(n AS BIGINT) AS n FROM mom", LAB, MOM))
def label_moments(spark, d):
    return shown(xs.moments(labelled(spark, d), "target"), "date n", "mean sd")


@query(sql_of(f"""SELECT {DAY}, round(CASE WHEN count(m1) OVER w >= 20 THEN avg(m1) OVER w END, 6) AS causal_mean, round(CASE WHEN count(s1) OVER w >= 20 THEN avg(s1) OVER w END, 6) AS causal_sd
 FROM (SELECT date, lag(mean, 30) OVER (ORDER BY date) AS m1, lag(sd, 30) OVER (ORDER BY date) AS s1 FROM mom) WINDOW w AS (ORDER BY date ROWS 251 PRECEDING)""", LAB, MOM))
def causal_moments(spark, d):
    return shown(xs.causal_moments(xs.moments(labelled(spark, d), "target")), "date", "causal_mean causal_sd")


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n > 1 THEN 2 * (k - 1) / (n - 1) - 1 ELSE 0 END, 6) AS unit_rank
 FROM (SELECT ticker, date, rank() OVER (PARTITION BY date ORDER BY roc) + (count(*) OVER (PARTITION BY date, roc) - 1) / 2 AS k, count(*) OVER (PARTITION BY date) AS n FROM lab WHERE roc IS NOT NULL)""", LAB))
def unit_ranks(spark, d):
    return shown(xs.unit_rank(labelled(spark, d), "roc", "unit_rank"), "ticker date", "unit_rank")


def ranks(x: str, key: str) -> str:
    return f"rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2"


@query(sql_of(f"""SELECT {DAY}, round(CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END, 5) AS ic, count(*) AS n
 FROM (SELECT date, {ranks('target', 'date')} AS a, {ranks('roc', 'date')} AS b FROM lab WHERE target IS NOT NULL AND roc IS NOT NULL) GROUP BY date""", LAB))
def daily_rank_ic(spark, d):
    return shown(xs.rank_ic(labelled(spark, d), "target", "roc", ["date"]), "date n", "ic", 5)


SECTORS = "sec AS (SELECT s_suppkey AS ticker, s_name AS company, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n1 >= 2 THEN m1 WHEN n2 >= 2 THEN m2 END, 6) AS benchmark, CAST(n1 AS BIGINT) AS peers FROM (SELECT ticker, date,
 count(r) OVER a - (r IS NOT NULL)::INT AS n1, (sum(r) OVER a - coalesce(r, 0)) / nullif(count(r) OVER a - (r IS NOT NULL)::INT, 0) AS m1,
 count(r) OVER b - (r IS NOT NULL)::INT AS n2, (sum(r) OVER b - coalesce(r, 0)) / nullif(count(r) OVER b - (r IS NOT NULL)::INT, 0) AS m2
 FROM ret JOIN sec USING (ticker) WINDOW a AS (PARTITION BY date, sector), b AS (PARTITION BY date))""", RET, SECTORS))
def sector_loo_benchmark(spark, d):
    own = windows.rolling_beta(tables.bars(spark, d)).select("ticker", "date", "r")
    out = xs.loo_sector_return(own, tables.sectors(spark, d)).withColumn("peers", F.col("peers").cast("long"))
    return shown(out, "ticker date peers", "benchmark")


@query(sql_of(f"SELECT ticker, {DAY}, round(coalesce(roc, median(roc) OVER (PARTITION BY date), 0), 5) AS filled FROM lab", LAB))
def median_impute(spark, d):
    return shown(xs.impute_median(labelled(spark, d), "roc", "filled"), "ticker date", "filled", 5)


@query(sql_of(f"""SELECT ticker, {DAY}, round(CASE WHEN n >= 3 AND v > 1e-12 THEN y - my - c / v * (x - mx) END, 5) AS residual FROM (SELECT *, count(y) OVER w AS n, var_pop(x) OVER w AS v, covar_pop(y, x) OVER w AS c, avg(y) OVER w AS my, avg(x) OVER w AS mx
 FROM (SELECT ticker, date, CASE WHEN roc IS NOT NULL THEN target END AS y, CASE WHEN target IS NOT NULL THEN roc END AS x FROM lab) WINDOW w AS (PARTITION BY date))""", LAB))
def beta_neutral_residual(spark, d):
    return shown(xs.within_date_residual(labelled(spark, d), "target", "roc", "residual"), "ticker date", "residual", 5)


FUND = """fund AS (SELECT l_suppkey AS ticker, make_date(year(l_shipdate), 12, 31) AS period_end, sum(l_extendedprice * l_discount) / sum(l_quantity) AS eps, avg(l_extendedprice) AS book FROM lineitem GROUP BY 1, 2)"""


@query(sql_of(f"""SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, CAST(f.effective_date AS VARCHAR) AS effective_date, round(f.eps, 6) AS eps, round(f.book, 4) AS book
 FROM bars b ASOF LEFT JOIN (SELECT *, CAST(period_end + INTERVAL 60 DAY AS DATE) AS effective_date FROM fund) f ON b.ticker = f.ticker AND b.date >= f.effective_date""", FUND))
def asof_fundamentals(spark, d):
    f = tables.fundamentals(spark, d)
    out = joins.asof_backward(tables.bars(spark, d).select("ticker", "date"), f, by=["ticker"], left_on="date", right_on="effective_date", values=["eps", "book"])
    return out.select("ticker", F.col("date").cast("string").alias("date"), F.col("effective_date").cast("string").alias("effective_date"), F.round("eps", 6).alias("eps"), F.round("book", 4).alias("book"))


@query(sql_of(f"""SELECT CAST(g.date AS VARCHAR) AS date, m.level FROM (SELECT DISTINCT date FROM bars) g ASOF LEFT JOIN
 (SELECT CAST(o_orderdate AS DATE) AS date, {_CENTS('o_totalprice')} / 100 / count(*) AS level FROM orders GROUP BY 1) m ON g.date >= m.date"""))
def macro_grid_ffill(spark, d):
    return shown(joins.fill_on_grid(tables.bars(spark, d), tables.macro(spark, d), ["level"]), "date", "level", None)


@query(sql_of("""SELECT event_id, CAST(day AS VARCHAR) AS date, CAST(s.date AS VARCHAR) AS next_session FROM (SELECT event_id, CAST(ts AS DATE) AS day FROM events) e
 ASOF LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE event_id % 7 = 0) s ON e.day < s.date"""))
def next_session(spark, d):
    e = tables.articles(spark, d)
    cal = tables.macro(spark, d).select("date").union(e.filter("article_id % 7 = 0").select("date")).distinct()
    out = joins.next_session(e.select("article_id", "date"), cal)
    return out.select(F.col("article_id").alias("event_id"), F.col("date").cast("string").alias("date"), F.col("next_session").cast("string").alias("next_session"))


MEM = "mem AS (SELECT ticker, min(date) AS effective_from, max(date) AS effective_to FROM bars GROUP BY ticker)"


@query(sql_of("SELECT ticker, CAST(effective_from AS VARCHAR) AS effective_from FROM mem WHERE effective_from <= DATE '1995-06-30' AND effective_to > DATE '1995-06-30'", MEM))
def pit_membership(spark, d):
    return shown(joins.member_on(tables.memberships(tables.bars(spark, d)), F.lit("1995-06-30").cast("date")), "ticker effective_from", "")


@query(sql_of("""SELECT CAST(month AS VARCHAR) AS month, ticker, change FROM (SELECT month, ticker, CASE WHEN before IS NULL OR before < month - INTERVAL 1 MONTH THEN 'joined' END AS j, CASE WHEN after IS NULL OR after > month + INTERVAL 1 MONTH THEN 'left' END AS l FROM (SELECT *, lag(month) OVER (PARTITION BY ticker ORDER BY month) AS before, lead(month) OVER (PARTITION BY ticker ORDER BY month) AS after
 FROM (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS month FROM bars WHERE ticker % 7 <> 2 OR month(date) % 5 <> 0))), unnest([j, l]) u(change) WHERE change IS NOT NULL"""))
def membership_diff(spark, d):
    """Names that join or leave from one month to the next; every seventh is planted to be out in May and October."""
    m = tables.bars(spark, d).filter("ticker % 7 <> 2 or month(date) % 5 <> 0").select("ticker", F.trunc("date", "month").alias("month")).distinct()
    w = Window.partitionBy("ticker").orderBy("month")
    before, after = F.lag("month").over(w), F.lead("month").over(w)
    joined = F.when(before.isNull() | (before < F.add_months("month", -1)), "joined")
    left = F.when(after.isNull() | (after > F.add_months("month", 1)), "left")
    return m.withColumn("c", F.array(joined, left)).select(F.col("month").cast("string").alias("month"), "ticker", F.explode("c").alias("change")).filter("change is not null")


@query(sql_of("""SELECT ticker, round(median(v), 4) AS median_value, count(*) AS n FROM (SELECT ticker, close * volume AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k,
 count(*) OVER (PARTITION BY ticker) AS c FROM bars) WHERE k <= 20 AND c >= 100 GROUP BY ticker HAVING median(v) >= 20000"""))
def liquidity_screen(spark, d):
    w = Window.partitionBy("ticker")
    b = tables.bars(spark, d).withColumns({"v": F.col("close") * F.col("volume"), "k": F.row_number().over(w.orderBy(F.col("date").desc())), "c": F.count("*").over(w)})
    out = b.filter("k <= 20 and c >= 100").groupBy("ticker").agg(F.percentile("v", 0.5).alias("median_value"), F.count("*").alias("n")).filter("median_value >= 20000")
    return shown(out, "ticker n", "median_value", 4)


@query(sql_of("""SELECT count(*) FILTER (b.ticker IS NULL) AS left_only, count(*) FILTER (a.ticker IS NULL) AS right_only, count(*) FILTER (a.ticker IS NOT NULL AND b.ticker IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS equal,
 round(max(abs(a.v - b.v)), 6) AS max_drift FROM (SELECT ticker, date, round(close, 3) AS v FROM bars WHERE volume > 5) a FULL JOIN (SELECT ticker, date, round(adj_close, 3) AS v FROM bars WHERE volume < 60) b ON a.ticker = b.ticker AND a.date = b.date"""))
def panel_compare(spark, d):
    """Values are rounded as binary doubles before they are compared: a decimal rounding parts some values at half a thousandth."""
    b = tables.bars(spark, d)
    thousandths = lambda c: (F.round(F.col(c) * 1000) / 1000).alias("v")
    left = b.filter("volume > 5").select("ticker", "date", thousandths("close"))
    right = b.filter("volume < 60").select("ticker", "date", thousandths("adj_close"))
    return shown(joins.compare(left, right, ["ticker", "date"], "v"), "left_only right_only equal", "max_drift")


@query(sql_of("""SELECT m.ticker, CAST(m.date AS VARCHAR) AS date FROM (SELECT ticker, date FROM ret WHERE abs(r) > 0.5) m WHERE NOT EXISTS
 (SELECT 1 FROM bars a WHERE a.ticker = m.ticker AND a.volume >= 60 AND abs(date_diff('day', a.date, m.date)) <= 4)""", RET))
def unexplained_breaks(spark, d):
    b = tables.bars(spark, d)
    moves = windows.rolling_beta(b).filter("abs(r) > 0.5").select("ticker", "date")
    return shown(joins.without_near(moves, b.filter("volume >= 60"), "ticker", "date", "date", 4), "ticker date", "")


GRID = ("grid AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM lab))",
        f"""fold AS (SELECT f AS fold, {MIN_TRAIN} + f * step AS test_start, {MIN_TRAIN} + f * step - {HORIZON + EMBARGO} AS train_end, {MIN_TRAIN} + (f + 1) * step AS test_end
        FROM (SELECT (count(*) - {MIN_TRAIN}) // {FOLDS} AS step FROM grid), range({FOLDS}) t(f) WHERE step > 0 AND {MIN_TRAIN} + f * step - {HORIZON + EMBARGO} >= {MIN_TRAIN // 2})""")
PREDS = (LAB, *GRID, "tr AS (SELECT fold, ticker, lab.date, target, roc FROM lab JOIN grid USING (date) JOIN fold ON pos < train_end WHERE target IS NOT NULL)",
         "te AS (SELECT fold, ticker, lab.date, target AS y_true, roc FROM lab JOIN grid USING (date) JOIN fold ON pos >= test_start AND pos < test_end WHERE target IS NOT NULL)",
         "mu AS (SELECT fold, avg(m) AS mu FROM (SELECT fold, date, avg(target) AS m FROM tr GROUP BY fold, date) GROUP BY fold)",
         "trm AS (SELECT fold, ticker, target, avg(target) OVER (PARTITION BY fold, date) AS m FROM tr)",
         "be AS (SELECT fold, ticker, coalesce(CASE WHEN count(*) >= 20 THEN covar_pop(target, m) / nullif(var_pop(m), 0) END, 1) AS beta FROM trm GROUP BY fold, ticker)",
         "preds AS (SELECT te.fold, te.date, te.ticker, y_true, mu AS market, coalesce(beta, 1) * mu AS beta_market FROM te JOIN mu USING (fold) LEFT JOIN be USING (fold, ticker))")
METRICS = """metrics AS (SELECT fold, comparator, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(((y_pred > 0) = (y_true > 0))::INT) * 100 AS hit_rate
 FROM (SELECT fold, y_true, 'market' AS comparator, market AS y_pred FROM preds UNION ALL SELECT fold, y_true, 'beta_market', beta_market FROM preds) GROUP BY fold, comparator)"""


def floors(spark, d) -> DataFrame:
    return folds.floor_predictions(labelled(spark, d), FOLDS, MIN_TRAIN, HORIZON, EMBARGO, tasks=tables.tasks(spark, d))


@query(sql_of("SELECT CAST(fold AS INT) AS fold, CAST(train_end AS INT) AS train_end, CAST(test_start AS INT) AS test_start, CAST(test_end AS INT) AS test_end FROM fold", LAB, *GRID))
def purged_folds(spark, d):
    out = folds.fold_table(folds.date_grid(tables.bars(spark, d)), FOLDS, MIN_TRAIN, HORIZON, EMBARGO)
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@query(sql_of("SELECT CAST(fold AS INT) AS fold, comparator, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(hit_rate, 4) AS hit_rate FROM metrics", *PREDS, METRICS))
def beta_market_floor(spark, d):
    m = folds.fold_metrics(floors(spark, d), ["market", "beta_market"])
    return m.select("fold", "comparator", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("hit_rate", 4).alias("hit_rate"))


@query(sql_of("""SELECT CAST(a.fold AS INT) AS fold, a.comparator, round(100 * (1 - a.mae / b.mae), 4) AS mae_vs_market, a.mae < b.mae AS beats_market FROM metrics a JOIN metrics b ON a.fold = b.fold AND b.comparator = 'market'""", *PREDS, METRICS))
def floor_annotation(spark, d):
    m = folds.annotate_floors(folds.fold_metrics(floors(spark, d), ["market", "beta_market"]))
    return m.select("fold", "comparator", F.round("mae_vs_market", 4).alias("mae_vs_market"), "beats_market")


def training(spark, d) -> DataFrame:
    lab = labelled(spark, d)
    grid = folds.date_grid(lab)
    return folds.train_rows(lab.filter("target is not null"), grid, folds.fold_table(grid, FOLDS, MIN_TRAIN, HORIZON, EMBARGO))


@query(sql_of("SELECT CAST(fold AS INT) AS fold, round(regr_slope(target, coalesce(roc, 0)), 7) AS slope, round(regr_intercept(target, coalesce(roc, 0)), 6) AS intercept FROM tr GROUP BY fold", *PREDS))
def single_factor_ols(spark, d):
    out = folds.single_factor(training(spark, d), "roc")
    return out.select("fold", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))


def ridge_sql(a: str, b: str, table: str) -> str:
    """Closed form of a ridge with two columns and a penalty of 1, from centred sums of products."""
    return f"""SELECT CAST(fold AS INT) AS fold, round(my - mp * w1 - mq * w2, 5) AS intercept, round(w1, 5) AS w1, round(w2, 5) AS w2 FROM (SELECT *, ((qq + 1) * py - pq * qy) / ((pp + 1) * (qq + 1) - pq * pq) AS w1, ((pp + 1) * qy - pq * py) / ((pp + 1) * (qq + 1) - pq * pq) AS w2
 FROM (SELECT fold, avg(p) AS mp, avg(q) AS mq, avg(y) AS my, covar_pop(p, p) * count(*) AS pp, covar_pop(q, q) * count(*) AS qq, covar_pop(p, q) * count(*) AS pq, covar_pop(p, y) * count(*) AS py, covar_pop(q, y) * count(*) AS qy
 FROM (SELECT fold, coalesce({a}, 0) AS p, coalesce({b}, 0) AS q, target AS y FROM {table}) GROUP BY fold))"""


@query(sql_of(ridge_sql("roc", "volume_roc", f"(SELECT tr.*, CASE WHEN v10 > 0 THEN volume / v10 - 1 ELSE 0 END AS volume_roc FROM tr JOIN (SELECT ticker, date, volume, lag(volume, 10) OVER {W} AS v10 FROM bars) USING (ticker, date))"), *PREDS))
def ridge_factors(spark, d):
    return shown(comparators.ridge_of_two(training(spark, d), "roc", "volume_roc"), "fold", "intercept w1 w2", 5)


HITS = "hits AS (SELECT ticker, count(*) AS n, avg((target > 0)::INT) AS hit, exp(-2 * count(*) * greatest(avg((target > 0)::INT) - 0.5, 0) ** 2) AS p FROM lab WHERE target IS NOT NULL GROUP BY ticker)"


@query(sql_of("""SELECT ticker, round(p, 6) AS p, k <= coalesce((SELECT max(k) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM hits) WHERE p <= 0.1 * k / m), 0) AS significant
 FROM (SELECT ticker, p, row_number() OVER (ORDER BY p) AS k FROM hits)""", LAB, HITS))
def benjamini_hochberg(spark, d):
    hit = F.avg((F.col("target") > 0).cast("double"))
    p = F.exp(-2 * F.count("*") * F.greatest(hit - 0.5, F.lit(0.0)) ** 2)  # Hoeffding's bound on the chance of as many hits
    per = labelled(spark, d).filter("target is not null").groupBy("ticker").agg(p.alias("p"))
    return statistics.benjamini_hochberg(per, "p").select("ticker", F.round("p", 6).alias("p"), "significant")


@query(sql_of("""SELECT k, round(wx / w, 6) AS mean, round(wxx - wx * wx / w, 4) AS q, round(greatest(0, (wxx - wx * wx / w - (k - 1)) / (w - w2 / w)), 6) AS tau2
 FROM (SELECT count(*) AS k, sum(1 / v) AS w, sum(1 / (v * v)) AS w2, sum(x / v) AS wx, sum(x * x / v) AS wxx FROM (SELECT avg(target) AS x, var_samp(target) / count(target) AS v FROM lab WHERE target IS NOT NULL GROUP BY ticker) WHERE v > 0)""", LAB))
def dersimonian_laird(spark, d):
    per = labelled(spark, d).filter("target is not null").groupBy("ticker").agg(F.avg("target").alias("x"), (F.var_samp("target") / F.count("target")).alias("v")).filter("v > 0")
    s = statistics.dersimonian_laird(per, "x", "v")
    return s.select("k", F.round("mean", 6).alias("mean"), F.round("q", 4).alias("q"), F.round("tau2", 6).alias("tau2"))


_BARTLETT = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum(e * l{k}), 0)" for k in range(1, 6))
_SHIFTS = ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 6))


@query(sql_of(f"SELECT count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(0, sum(e * e) + {_BARTLETT})) / count(*), 6) AS se FROM (SELECT *, {_SHIFTS} FROM (SELECT date, x, x - avg(x) OVER () AS e FROM (SELECT date, avg(target) AS x FROM lab WHERE target IS NOT NULL GROUP BY date)))", LAB))
def driscoll_kraay(spark, d):
    per = labelled(spark, d).filter("target is not null").groupBy("date").agg(F.avg("target").alias("x"))
    return shown(statistics.driscoll_kraay(per, "x", 5), "n", "mean se")


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, n, round(r, 6) AS q FROM (SELECT fold, abs(y_true - market) AS r, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY abs(y_true - market)) AS i FROM preds)
 WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))""", *PREDS))
def conformal_quantile(spark, d):
    return shown(statistics.conformal_quantile(floors(spark, d), ["fold"], "y_true", "market"), "fold n", "q")


@query(sql_of("""SELECT CAST(a.fold AS INT) AS fold, count(*) AS n, round(avg((abs(a.y_true - a.market) <= q)::INT), 6) AS coverage FROM preds a JOIN (SELECT f, r AS q FROM
 (SELECT g.fold AS f, abs(y_true - market) AS r, count(*) OVER (PARTITION BY g.fold) AS n, row_number() OVER (PARTITION BY g.fold ORDER BY abs(y_true - market)) AS i FROM preds p JOIN (SELECT DISTINCT fold FROM preds) g ON p.fold < g.fold)
 WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))) ON f = a.fold GROUP BY a.fold""", *PREDS))
def expanding_coverage(spark, d):
    return shown(statistics.expanding_coverage(floors(spark, d), "y_true", "market"), "fold n", "coverage")


PROB = "prob AS (SELECT target, round(1 / (1 + exp(-roc / 10)), 6) AS p FROM lab WHERE target IS NOT NULL AND roc IS NOT NULL)"


def probabilities(spark, d) -> DataFrame:
    return labelled(spark, d).filter("target is not null and roc is not null").select("target", F.round(1 / (1 + F.exp(-F.col("roc") / 10)), 6).alias("p"))


@query(sql_of("SELECT count(*) AS n, round(avg((p - (target > 0)::INT) ** 2), 6) AS brier FROM prob", LAB, PROB))
def brier(spark, d):
    return shown(statistics.brier(probabilities(spark, d), "target", "p"), "n", "brier")


@query(sql_of("SELECT CAST(greatest(ceil(p * 10), 1) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg((target > 0)::INT), 6) AS up_share FROM prob GROUP BY 1", LAB, PROB))
def reliability_curve(spark, d):
    return shown(statistics.reliability(probabilities(spark, d), "target", "p"), "bin n", "mean_p up_share")


BOOK = ("days AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM preds)) WHERE k % 30 = 0)",
        """rk AS (SELECT date, ticker, y_true, count(*) OVER w AS n, max(beta_market) OVER w - min(beta_market) OVER w AS spread, row_number() OVER (PARTITION BY date ORDER BY beta_market DESC, md5(CAST(ticker AS VARCHAR))) AS down,
        row_number() OVER (PARTITION BY date ORDER BY beta_market, md5(CAST(ticker AS VARCHAR)) DESC) AS up FROM preds JOIN days USING (date) WINDOW w AS (PARTITION BY date))""",
        """book AS (SELECT date, ticker, y_true, CASE WHEN down <= greatest(2, n // 5) THEN 'top' ELSE 'bottom' END AS leg FROM rk WHERE n >= 10 AND spread > 0 AND (down <= greatest(2, n // 5) OR up <= greatest(2, n // 5)))""",
        "held AS (SELECT date, avg(y_true) AS gross, list_sort(list(DISTINCT ticker)) AS now FROM book WHERE leg = 'top' GROUP BY date)",
        """turn AS (SELECT *, (len(list_filter(now, lambda x: NOT list_contains(old, x))) + len(list_filter(old, lambda x: NOT list_contains(now, x)))) / (2 * greatest(len(now), len(old), 1)) AS turnover
        FROM (SELECT *, coalesce(lag(now) OVER (ORDER BY date), []) AS old FROM held))""",
        f"path AS (SELECT date, len(now) AS names, gross, turnover, gross - turnover * {portfolio.ROUND_TRIP} AS net FROM turn)")


def book_of(spark, d) -> DataFrame:
    return portfolio.rebalance_books(floors(spark, d).withColumn("y_pred", F.col("beta_market")))


@query(sql_of(f"SELECT {DAY}, ticker, leg, round(y_true, 6) AS y_true FROM book", *PREDS, *BOOK))
def rebalance_books(spark, d):
    return shown(book_of(spark, d), "date ticker leg", "y_true")


@query(sql_of(f"SELECT {DAY}, CAST(names AS INT) AS names, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net FROM path", *PREDS, *BOOK))
def turnover_costs(spark, d):
    return shown(portfolio.simulate(book_of(spark, d)), "date names", "gross turnover net")


@query(sql_of(f"SELECT {DAY}, round(cum, 6) AS cum, round(exp(cum - greatest(max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0)) - 1, 6) AS drawdown FROM (SELECT date, sum(net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM path)", *PREDS, *BOOK))
def drawdown(spark, d):
    return shown(portfolio.drawdown(portfolio.simulate(book_of(spark, d))), "date", "cum drawdown")


@query(sql_of("""SELECT count(net) AS n, round(exp(avg(net) * 8.4) - 1, 5) AS annual_return, round(stddev_samp(net) * sqrt(8.4), 6) AS annual_vol, round(avg(net) * 8.4 / nullif(stddev_samp(net) * sqrt(8.4), 0), 5) AS sharpe,
 round(avg((net > 0)::INT), 6) AS win_rate, round(avg(turnover), 6) AS turnover FROM path""", *PREDS, *BOOK))
def book_metrics(spark, d):
    m = portfolio.book_metrics(portfolio.simulate(book_of(spark, d)))
    return m.select("n", *[F.round(c, n).alias(c) for c, n in (("annual_return", 5), ("annual_vol", 6), ("sharpe", 5), ("win_rate", 6), ("turnover", 6))])


@query(sql_of(f"SELECT {DAY}, round(avg(y_true) FILTER (leg = 'top'), 6) AS top, round(avg(y_true) FILTER (leg = 'bottom'), 6) AS bottom, round(avg(y_true) FILTER (leg = 'top') - avg(y_true) FILTER (leg = 'bottom'), 6) AS spread FROM book GROUP BY date", *PREDS, *BOOK))
def cross_sectional_report(spark, d):
    return shown(portfolio.cross_sectional_report(book_of(spark, d)), "date", "top bottom spread")


@query(sql_of(f"""SELECT 'duplicate_keys' AS "check", count(*) AS n_bad, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT 1 FROM bars GROUP BY ticker, date HAVING count(*) > 1)
 UNION ALL SELECT 'future_dates', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM bars WHERE date > DATE '{TODAY}'
 UNION ALL SELECT 'stale', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT max(date) AS d FROM bars) WHERE date_diff('day', d, DATE '{TODAY}') > 6
 UNION ALL SELECT 'price_breaks', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END FROM ret m WHERE abs(r) > 0.35 AND NOT EXISTS (SELECT 1 FROM bars a WHERE a.ticker = m.ticker AND a.volume >= 60 AND abs(date_diff('day', a.date, m.date)) <= 4)
 UNION ALL SELECT 'label_coverage', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT s_suppkey, count(target) AS n FROM supplier LEFT JOIN lab ON ticker = s_suppkey GROUP BY 1) WHERE n < 500""", RET, LAB))
def gate_report(spark, d):
    b, u = tables.bars(spark, d), tables.sectors(spark, d)
    return quality.run_gate([quality.duplicate_keys(b), quality.future_dates(b, TODAY), quality.stale(b, TODAY), quality.price_breaks(b, b.filter("volume >= 60")),
                             quality.label_coverage(labelled(spark, d), u, "target", 500)])


@query(sql_of("""SELECT ticker, CAST(max(pos) - min(pos) + 1 AS BIGINT) AS expected, count(*) AS stored, CAST(max(pos) - min(pos) + 1 - count(*) AS BIGINT) AS gap
 FROM bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars)) USING (date) GROUP BY ticker"""))
def sessions_contiguous(spark, d):
    b = tables.bars(spark, d)
    return quality.contiguous(b, b.select("date").distinct())


@query(sql_of(f"SELECT {DAY}, count(*) AS names, round(avg((open = close AND high = low)::INT), 6) AS flat_share FROM bars GROUP BY date HAVING count(*) >= 10 AND avg((open = close AND high = low)::INT) >= 0.9"))
def gate_flat_bars(spark, d):
    return shown(quality.flat_days(tables.bars(spark, d)), "date names", "flat_share")


@query(sql_of("""SELECT count(*) AS rows, round(avg((roc IS NULL)::INT), 6) AS null_share, round(avg(coalesce((roc = 0)::INT, 0)), 6) AS neutral_share, (SELECT max(n) FROM (SELECT count(*) AS n FROM lab WHERE roc IS NOT NULL GROUP BY round(roc, 1))) AS modal_rows,
 (SELECT CAST(sum((k <= 1)::INT) AS BIGINT) FROM (SELECT count(DISTINCT round(roc, 1)) AS k FROM lab GROUP BY ticker)) AS constant_tickers FROM (SELECT ticker, round(roc, 1) AS roc FROM lab)""", LAB))
def silent_neutral(spark, d):
    out = quality.silent_neutral(labelled(spark, d).withColumn("roc", F.round("roc", 1)), "roc")
    return shown(out, "rows modal_rows constant_tickers", "null_share neutral_share")


@query(sql_of(f"""SELECT ticker, max(n) AS longest_run FROM (SELECT ticker, run, count(*) AS n FROM (SELECT ticker, sum(new) OVER {W} AS run FROM
 (SELECT ticker, date, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS new FROM (SELECT ticker, date, CAST(floor(volume / 10) AS INT) AS up FROM bars))) GROUP BY ticker, run) GROUP BY ticker"""))
def silent_neutral_runs(spark, d):
    return windows.identical_runs(tables.bars(spark, d).withColumn("up", F.floor(F.col("volume") / 10)), "up")


_SENT = "url || CASE WHEN page_id % 3 = 0 THEN '?utm_id=a%' || page_id || '&x=1&ref=Home#top' WHEN page_id % 3 = 1 THEN '?Source=feed' ELSE '?id=7&' END"


@query(f"""SELECT page_id, sha256(CASE WHEN u <> '' THEN u ELSE regexp_replace(trim(lower(coalesce(html, ''))), '\\s+', ' ', 'g') END) AS article_id
 FROM (SELECT page_id, html, lower(regexp_replace(split_part(regexp_replace(trim(coalesce({_SENT}, '')), '{text.TRACKING}', '', 'gi'), '#', 1), '[?&]+$', '')) AS u FROM pages)""")
def article_identity(spark, d):
    sent = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("?utm_id=a%"), "page_id", F.lit("&x=1&ref=Home#top"))).when(F.col("page_id") % 3 == 1, "?Source=feed").otherwise("?id=7&")
    return tables.table(spark, d, "pages").select("page_id", text.article_identity(F.concat("url", sent), F.col("html")).alias("article_id"))


_FLAT = "' ' || regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g') || ' '"


@query(f"""SELECT doc_id, instr(lower({_FLAT}), ' the and ') > 0 AS name_match, instr({_FLAT}, ' THE ') > 0 AS symbol_match FROM documents""")
def alias_match(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.matches_alias(F.col("text"), F.lit("The and")).alias("name_match"), text.matches_alias(F.col("text"), F.lit("THE")).alias("symbol_match"))


@query("""SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_forecast_per_day(spark, d):
    e = tables.table(spark, d, "events").withColumn("date", F.to_date("ts"))
    return shown(windows.latest(e, ["user_id", "date"], [F.col("ts").desc(), F.col("event_id").desc()]), "event_id user_id date", "value")


@query("""SELECT user_id AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1, 2""")
def news_scores(spark, d):
    out = tables.articles(spark, d).groupBy("ticker", "date").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    return shown(out, "ticker date n", "mean sd")


@query("""SELECT DISTINCT user_id AS ticker, strftime(m, '%Y-%m') AS month FROM (SELECT user_id, unnest(generate_series(date_trunc('month', min(ts))::TIMESTAMP, date_trunc('month', max(ts))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM events GROUP BY user_id)""")
def observed_months(spark, d):
    span = tables.articles(spark, d).groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select("ticker", F.explode(text.months_spanned(F.col("a"), F.col("b"))).alias("month")).distinct()


@query(sql_of("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT ticker) AS BIGINT) AS tickers, CAST(count(DISTINCT date) AS BIGINT) AS dates, (SELECT round(median(n), 2) FROM (SELECT count(DISTINCT ticker) AS n FROM bars GROUP BY date)) AS median_names FROM bars"""))
def panel_coverage(spark, d):
    b = tables.bars(spark, d)
    per = b.groupBy("date").agg(F.countDistinct("ticker").alias("n")).agg(F.percentile("n", 0.5).alias("median_names"))
    return shown(b.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates")).join(per), "rows tickers dates", "median_names", 2)


@query("""SELECT s_suppkey AS ticker, s_name AS company, count(*) OVER () AS total, round(max(s_acctbal) OVER (), 4) AS top FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 20""")
def paged_list_with_totals(spark, d):
    s = tables.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("company"), "s_acctbal")
    total = s.agg(F.count("*").alias("total"), F.round(F.max("s_acctbal"), 4).alias("top"))  # one row
    return s.join(total).select("ticker", "company", "total", "top").orderBy("ticker").limit(20)


@query(sql_of("""SELECT CASE WHEN ic >= 0.02 AND n >= 500 THEN 'STRONG' WHEN ic >= 0.02 OR n >= 500 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS grade, n_name AS sector, count(*) AS n FROM (SELECT ticker, count(*) AS n,
 round(covar_pop(target, roc) / nullif(stddev_pop(target) * stddev_pop(roc), 0), 6) AS ic FROM lab WHERE target IS NOT NULL AND roc IS NOT NULL GROUP BY ticker) JOIN supplier ON s_suppkey = ticker JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""", LAB))
def grade_crosstab(spark, d):
    ic = F.round(F.covar_pop("target", "roc") / F.nullif(F.stddev_pop("target") * F.stddev_pop("roc"), F.lit(0.0)), 6)
    per = labelled(spark, d).filter("target is not null and roc is not null").groupBy("ticker").agg(F.count("*").alias("rows"), ic.alias("ic"))
    strong, some = F.coalesce(F.col("ic") >= 0.02, F.lit(False)), F.col("rows") >= 500
    grade = F.when(strong & some, "STRONG").when(strong | some, "WEAK").otherwise("INSUFFICIENT")
    return per.join(tables.sectors(spark, d), "ticker").groupBy(grade.alias("grade"), "sector").agg(F.count("*").alias("n"))


@query(sql_of("""SELECT coalesce(a.ticker, b.ticker) AS ticker, CAST(coalesce(a.period_end, b.period_end) AS VARCHAR) AS period_end, CASE WHEN a.ticker IS NULL THEN 'new' WHEN b.ticker IS NULL THEN 'gone'
 WHEN abs(a.eps - b.eps) > 1e-6 * greatest(abs(a.eps), 1e-12) THEN 'revised' ELSE 'unchanged' END AS state FROM fund a FULL JOIN (SELECT l_suppkey AS ticker, make_date(year(l_shipdate), 12, 31) AS period_end,
 sum(l_extendedprice * l_discount) / sum(l_quantity) AS eps FROM lineitem WHERE l_quantity > 2 GROUP BY 1, 2) b ON a.ticker = b.ticker AND a.period_end = b.period_end""", FUND))
def revision_log(spark, d):
    end = F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31))
    old = tables.fundamentals(spark, d).select("ticker", "period_end", F.col("eps").alias("a"))
    new = (tables.table(spark, d, "lineitem").filter("l_quantity > 2").groupBy(F.col("l_suppkey").alias("ticker"), end.alias("period_end"))
           .agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_quantity")).alias("b")))
    moved = F.abs(F.col("a") - F.col("b")) > 1e-6 * F.greatest(F.abs("a"), F.lit(1e-12))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(moved, "revised").otherwise("unchanged")
    return old.join(new, ["ticker", "period_end"], "full").select("ticker", F.col("period_end").cast("string").alias("period_end"), state.alias("state"))
