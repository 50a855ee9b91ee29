"""Registered queries of surprises, books, residuals and long-run variance, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import announcements, folds, holding, longrun, neutral, pooling, portfolio, statistics, surprises, windows
from tidepool.operators import crosssection as xs
from tidepool.plans.catalog import DAY, LAB, PREDS, RET, W, floors, labelled, query, shown, sql_of
from tidepool.plans.extra import IC, POS, average_ranks, tested
from tidepool.plans.study import _N
from tidepool.sources import tables

# surprises -----------------------------------------------------------------------------------------------------------

_QUARTERS = ("qq AS (SELECT ticker, last_day(make_date(year(date), CAST(quarter(date) * 3 AS INT), 1)) AS period_end, round(avg(close) / 100, 4) AS own, round(avg(adj_close) / 100, 4) AS adj FROM bars GROUP BY 1, 2)",
             """qt AS (SELECT ticker, basis, period_end, eps, CASE WHEN ticker % 10 = 9 AND month(period_end) = 6 THEN NULL ELSE CAST(period_end + CAST(20 + (ticker * 7 + month(period_end) * 3 + year(period_end)) % 40 + CASE WHEN (ticker + quarter(period_end) + year(period_end)) % 9 = 0 THEN 150 ELSE 0 END AS INT) AS TIMESTAMP)
             + to_hours(CASE WHEN ticker % 2 = 0 THEN 18 ELSE 10 END) END AS disclosed FROM (SELECT ticker, 'standalone' AS basis, period_end, own AS eps FROM qq UNION ALL SELECT ticker, 'consolidated', period_end, adj FROM qq WHERE ticker % 3 <> 1))""",
             """ac AS (SELECT s_suppkey AS ticker, DATE '1995-06-15' + CAST(s_suppkey * 37 % 700 AS INT) AS ex_date, 2.0 AS factor FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, DATE '1997-03-01' + CAST(s_suppkey * 11 % 300 AS INT), 4.0 FROM supplier WHERE s_suppkey % 3 = 0)""",
             "br AS (SELECT s_suppkey AS ticker, DATE '1994-08-01' + CAST(s_suppkey * 13 % 900 AS INT) AS day FROM supplier WHERE s_suppkey % 5 = 0)")
_SUE = (*_QUARTERS, "kn AS (SELECT q.ticker, q.basis, q.period_end, q.eps, q.disclosed, coalesce(product(factor), 1) AS f FROM qt q LEFT JOIN ac ON ac.ticker = q.ticker AND ex_date <= CAST(disclosed AS DATE) WHERE disclosed IS NOT NULL GROUP BY ALL)",
        """pr AS (SELECT a.ticker, a.basis, a.period_end, k, b.eps * b.f / a.f AS v, EXISTS (SELECT 1 FROM br WHERE br.ticker = b.ticker AND day <= b.period_end AND day > last_day(b.period_end - to_months(12))) AS void
        FROM kn a JOIN range(0, 13) t(k) ON TRUE JOIN kn b ON b.ticker = a.ticker AND b.basis = a.basis AND b.period_end = last_day(a.period_end - to_months(CAST(3 * k AS INT))) AND (k = 0 OR b.disclosed < a.disclosed))""",
        "df AS (SELECT x.ticker, x.basis, x.period_end, x.k, CASE WHEN NOT x.void THEN x.v - y.v END AS d FROM pr x JOIN pr y ON y.ticker = x.ticker AND y.basis = x.basis AND y.period_end = x.period_end AND y.k = x.k + 4 WHERE x.k <= 8)",
        """su AS (SELECT kn.ticker, kn.basis, kn.period_end, eps, disclosed, diff, CAST(coalesce(n, 0) AS INT) AS n_sigma, CASE WHEN n >= 4 THEN s END AS sigma, CASE WHEN n >= 4 AND s > 0 THEN diff / s END AS sue FROM kn LEFT JOIN (SELECT ticker, basis, period_end, max(CASE WHEN k = 0 THEN d END) AS diff,
        count(CASE WHEN k > 0 THEN d END) AS n, stddev_samp(CASE WHEN k > 0 THEN d END) AS s FROM df GROUP BY 1, 2, 3) g USING (ticker, basis, period_end))""",
        "an AS (SELECT ticker, period_end, CASE WHEN sue IS NOT NULL THEN basis END AS basis, disclosed, sue FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_end ORDER BY CASE WHEN sue IS NOT NULL AND basis = 'consolidated' THEN 0 WHEN sue IS NOT NULL THEN 1 ELSE 2 END, disclosed, basis) AS r FROM su) WHERE r = 1)")


def _day(start: str, step: int, wrap: int):
    return F.date_add(F.lit(start).cast("date"), (F.col("s_suppkey") * step % wrap).cast("int"))


def _actions(spark, d) -> DataFrame:
    s = tables.table(spark, d, "supplier")
    row = lambda kind, keep, day, factor: s.filter(keep).select(F.col("s_suppkey").alias("ticker"), day.alias("ex_date"), F.lit(kind).alias("kind"), F.lit(factor).alias("factor"))
    return row("bonus", "s_suppkey % 2 = 0", _day("1995-06-15", 37, 700), 2.0).union(row("split", "s_suppkey % 3 = 0", _day("1997-03-01", 11, 300), 4.0)).union(row("demerger", "s_suppkey % 5 = 0", _day("1994-08-01", 13, 900), 1.0))


def surprise_table(spark, d) -> DataFrame:
    """Two bases of quarterly earnings, some disclosed late or never, with bonuses, splits and demergers."""
    end = F.last_day(F.make_date(F.year("date"), (F.quarter("date") * 3).cast("int"), F.lit(1)))
    q = tables.bars(spark, d).groupBy("ticker", end.alias("period_end")).agg(F.round(F.avg("close") / 100, 4).alias("own"), F.round(F.avg("adj_close") / 100, 4).alias("adj"))
    t, y, m = F.col("ticker"), F.year("period_end"), F.month("period_end")
    lag = 20 + (t * 7 + m * 3 + y) % 40 + F.when((t + F.quarter("period_end") + y) % 9 == 0, 150).otherwise(0)
    at = F.date_add("period_end", lag.cast("int")).cast("timestamp") + F.make_dt_interval(hours=F.when(t % 2 == 0, 18).otherwise(10))
    both = q.select("ticker", F.lit("standalone").alias("basis"), "period_end", F.col("own").alias("eps")).union(q.filter("ticker % 3 <> 1").select("ticker", F.lit("consolidated"), "period_end", "adj"))
    rows = both.withColumn("disclosed", F.when(~((t % 10 == 9) & (m == 6)), at))
    actions = _actions(spark, d)
    return surprises.point_in_time_surprises(rows, actions, actions.filter("kind = 'demerger'").select("ticker", F.col("ex_date").alias("day")), tasks=tables.tasks(spark, d))


@query(sql_of("SELECT ticker, basis, CAST(period_end AS VARCHAR) AS period_end, n_sigma, round(diff, 8) AS diff, round(sigma, 6) AS sigma, round(sue, 4) AS sue FROM su", *_SUE))
def point_in_time_sue(spark, d):
    """Surprises from what was disclosed by each disclosure, on its share basis, void across demergers."""
    s = surprise_table(spark, d)
    return s.select("ticker", "basis", F.col("period_end").cast("string").alias("period_end"), "n_sigma", F.round("diff", 8).alias("diff"), F.round("sigma", 6).alias("sigma"), F.round("sue", 4).alias("sue"))


@query(sql_of("SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, basis, strftime(disclosed, '%Y-%m-%d %H:%M') AS disclosed, round(sue, 4) AS sue FROM an", *_SUE))
def sue_announcements(spark, d):
    a = surprises.announced(surprise_table(spark, d))
    return a.select("ticker", F.col("period_end").cast("string").alias("period_end"), "basis", F.date_format("disclosed", "yyyy-MM-dd HH:mm").alias("disclosed"), F.round("sue", 4).alias("sue"))


_EVENTS = ("ue AS (SELECT a.ticker, a.sue, p.pos FROM (SELECT *, CASE WHEN hour(disclosed) < 15 THEN CAST(disclosed AS DATE) ELSE CAST(disclosed AS DATE) + 1 END AS day FROM an) a ASOF JOIN pos p ON a.day <= p.date)",
           "u1 AS (SELECT ticker, pos, sue FROM (SELECT *, row_number() OVER (PARTITION BY ticker, pos ORDER BY sue DESC NULLS LAST) AS r FROM ue) WHERE r = 1)",
           """ev AS (SELECT s.ticker, s.date, s.pos, CASE WHEN a.pos IS NOT NULL AND a.sue IS NOT NULL THEN CASE WHEN s.pos - a.pos < 30 THEN a.sue ELSE 0 END END AS sue_evt, CAST(CASE WHEN a.pos IS NOT NULL THEN least(s.pos - a.pos, 63) END AS DOUBLE) AS sue_age,
           CASE WHEN a.sue IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS sue_missing, f.sue AS sue_ffill FROM (SELECT ticker, date, pos FROM bars JOIN pos USING (date)) s ASOF LEFT JOIN u1 a ON s.ticker = a.ticker AND s.pos >= a.pos ASOF LEFT JOIN (SELECT * FROM u1 WHERE sue IS NOT NULL) f ON s.ticker = f.ticker AND s.pos >= f.pos)""")
_EVENT_COLUMNS = ("sue_evt", "sue_age", "sue_missing", "sue_ffill")
_IMPUTED = ", ".join(f"coalesce({c}, median({c}) OVER w, 0) AS {c}" if c != "sue_missing" else c for c in _EVENT_COLUMNS)
_SCORED = ", ".join(f"round(coalesce(CASE WHEN count({c}) OVER w >= 10 AND stddev_samp({c}) OVER w > 0 THEN greatest(-3, least(3, coalesce(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w, 0))) ELSE 0 END, 0), 4) AS {c}" for c in _EVENT_COLUMNS)


def _session_events(spark, d) -> tuple[DataFrame, DataFrame]:
    b = pooling.written(tables.bars(spark, d).select("ticker", "date"))  # sessions and announcements are read several times
    grid = folds.date_grid(b)
    known = pooling.written(surprises.announced(surprise_table(spark, d)))
    used = announcements.usable_sessions(known, grid.select("date"), "disclosed").filter("session is not null")
    return b.join(grid, "date"), used.join(grid.withColumnRenamed("date", "session"), "session").select("ticker", "pos", "sue")


@query(sql_of(f"SELECT ticker, {DAY}, {_SCORED} FROM (SELECT ticker, date, {_IMPUTED} FROM ev WINDOW w AS (PARTITION BY date)) WINDOW w AS (PARTITION BY date)", POS, *_SUE, *_EVENTS))
def sue_attach(spark, d):
    """Event columns on the panel, nulls at the date's median, standardised within the date."""
    sessions, used = _session_events(spark, d)
    f = surprises.event_features(sessions, used)
    out = surprises.attach_standardised(sessions.select("date", "ticker"), f, list(_EVENT_COLUMNS), ["sue_evt", "sue_age", "sue_ffill"])
    return shown(out, "ticker date", " ".join(_EVENT_COLUMNS), 4)


@query(sql_of(f"SELECT ticker, {DAY}, round(coalesce(CASE WHEN count(v) OVER w >= 10 AND stddev_samp(v) OVER w > 0 THEN greatest(-3, least(3, coalesce((v - avg(v) OVER w) / stddev_samp(v) OVER w, 0))) ELSE 0 END, 0), 4) AS reversal FROM rv WINDOW w AS (PARTITION BY date)", RET,
              "rv AS (SELECT ticker, date, CASE WHEN count(r) OVER w = 5 THEN -sum(r) OVER w END AS v FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"))
def reversal_attach(spark, d):
    b = tables.bars(spark, d)
    out = surprises.attach_standardised(b.select("date", "ticker"), windows.reversal(b), ["reversal"])
    return shown(out, "ticker date", "reversal", 4)


@query(sql_of("""SELECT e.ticker, CAST(period_end AS VARCHAR) AS period_end, round(sue, 4) AS sue, round(p1.p - p0.p - (m1.cum - m0.cum), 6) AS ann_ret, CAST(i1 - i0 AS INT) AS sessions, CAST(year(d1) AS INT) AS year FROM
 (SELECT a.*, q0.pos AS i0, q0.date AS d0, q1.pos AS i1, q1.date AS d1 FROM (SELECT *, CAST(disclosed AS DATE) AS day, CASE WHEN hour(disclosed) < 15 THEN CAST(disclosed AS DATE) ELSE CAST(disclosed AS DATE) + 1 END AS usable FROM an WHERE sue IS NOT NULL) a ASOF JOIN pos q0 ON a.day > q0.date ASOF JOIN pos q1 ON a.usable <= q1.date) e
 JOIN px p0 ON p0.ticker = e.ticker AND p0.pos = i0 JOIN px p1 ON p1.ticker = e.ticker AND p1.pos = i1 JOIN mk m0 ON m0.pos = i0 JOIN mk m1 ON m1.pos = i1
 WHERE i1 > i0 AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.ticker = e.ticker AND ex_date > d0 AND ex_date <= d1)""", POS, *_SUE,
              "px AS (SELECT ticker, pos, ln(close) AS p, CASE WHEN lag(pos) OVER (PARTITION BY ticker ORDER BY pos) = pos - 1 THEN ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY pos) END AS r FROM bars JOIN pos USING (date))",
              "mk AS (SELECT pos, sum(m) OVER (ORDER BY pos) AS cum FROM (SELECT pos, coalesce(avg(r), 0) AS m FROM px GROUP BY pos))"))
def announcement_returns(spark, d):
    a = surprises.announced(surprise_table(spark, d))
    out = surprises.announcement_returns(a, _actions(spark, d).filter("kind <> 'demerger'").select("ticker", "ex_date"), tables.bars(spark, d).select("ticker", "date", "close"))
    return out.select("ticker", F.col("period_end").cast("string").alias("period_end"), F.round("sue", 4).alias("sue"), F.round("ann_ret", 6).alias("ann_ret"), F.col("sessions").cast("int").alias("sessions"), "year")


# books ---------------------------------------------------------------------------------------------------------------


def _legs_sql(name: str, source: str, x: str, every: int) -> tuple[str, str]:
    """CTEs ``name``_rk and ``name``: the legs of the books on every ``every``-th date of ``source`` (date, ticker, y_true, x)."""
    k = "greatest(2, n // 5)"
    return (f"""{name}_rk AS (SELECT date, ticker, y_true, count(*) OVER w AS n, max({x}) OVER w - min({x}) OVER w AS spread, row_number() OVER (PARTITION BY date ORDER BY {x} DESC, md5(CAST(ticker AS VARCHAR))) AS down, row_number() OVER (PARTITION BY date ORDER BY {x}, md5(CAST(ticker AS VARCHAR)) DESC) AS up
 FROM {source} JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM {source} WHERE {x} IS NOT NULL AND y_true IS NOT NULL)) WHERE k % {every} = 0) USING (date) WHERE {x} IS NOT NULL AND y_true IS NOT NULL WINDOW w AS (PARTITION BY date))""",
            f"{name} AS (SELECT date, ticker, y_true, CASE WHEN down <= {k} THEN 'top' ELSE 'bottom' END AS leg FROM {name}_rk WHERE n >= 10 AND spread > 0 AND (down <= {k} OR up <= {k}))")


def _path_sql(name: str, legs: str) -> tuple[str, str]:
    turn = lambda a, b: f"(len(list_filter({a}, lambda x: NOT list_contains({b}, x))) + len(list_filter({b}, lambda x: NOT list_contains({a}, x)))) / (2 * greatest(len({a}), len({b}), 1))"
    return (f"""{name}_h AS (SELECT *, coalesce(lag(t) OVER (ORDER BY date), []) AS t0, coalesce(lag(b) OVER (ORDER BY date), []) AS b0 FROM (SELECT date, avg(y_true) FILTER (leg = 'top') - avg(y_true) FILTER (leg = 'bottom') AS gross, list(ticker) FILTER (leg = 'top') AS t, list(ticker) FILTER (leg = 'bottom') AS b FROM {legs} GROUP BY date))""",
            f"{name} AS (SELECT date, gross, turnover, gross - turnover * {portfolio.ROUND_TRIP} AS net FROM (SELECT date, gross, ({turn('t', 't0')} + {turn('b', 'b0')}) / 2 AS turnover FROM {name}_h))")


def _t_sql(x: str) -> str:
    return f"round(CASE WHEN count({x}) >= 3 AND stddev_samp({x}) > 0 THEN avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) END, 4)"


_SIGNAL = "sg AS (SELECT ticker, date, roc AS x, coalesce(target, 0) AS y_true FROM lab)"


@query(sql_of(f"""SELECT CAST(pos AS INT) AS pos, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * {portfolio.ROUND_TRIP}, 6) AS net FROM (SELECT pos, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover
 FROM (SELECT pos, sum(w * coalesce(r, 0)) AS gross FROM (SELECT c.pos + h AS pos, ticker, sum(w) AS w FROM cw c, range(1, 21) t(h) GROUP BY 1, 2) LEFT JOIN (SELECT ticker, pos, r FROM ret JOIN pos USING (date)) USING (pos, ticker) GROUP BY pos)
 FULL JOIN (SELECT pos, sum(abs(x)) / 2 AS turnover FROM (SELECT pos, ticker, sum(x) AS x FROM (SELECT pos + 1 AS pos, ticker, w AS x FROM cw UNION ALL SELECT pos + 21, ticker, -w FROM cw) GROUP BY 1, 2) GROUP BY pos) USING (pos)) WHERE pos <= (SELECT max(pos) FROM pos)""",
              LAB, RET, POS, _SIGNAL, *_legs_sql("lg", "sg", "x", 5), "cw AS (SELECT pos, ticker, CASE WHEN leg = 'top' THEN 1.0::DOUBLE ELSE -1.0 END / count(*) OVER (PARTITION BY pos, leg) / 4 AS w FROM lg JOIN pos USING (date))"))
def cohort_book(spark, d):
    """Every fifth session a cohort of outer fifths by rate of change, held for 20 sessions: four overlap."""
    lab = labelled(spark, d)
    grid = folds.date_grid(lab)
    legs = portfolio.rebalance_books(lab.select("date", "ticker", F.col("roc").alias("y_pred"), F.coalesce("target", F.lit(0.0)).alias("y_true")), 5).join(grid, "date").select("pos", "ticker", "leg")
    r = windows.rolling_beta(tables.bars(spark, d)).select("date", "ticker", "r").join(grid, "date")
    path = holding.cohort_book(legs, r, 20, 4)
    return path.select(F.col("pos").cast("int").alias("pos"), *[F.round(c, 6).alias(c) for c in ("gross", "turnover", "net")])


_SURPRISED = "sp AS (SELECT ev.ticker, ev.date, sue_evt AS x, target AS y_true FROM ev JOIN lab USING (ticker, date))"


def _event_path(spark, d) -> DataFrame:
    sessions, used = _session_events(spark, d)
    f = surprises.event_features(sessions, used).select("ticker", "date", F.col("sue_evt").alias("y_pred"))
    return holding.long_short(portfolio.rebalance_books(f.join(labelled(spark, d).select("ticker", "date", F.col("target").alias("y_true")), ["ticker", "date"])))


@query(sql_of(f"""SELECT count(*) AS n, round(avg(gross), 6) AS gross, round(avg(net), 6) AS net, {_t_sql('gross')} AS t_gross, {_t_sql('net')} AS t_net, round(avg(turnover), 6) AS turnover, round(CASE WHEN count(net) >= 3 AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252 / 30.0::DOUBLE) END, 4) AS sharpe FROM ep""",
              LAB, POS, *_SUE, *_EVENTS, _SURPRISED, *_legs_sql("el", "sp", "x", 30), *_path_sql("ep", "el")))
def pead_book(spark, d):
    """Outer fifths by the live surprise alone, long the top, short the bottom, net of a round trip."""
    s = holding.book_summary(_event_path(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("gross", "net", "turnover")], *[F.round(c, 4).alias(c) for c in ("t_gross", "t_net", "sharpe")])


@query(sql_of(f"""SELECT count(*) AS n, {', '.join(f'round(avg({s}.{c}), 6) AS {c}_{s[0]}' for s in ('a', 'b') for c in ('gross', 'net', 'turnover'))}, round(avg(b.net - a.net), 6) AS difference, {_t_sql('b.net - a.net')} AS t FROM np a JOIN ep b USING (date)""",
              LAB, POS, *_SUE, *_EVENTS, _SURPRISED, *_legs_sql("el", "sp", "x", 30), *_path_sql("ep", "el"), "mp AS (SELECT ev.ticker, ev.date, roc AS x, CASE WHEN sue_evt IS NOT NULL THEN target END AS y_true FROM ev JOIN lab USING (ticker, date))", *_legs_sql("ml", "mp", "x", 30), *_path_sql("np", "ml")))
def book_comparison(spark, d):
    """Books by rate of change and by live surprise on the rebalances of both, net of costs."""
    sessions, used = _session_events(spark, d)
    live = surprises.event_features(sessions, used).filter("sue_evt is not null").select("ticker", "date")
    lab = labelled(spark, d).join(live, ["ticker", "date"]).select("ticker", "date", F.col("roc").alias("y_pred"), F.col("target").alias("y_true"))
    out = holding.net_of_cost(holding.long_short(portfolio.rebalance_books(lab)), _event_path(spark, d))
    return out.select("n", *[F.round(f"{c}_{s}", 6).alias(f"{c}_{s}") for s in "ab" for c in ("gross", "net", "turnover")], F.round("difference", 6).alias("difference"), F.round("t", 4).alias("t"))


# residuals -----------------------------------------------------------------------------------------------------------

_CHANNEL = f"""ch AS (SELECT date, ticker, beta_market AS y_pred, (beta_market - avg(beta_market) OVER w) / nullif(stddev_pop(beta_market) OVER w, 0) + 0.5 * {_N("md5('12|' || date || '|' || ticker)")} AS y FROM preds WINDOW w AS (PARTITION BY date))"""
_NEXT = "nx AS (SELECT date, ticker, lead(y_pred, 1, first) OVER (PARTITION BY date ORDER BY ticker) AS b FROM (SELECT *, first(y_pred) OVER (PARTITION BY date ORDER BY ticker) AS first FROM ch))"


def _residual_sql(name: str, basis: str) -> tuple[str, ...]:
    """CTE ``name``: n_rebalances, n_without_ordering, ic, t of rows (date, ticker, y_pred, y, b) of ``basis``."""
    return (f"{name}_v AS (SELECT *, CASE WHEN count(*) OVER w >= 3 AND var_pop(b) OVER w > 1e-12 THEN y - avg(y) OVER w - covar_pop(y, b) OVER w / nullif(var_pop(b) OVER w, 0) * (b - avg(b) OVER w) END AS r FROM {basis} WINDOW w AS (PARTITION BY date))",
            f"{name}_d AS (SELECT v.*, count(*) OVER (PARTITION BY date) AS n, max(y_pred) OVER (PARTITION BY date) - min(y_pred) OVER (PARTITION BY date) AS s FROM {name}_v v JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM {name}_v WHERE r IS NOT NULL AND y_pred IS NOT NULL)) WHERE k % 30 = 0) USING (date) WHERE r IS NOT NULL AND y_pred IS NOT NULL)",
            f"{name}_i AS (SELECT date, {IC} AS ic FROM (SELECT date, {average_ranks('r', 'date')} AS a, {average_ranks('y_pred', 'date')} AS b FROM {name}_d WHERE n >= 10 AND s > 0) GROUP BY date)",
            f"{name} AS (SELECT count(ic) AS n_rebalances, (SELECT count(DISTINCT date) FROM {name}_d WHERE n >= 10 AND s = 0) AS n_without_ordering, CASE WHEN count(ic) >= 3 THEN avg(ic) END AS ic, CASE WHEN count(ic) >= 3 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END AS t FROM {name}_i)")


def _channel(spark, d) -> DataFrame:
    """The floor's predictions with a planted outcome that follows them: the z-score within the date plus noise."""
    from tidepool.operators import placebos

    day = Window.partitionBy("date")
    noise = placebos.normal(placebos.draw(F.lit(12), F.col("date"), F.col("ticker")))
    return floors(spark, d).select("date", "ticker", F.col("beta_market").alias("y_pred"), ((F.col("beta_market") - F.avg("beta_market").over(day)) / F.nullif(F.stddev_pop("beta_market").over(day), F.lit(0.0)) + 0.5 * noise).alias("y_true"))


@query(sql_of("SELECT n_rebalances, n_without_ordering, round(ic, 5) AS ic, round(t, 3) AS t FROM rr", *PREDS, "rb AS (SELECT te.date, te.ticker, te.roc AS y_pred, te.y_true AS y, beta_market AS b FROM te JOIN preds USING (fold, date, ticker) WHERE te.roc IS NOT NULL)", *_residual_sql("rr", "rb")))
def residual_report(spark, d):
    """The rate of change's ordering of what the floor's beta leaves of the outcomes."""
    p = floors(spark, d)
    te = tested(spark, d).filter("roc is not null").select("date", "ticker", F.col("roc").alias("y_pred"), "y_true")
    out = neutral.residual_report(neutral.neutralise(te, p.select("date", "ticker", F.col("beta_market").alias("basis"))))
    return out.select("n_rebalances", "n_without_ordering", F.round("ic", 5).alias("ic"), F.round("t", 3).alias("t"))


@query(sql_of("SELECT basis, passed, computable, abs(ic) > 0.5 AS leaks FROM (SELECT 'own' AS basis, coalesce(abs(t) < 2 OR abs(ic) <= 0.02, FALSE) AS passed, t IS NOT NULL AS computable, ic FROM g1 UNION ALL SELECT 'misaligned', coalesce(abs(t) < 2 OR abs(ic) <= 0.02, FALSE), t IS NOT NULL, ic FROM g2)", *PREDS, _CHANNEL, _NEXT,
              "c1 AS (SELECT *, y_pred AS b FROM ch)", "c2 AS (SELECT ch.*, b FROM ch JOIN nx USING (date, ticker))", *_residual_sql("g1", "c1"), *_residual_sql("g2", "c2")))
def calibration_gate(spark, d):
    """The floor's ordering against its own residual passes; against the residual on the next name's beta it must fail."""
    p = _channel(spark, d)
    by = Window.partitionBy("date").orderBy("ticker")
    moved = p.select("date", "ticker", F.coalesce(F.lead("y_pred").over(by), F.first("y_pred").over(by)).alias("basis"))
    own = p.select("date", "ticker", F.col("y_pred").alias("basis"))
    gate = lambda name, b: neutral.calibration_gate(neutral.residual_report(neutral.neutralise(p, b))).select(F.lit(name).alias("basis"), "passed", "computable", (F.abs("ic") > 0.5).alias("leaks"))
    return gate("own", own).union(gate("misaligned", moved))


# long-run variance ---------------------------------------------------------------------------------------------------

_PRODUCT = """rp AS (SELECT date, ticker, p * t / nullif(sqrt(avg(p * p) OVER w * avg(t * t) OVER w), 0) AS x FROM (SELECT date, ticker, CASE WHEN n > 1 THEN 2 * (a - 1) / (n - 1) - 1 ELSE 0 END AS p, CASE WHEN n > 1 THEN 2 * (b - 1) / (n - 1) - 1 ELSE 0 END AS t
 FROM (SELECT date, ticker, count(*) OVER (PARTITION BY date) AS n, {a} AS a, {b} AS b FROM te WHERE roc IS NOT NULL)) WINDOW w AS (PARTITION BY date))""".format(a=average_ranks("roc", "date"), b=average_ranks("y_true", "date"))


def rank_products(spark, d) -> DataFrame:
    te = tested(spark, d).filter("roc is not null")
    return statistics.rank_product(xs.unit_rank(xs.unit_rank(te, "roc", "p"), "y_true", "t"), "t", "p")


@query(sql_of("""SELECT n, CAST(dates AS BIGINT) AS dates, CAST(bw AS INT) AS bandwidth, round(mean, 6) AS mean, round(sqrt(greatest(s, 0) * n / (n - 1)) / n, 6) AS se FROM (SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(dates) AS dates, any_value(bw) AS bw, sum(CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / (bw + 1)) END * a.e * b.e) AS s
 FROM dk a JOIN range(0, 60) t(l) ON l <= bw JOIN (SELECT t, e FROM dk) b ON b.t = a.t - l)""", *PREDS, _PRODUCT,
              "dk AS (SELECT row_number() OVER (ORDER BY date) AS t, s - c * mean AS e, n, mean, count(*) OVER () AS dates, floor(4 * pow(count(*) OVER () / 100, 2 / 9::DOUBLE)) AS bw FROM (SELECT date, sum(x) AS s, count(*) AS c FROM rp WHERE x IS NOT NULL GROUP BY date), (SELECT count(*) AS n, avg(x) AS mean FROM rp WHERE x IS NOT NULL))"))
def dk_panel(spark, d):
    """Standard error of the panel's mean rank product with any dependence within dates."""
    out = longrun.driscoll_kraay_panel(rank_products(spark, d), "product")
    return out.select("n", "dates", "bandwidth", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query(sql_of("""SELECT n, CAST(cut AS INT) AS cut, round(least(pow(2 * g * g / (4 / 3::DOUBLE * lr * lr), 1 / 3::DOUBLE) * pow(n, 1 / 3::DOUBLE), most), 4) AS circular, round(least(pow(2 * g * g / (2 * lr * lr), 1 / 3::DOUBLE) * pow(n, 1 / 3::DOUBLE), most), 4) AS stationary
 FROM (SELECT n, cut, ceil(least(3 * sqrt(n), n / 3)) AS most, sum(CASE WHEN l > 0 AND l <= m THEN 2 * CASE WHEN l / m <= 0.5 THEN 1 ELSE 2 * (1 - l / m) END * l * acv ELSE 0 END) AS g, sum(CASE WHEN l = 0 THEN acv WHEN l <= m THEN 2 * CASE WHEN l / m <= 0.5 THEN 1 ELSE 2 * (1 - l / m) END * acv ELSE 0 END) AS lr
  FROM lg JOIN (SELECT any_value(top) AS top_, min(CASE WHEN calm AND l + kn <= top THEN l END) AS cut, least(coalesce(2 * greatest(min(CASE WHEN calm AND l + kn <= top THEN l END), 1), any_value(top)), any_value(top)) AS m FROM
   (SELECT l, kn, top, max(loud::INT) OVER (ORDER BY l ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 0 AS calm FROM lg)) ON TRUE GROUP BY n, cut, most)""", *PREDS, _PRODUCT,
              "sr AS (SELECT date, avg(x) AS x FROM rp WHERE x IS NOT NULL GROUP BY date)", "se AS (SELECT row_number() OVER (ORDER BY date) AS t, x - avg(x) OVER () AS e, count(*) OVER () AS n FROM sr)",
              "tp AS (SELECT *, 5 AS kn, CAST(ceil(sqrt(n)) + 5 AS INT) AS top FROM se)",
              """lg AS (SELECT l, any_value(n) AS n, any_value(kn) AS kn, any_value(top) AS top, sum(e * b) / any_value(n) AS acv, coalesce(abs(sum(e * b)) / nullif(sqrt(sum(CASE WHEN t - 1 > l THEN e * e ELSE 0 END) * sum(CASE WHEN t < n THEN b * b ELSE 0 END)), 0), 0) >= 2 * sqrt(log10(any_value(n)) / any_value(n)) AS loud
              FROM (SELECT l, x.t, x.e, x.n, x.kn, x.top, y.e AS b FROM tp x JOIN range(0, 400) r(l) ON l <= x.top JOIN se y ON y.t = x.t - l) GROUP BY l)"""))
def auto_block(spark, d):
    """Block lengths that the dates' mean rank products ask for by their own autocorrelation."""
    out = longrun.block_length(rank_products(spark, d), "product")
    return out.select("n", F.col("cut").cast("int").alias("cut"), F.round("circular", 4).alias("circular"), F.round("stationary", 4).alias("stationary"))
