"""Registered queries of identities, cells, null spreads and the whole frame of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import recursive
from tidepool.operators import cells, folds, grading, identity, placebos, signals, windows
from tidepool.operators import crosssection as xs
from tidepool.plans import catalog
from tidepool.plans.catalog import DAY, LAB, MIN_TRAIN, PREDS, RET, labelled, query, ridge_sql, shown, sql_of
from tidepool.plans.extra import IC, average_ranks, tested
from tidepool.plans.study import _N
from tidepool.sources import tables

# identities ----------------------------------------------------------------------------------------------------------


@query("SELECT 'S' || s_suppkey || '.NS' AS ticker, s_name AS company, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 5")
def constituents(spark, d):
    """An index list with headers as vendors write them; rows without a symbol go."""
    s = tables.sectors(spark, d)
    k = F.col("ticker")
    listed = s.select(F.when(k % 17 == 5, "  ").otherwise(F.concat(F.lit(" S"), k)).alias("Symbol "), F.concat("company", F.lit(" ")).alias("Company Name"), F.col("sector").alias("INDUSTRY"))
    return identity.constituents(listed)


_NAMES = {"^BANK": "Bank index", "^IT": "Technology index"}


@query("""SELECT s_suppkey AS ticker, s_suppkey % 4 < 2 AS unresolved, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS state, CASE s_suppkey % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'FLAGGED' WHEN 2 THEN 'REJECTED' END AS verdict,
 CASE s_suppkey % 5 WHEN 0 THEN 'the rest of the universe (equal-weighted)' WHEN 1 THEN n_name || ' peers (equal-weighted)' WHEN 2 THEN 'Bank index' WHEN 3 THEN 'Technology index' ELSE '^OTHER' END AS benchmark FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def identity_fields(spark, d):
    """Names that are only symbols, unknown states, published verdicts and benchmark names."""
    s, k = tables.sectors(spark, d), F.col("ticker")
    symbol = F.concat(F.lit("S"), k, F.lit(".NS"))
    company = F.when(k % 4 == 0, F.concat(F.lit(" s"), k)).when(k % 4 == 2, F.col("company")).when(k % 4 == 3, F.concat(F.lit("S"), k, F.lit(" Limited")))
    state = F.when(k % 3 == 1, 2.0).when(k % 3 == 2, 0.0).when(k % 6 == 0, float("nan"))
    grade = F.when(k % 5 == 0, "STRONG").when(k % 5 == 1, "WEAK").when(k % 5 == 2, "INSUFFICIENT").when(k % 5 == 3, "OTHER")
    mark = F.when(k % 5 == 0, "EW-LOO:MARKET").when(k % 5 == 1, F.concat(F.lit("EW-LOO:"), "sector")).when(k % 5 == 2, "^BANK").when(k % 5 == 3, "^IT").otherwise("^OTHER")
    return s.select(k, identity.unresolved(symbol, company).alias("unresolved"), identity.tri_state(state).alias("state"), identity.verdict(grade).alias("verdict"), identity.benchmark_name(mark, _NAMES).alias("benchmark"))


@query(sql_of("""SELECT 'bars' AS "table", count(*) FILTER (ticker % 9 <> 4) AS kept, count(*) FILTER (ticker % 9 = 4) AS dropped FROM bars UNION ALL SELECT 'macro', count(DISTINCT CAST(o_orderdate AS DATE)), 0 FROM orders
 UNION ALL SELECT 'news', count(*) FILTER (user_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 4)), count(*) FILTER (user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 4)) FROM events"""))
def table_clean(spark, d):
    """Rows kept and dropped when tables are cut to a universe; a table without tickers stays whole."""
    u = tables.sectors(spark, d).filter("ticker % 9 <> 4").select("ticker")
    _, counts = identity.clean_tables({"bars": tables.bars(spark, d), "macro": tables.macro(spark, d), "news": tables.articles(spark, d)}, u)
    return counts


# cells and placebos --------------------------------------------------------------------------------------------------

_CELLS = "pd AS (SELECT fold, date, ticker, y_true, round(roc, 0) / 100 AS y_pred FROM te WHERE roc IS NOT NULL)"


def _cells(spark, d):
    return tested(spark, d).filter("roc is not null").select("fold", "date", "ticker", "y_true", (F.round("roc", 0) / 100).alias("y_pred"))


@query(sql_of(f"""SELECT n, tickers, cells, constant_cells, round(unique_fraction, 6) AS unique_fraction, round(mae, 6) AS mae, round(cs, 6) AS cs_rank_ic, round(ts, 6) AS ts_rank_ic, n_rebalances, round(reb_ic, 6) AS reb_ic, round(reb_t, 4) AS reb_t
FROM (SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, avg(abs(y_true - y_pred)) AS mae FROM pd), (SELECT count(*) AS cells, count(*) FILTER (u = 1) AS constant_cells, avg(u / n) AS unique_fraction FROM (SELECT ticker, fold, count(DISTINCT y_pred) AS u, count(*) AS n FROM pd GROUP BY 1, 2)),
 (SELECT avg(ic) AS cs FROM (SELECT fold, avg(ic) AS ic FROM (SELECT fold, date, CASE WHEN count(*) >= 3 THEN {IC} END AS ic FROM (SELECT fold, date, {average_ranks('y_true', 'fold, date')} AS a, {average_ranks('y_pred', 'fold, date')} AS b FROM pd) GROUP BY 1, 2) GROUP BY fold)),
 (SELECT avg(ic) AS ts FROM (SELECT CASE WHEN count(*) >= 3 THEN {IC} END AS ic FROM (SELECT fold, ticker, {average_ranks('y_true', 'fold, ticker')} AS a, {average_ranks('y_pred', 'fold, ticker')} AS b FROM pd) GROUP BY fold, ticker)),
 (SELECT count(ic) AS n_rebalances, avg(ic) AS reb_ic, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS reb_t FROM (SELECT CASE WHEN count(*) >= 3 THEN {IC} END AS ic FROM (SELECT date, {average_ranks('y_true', 'date')} AS a, {average_ranks('y_pred', 'date')} AS b FROM rb) GROUP BY date))""", *PREDS, _CELLS,
              "rb AS (SELECT * FROM (SELECT pd.*, count(*) OVER (PARTITION BY date) AS m, max(y_pred) OVER (PARTITION BY date) - min(y_pred) OVER (PARTITION BY date) AS s FROM pd JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM pd)) WHERE k % 30 = 0) USING (date)) WHERE m >= 10 AND s > 0)"))
def cell_metrics(spark, d):
    """Every score of one set of predictions, with the cells that carry no ordering."""
    out = cells.cell_metrics(_cells(spark, d))
    return out.select("n", "tickers", "cells", "constant_cells", "n_rebalances", *[F.round(c, 6).alias(c) for c in ("unique_fraction", "mae", "cs_rank_ic", "ts_rank_ic", "reb_ic")], F.round("reb_t", 4).alias("reb_t"))


@query(sql_of(f"""SELECT dates, rows, round(mean, 6) AS mean, round(se, 6) AS se FROM (SELECT count(DISTINCT date) AS dates, count(*) AS rows FROM te), (SELECT avg(m) AS mean, stddev_pop(m) AS se FROM (SELECT draw, avg(ic) AS m FROM (SELECT draw, date, CASE WHEN count(*) >= 3 THEN {IC} END AS ic
 FROM (SELECT draw, date, {average_ranks('y_true', 'draw, date')} AS a, {average_ranks('s', 'draw, date')} AS b FROM (SELECT a.draw, a.date, a.y_true, b.x AS s FROM nz a JOIN ns USING (k, j) JOIN nz b ON b.k = a.k AND b.i = ns.start + a.i % 30)) GROUP BY 1, 2) GROUP BY draw))""", *PREDS,
              f"nz AS MATERIALIZED (SELECT *, i // 30 AS j FROM (SELECT draw, draw || '|' || ticker AS k, date, y_true, {_N('''md5('19|' || draw || '|' || ticker || '|' || date)''')} AS x, row_number() OVER (PARTITION BY draw, ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY draw, ticker) AS n FROM te, range(1, 9) t(draw)))",
              "ns AS MATERIALIZED (SELECT k, j, CAST(('0x' || substr(md5('19|' || k || '|' || j), 1, 12))::BIGINT % greatest(n - 30, 1) AS BIGINT) AS start FROM (SELECT DISTINCT k, j, n FROM nz))"))
def objective_null_se(spark, d):
    """How far the mean rank correlation moves under predictions that know nothing."""
    out = cells.null_spread(tested(spark, d), 8, 30, 19, tasks=tables.tasks(spark, d))
    return out.select("dates", "rows", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query(sql_of(f"""SELECT {DAY}, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN {IC} END, 5) AS ic FROM (SELECT date, {average_ranks('y', 'date')} AS a, {average_ranks('roc', 'date')} AS b FROM (SELECT a.date, a.roc, b.y_true AS y FROM
 (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ticker) AS i FROM te WHERE roc IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5('23|' || date || '|' || ticker), ticker) AS i FROM te WHERE roc IS NOT NULL) b USING (date, i))) GROUP BY date""", *PREDS))
def target_permutation(spark, d):
    """Rank correlations after outcomes changed places within their dates: predictions, features and folds stay as they are."""
    te = tested(spark, d).filter("roc is not null").select("date", "ticker", "y_true", "roc")
    return shown(xs.rank_ic(placebos.permute_within(te, ["date"], "ticker", ["y_true"], F.lit(23)), "y_true", "roc", ["date"]), "date n", "ic", 5)


@query(sql_of("""SELECT draw, round(median(r2), 5) AS median_r2 FROM (SELECT draw, ticker, CASE WHEN n >= 3 AND vx > 1e-14 AND vy > 1e-14 THEN pow(sxy - sx * sy / n, 2) / (vx * vy) END AS r2 FROM (SELECT *, sxx - sx * sx / nullif(n, 0) AS vx, syy - sy * sy / nullif(n, 0) AS vy FROM
 (SELECT draw, ticker, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy, sum(sxx) AS sxx, sum(syy) AS syy FROM (SELECT 0 AS draw, * FROM fl UNION ALL SELECT draw, bk.* FROM bk JOIN dw USING (pos)) GROUP BY 1, 2))) WHERE r2 IS NOT NULL GROUP BY draw""", RET,
              "gd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS days FROM (SELECT DISTINCT date FROM ret))", "pr AS (SELECT ticker, date, r AS x, avg(r) OVER (PARTITION BY date) AS y FROM ret WHERE r IS NOT NULL)",
              "fl AS (SELECT k.ticker, gd.pos, (x IS NOT NULL)::INT AS n, coalesce(x, 0) AS sx, coalesce(y, 0) AS sy, coalesce(x * y, 0) AS sxy, coalesce(x * x, 0) AS sxx, coalesce(y * y, 0) AS syy FROM (SELECT DISTINCT ticker FROM ret) k JOIN gd ON TRUE LEFT JOIN pr ON pr.ticker = k.ticker AND pr.date = gd.date)",
              "bk AS (SELECT ticker, pos, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in ("n", "sx", "sy", "sxy", "sxx", "syy")) + " FROM fl WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))",
              "dw AS (SELECT draw, CAST(('0x' || substr(md5('7|' || draw || '|' || j), 1, 12))::BIGINT % (days - 20) AS BIGINT) AS pos FROM (SELECT any_value(days) AS days FROM gd), range(1, 21) a(draw), range(0, 1000) b(j) WHERE j < greatest(days // 20, 1))"))
def r2_bootstrap(spark, d):
    """Median squared correlation of names with the market, as it is and on twenty resamples of date blocks."""
    r = windows.rolling_beta(tables.bars(spark, d)).select(F.col("ticker").alias("series"), "date", F.col("r").alias("x"), F.col("m").alias("y"))
    return shown(cells.median_r2(r, 20, 20, 7).withColumn("draw", F.col("draw").cast("long")), "draw", "median_r2", 5)


_Z = "greatest(-3, least(3, coalesce(CASE WHEN count({c}) OVER w >= 10 AND stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END, 0)))"


@query(sql_of(f"SELECT u.factor, round(u.loading, 5) AS loading FROM (SELECT unnest(['intercept', 'roc', 'volume']) AS factor, unnest([intercept, w1, w2]) AS loading FROM ({ridge_sql('zr', 'zv', 'zt').replace('round(my - mp * w1 - mq * w2, 5)', 'my - mp * w1 - mq * w2').replace('round(w1, 5)', 'w1').replace('round(w2, 5)', 'w2')})) u", LAB,
              "gp AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM lab))", f"zt AS (SELECT 0 AS fold, target, zr, zv FROM (SELECT date, target, {_Z.format(c='roc')} AS zr, {_Z.format(c='volume')} AS zv FROM lab WINDOW w AS (PARTITION BY date)) JOIN gp USING (date) WHERE pos < {MIN_TRAIN - 60} AND target IS NOT NULL)"))
def factor_loadings(spark, d):
    """Coefficients of standardised factors on the earliest training window, comparable to one another."""
    lab = labelled(spark, d)
    z = xs.zscore(xs.zscore(lab, "roc", "zr"), "volume", "zv").join(folds.date_grid(lab), "date").filter((F.col("pos") < MIN_TRAIN - 60) & F.col("target").isNotNull()).withColumn("fold", F.lit(0))
    fit = folds.ridge(z, ["zr", "zv"])[0]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(("intercept", "roc", "volume"), (fit[0], *fit[1]))], "factor string, loading double").withColumn("loading", F.round("loading", 5))


@query(sql_of("SELECT before, after, count(*) AS n FROM (SELECT ticker, CASE WHEN avg(target) > 0.02 THEN 'STRONG' WHEN avg(target) > 0 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS before, CASE WHEN avg(target) FILTER (year(date) < 1998) > 0.02 THEN 'STRONG' WHEN avg(target) FILTER (year(date) < 1998) > 0 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS after FROM lab WHERE target IS NOT NULL GROUP BY ticker) GROUP BY 1, 2", LAB))
def grade_clean_up(spark, d):
    """Names by their grade on all labels and on those before 1998."""
    lab = labelled(spark, d).filter("target is not null")
    grade = lambda x: F.when(x > 0.02, "STRONG").when(x > 0, "WEAK").otherwise("INSUFFICIENT")
    old = lab.groupBy("ticker").agg(grade(F.avg("target")).alias("grade"))
    new = lab.groupBy("ticker").agg(grade(F.avg(F.when(F.year("date") < 1998, F.col("target")))).alias("grade"))
    return grading.clean_up_counts(new, old)


# the frame -----------------------------------------------------------------------------------------------------------

_PARTS = ("sma_bollinger", "stochastic_williams", "obv", "roc_volume", "prox_52w", "sma_deviation", "lag_returns", "recursive_indicators")


@query(" JOIN ".join([f"SELECT * FROM ({catalog.oracle_sql()[_PARTS[0]]}) q0", *[f"({catalog.oracle_sql()[p]}) q{i} USING (ticker, date)" for i, p in enumerate(_PARTS[1:], 1)]]))
def signals_frame(spark, d):
    """Every indicator of every row in one frame."""
    out = signals.signals(tables.bars(spark, d))
    digits = {c: 6 for c in signals.SIGNALS} | {c: 4 for c in recursive.INDICATORS}
    return out.select("ticker", F.col("date").cast("string").alias("date"), *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in digits.items()])
