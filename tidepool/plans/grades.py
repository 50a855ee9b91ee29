"""Registered queries of panel grading, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import grading, placebos
from tidepool.operators import crosssection as xs
from tidepool.plans.catalog import PREDS, query, sql_of
from tidepool.plans.extra import average_ranks, tested
from tidepool.plans.ledger import _TAIL, _TICS
from tidepool.plans.more import _BOOT
from tidepool.plans.study import _N
from tidepool.sources import tables

REPLICATES = 40

#: Planted correlations by name: strong, weak, none and backwards; every eleventh name has only two folds.
_LEVEL = "CASE ticker % 10 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.08 WHEN 3 THEN 0.08 WHEN 4 THEN -0.5 ELSE 0.0 END"
_RANKED = """{n}k AS (SELECT fold, date, ticker, CASE WHEN n > 1 THEN 2 * (a - 1) / (n - 1) - 1 ELSE 0 END AS p, CASE WHEN n > 1 THEN 2 * (b - 1) / (n - 1) - 1 ELSE 0 END AS t FROM (SELECT *, {a} AS a, {b} AS b FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM {src}) WHERE n >= 10)),
 {n} AS (SELECT fold, ticker, date, p * t / nullif(sqrt(avg(p * p) OVER w * avg(t * t) OVER w), 0) AS x FROM {n}k WINDOW w AS (PARTITION BY date))"""


def _products_sql(name: str, src: str) -> str:
    return _RANKED.format(n=name, src=src, a=average_ranks("y_pred", "date"), b=average_ranks("y_true", "date"))


def _planted_sql(level: str) -> str:
    return f"""pl AS (SELECT fold, date, ticker, y_true, ic * (y_true - avg(y_true) OVER w) / nullif(stddev_pop(y_true) OVER w, 0) + sqrt(1 - ic * ic) * {_N("md5('15|' || date || '|' || ticker)")} AS y_pred FROM (SELECT *, {level} AS ic FROM te WHERE ticker % 11 <> 0 OR fold < 2) WINDOW w AS (PARTITION BY date))"""


_REML = """st AS (SELECT g, greatest(var_samp(x) - avg(v), 0) AS t, count(*) AS k FROM {src} GROUP BY g),
 it AS (SELECT 0 AS i, g, t, FALSE AS done FROM st WHERE k >= 2 UNION ALL SELECT i + 1, g, new, abs(new - t) < 1e-12 FROM (SELECT i, g, any_value(t) AS t, greatest(sum(w * w * (pow(x - mu, 2) + 1 / sw - v)) / sum(w * w), 0) AS new FROM
  (SELECT i, g, t, x, v, w, sum(w) OVER (PARTITION BY g) AS sw, sum(w * x) OVER (PARTITION BY g) / sum(w) OVER (PARTITION BY g) AS mu FROM (SELECT i, it.g, t, x, v, 1 / (v + t) AS w FROM it JOIN {src} s ON s.g = it.g WHERE NOT done AND i < 200)) GROUP BY i, g)),
 ta AS (SELECT g, arg_max(t, i) AS tau2 FROM it GROUP BY g)"""


def _effects_sql(name: str, src: str) -> str:
    return f"{name} AS (SELECT ticker, count(mean) AS folds, avg(mean) AS x, CASE WHEN count(mean) >= 2 THEN var_samp(mean) / count(mean) END AS v FROM (SELECT fold, ticker, avg(x) AS mean FROM {src} GROUP BY fold, ticker) GROUP BY ticker)"


def planted(spark, d, level) -> object:
    """Test rows with predictions whose correlation within a date follows ``level`` of the ticker."""
    te = tested(spark, d).select("fold", "date", "ticker", "y_true").filter((F.col("ticker") % 11 != 0) | (F.col("fold") < 2)).withColumn("ic", level)
    te = tables.deal(te, tables.tasks(spark, d), "date")
    day = Window.partitionBy("date")
    z = (F.col("y_true") - F.avg("y_true").over(day)) / F.nullif(F.stddev_pop("y_true").over(day), F.lit(0.0))
    noise = placebos.normal(placebos.draw(F.lit(15), F.col("date"), F.col("ticker")))
    return te.select("fold", "date", "ticker", "y_true", (F.col("ic") * z + F.sqrt(1 - F.col("ic") * F.col("ic")) * noise).alias("y_pred"))


def _level():
    k = F.col("ticker") % 10
    return F.when(k <= 1, 0.5).when(k <= 3, 0.08).when(k == 4, -0.5).otherwise(0.0)


def _ctes(level: str) -> tuple[str, ...]:
    return (*PREDS, _planted_sql(level), _products_sql("src", "pl") + _BOOT.replace("{r}", str(REPLICATES + 1)), _effects_sql("re", "src"),
            "ag AS (SELECT replicate AS g, ticker, avg(mean) AS x, CASE WHEN count(mean) >= 2 THEN var_samp(mean) / count(mean) END AS v FROM boot GROUP BY 1, 2)", "sp AS (SELECT ticker, var_samp(x) AS bv FROM ag GROUP BY ticker)",
            "nm AS (SELECT ticker, folds, x, CASE WHEN bv > 0 THEN bv ELSE v END AS v FROM re LEFT JOIN sp USING (ticker))", "us AS MATERIALIZED (SELECT 0 AS g, * FROM nm WHERE folds >= 3 AND v > 0)", "ap AS MATERIALIZED (SELECT g, x, v FROM ag WHERE v > 0 UNION ALL SELECT g, x, v FROM us)",
            _REML.replace("{src}", "ap"), "pm AS (SELECT ap.g, any_value(tau2) AS tau2, sum(x / (v + tau2)) / sum(1 / (v + tau2)) AS mu, 1 / sum(1 / (v + tau2)) AS mu_var, count(*) AS k, sum(x * x / v) - pow(sum(x / v), 2) / sum(1 / v) AS q FROM ap JOIN ta ON ta.g = ap.g GROUP BY ap.g)")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(sql_of(f"""SELECT nm.ticker, nm.folds, round(nm.x, 5) AS x, round(theta, 5) AS theta, round(b, 4) AS b, round(CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 4) AS p_positive, round(boot_p, 4) AS boot_p, round(rw_p, 5) AS rw_p, coalesce(bh, FALSE) AS bh, coalesce(by_, FALSE) AS by,
 coalesce(CASE WHEN rw_p <= 0.1 AND theta > 0.00512363994209475 AND CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END >= 0.9 THEN 'STRONG' WHEN theta > 0 AND CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END >= 0.9 THEN 'WEAK' END, 'INSUFFICIENT') AS grade
FROM nm LEFT JOIN ps USING (ticker) LEFT JOIN rw USING (ticker) LEFT JOIN mk USING (ticker)""", *_ctes(_LEVEL),
    "ps AS (SELECT ticker, theta, b, theta / sqrt(v * tau2 / (v + tau2) + b * b * mu_var) AS z FROM (SELECT ticker, x, us.v, tau2, mu_var, us.v / (us.v + tau2) AS b, us.v / (us.v + tau2) * mu + (1 - us.v / (us.v + tau2)) * x AS theta FROM us JOIN pm ON pm.g = 0))",
    "rs AS (SELECT ticker, x / sqrt(v) AS t, row_number() OVER (ORDER BY x / sqrt(v) DESC, ticker) AS rank FROM us)", "cb AS (SELECT ag.ticker, ag.g, ag.x - us.x AS dev, us.x, (ag.x - us.x) / sqrt(us.v) AS bt FROM ag JOIN us USING (ticker))",
    """rw AS (SELECT ticker, max(p) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS rw_p FROM (SELECT ticker, t, rank, (sum((top >= t)::INT) + 1) / (count(*) + 1) AS p FROM (SELECT cb.ticker, t, rank, max(bt) OVER (PARTITION BY cb.g ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS top FROM cb JOIN rs USING (ticker)) GROUP BY ticker, t, rank))""",
    "bp AS (SELECT ticker, boot_p, count(*) OVER () AS m, max(r) OVER (PARTITION BY boot_p) AS r FROM (SELECT ticker, boot_p, row_number() OVER (ORDER BY boot_p) AS r FROM (SELECT ticker, avg((dev >= x)::INT) AS boot_p FROM cb GROUP BY ticker)))",
    "mk AS (SELECT ticker, boot_p, r <= coalesce((SELECT max(r) FROM bp WHERE boot_p <= 0.1 * r / m), 0) AS bh, r <= coalesce((SELECT max(r) FROM bp WHERE boot_p <= 0.1 * r / m / (SELECT sum(1.0::DOUBLE / i) FROM range(1, CAST((SELECT max(m) FROM bp) AS INT) + 1) h(i))), 0) AS by_ FROM bp)")))
def panel_grades(spark, d):
    """Every name's grade on planted predictions: strong, weak, none, backwards, and some with too few folds."""
    names, _ = grading.grade_panel(grading.ranked_products(planted(spark, d, _level()), "y_true", "y_pred"), replicates=REPLICATES, tasks=tables.tasks(spark, d))
    return names.select("ticker", "folds", F.round("x", 5).alias("x"), F.round("theta", 5).alias("theta"), F.round("b", 4).alias("b"), F.round("p_positive", 4).alias("p_positive"), F.round("boot_p", 4).alias("boot_p"), F.round("rw_p", 5).alias("rw_p"), "bh", "by", "grade")


_PANEL_SQL = """SELECT (SELECT count(*) FROM nm) AS names, CAST(pm.k AS INT) AS usable, round(mu, 5) AS mu, round(se, 5) AS se_boot, round(mu / se, 3) AS z, round(tau2, 5) AS tau2, round(q, 3) AS q, tau2 <= 1e-6 OR q <= pm.k - 1 AS degenerate FROM pm, (SELECT stddev_samp(mu) AS se FROM pm WHERE g > 0) WHERE pm.g = 0"""


def _panel(spark, d, level):
    _, panel = grading.grade_panel(grading.ranked_products(planted(spark, d, level), "y_true", "y_pred"), replicates=REPLICATES, tasks=tables.tasks(spark, d))
    return panel


@query(_recursive(sql_of(_PANEL_SQL, *_ctes(_LEVEL))))
def panel_summary(spark, d):
    """The panel behind the grades: mean, its bootstrap error, heterogeneity."""
    p = _panel(spark, d, _level())
    return p.select("names", "usable", F.round("mu", 5).alias("mu"), F.round("se_boot", 5).alias("se_boot"), F.round("z", 3).alias("z"), F.round("tau2", 5).alias("tau2"), F.round("q", 3).alias("q"), "degenerate")


@query(_recursive(sql_of(f"SELECT degenerate, 'The names cannot be told apart: one mean of ' || printf('%+.3f', mu) || ' stands for all ' || usable AS statement FROM ({_PANEL_SQL})", *_ctes("0.3::DOUBLE"))))
def panel_headline(spark, d):
    """A panel whose names are planted alike is one statement, not many grades."""
    h = grading.headline(_panel(spark, d, F.lit(0.3)))
    return h.select("degenerate", F.format_string("The names cannot be told apart: one mean of %+.3f stands for all %d", "mu", "usable").alias("statement"))


@query(sql_of(f"""SELECT ticker, round(theta, 5) AS theta, round(p, 4) AS p_positive, coalesce(significant, FALSE) AS significant, coalesce(CASE WHEN significant AND theta < 0 THEN 'ANTI_SIGNAL' WHEN significant AND theta > 0 THEN CASE WHEN p >= 0.9 AND theta >= 0.00512363994209475 THEN 'STRONG' ELSE 'WEAK' END WHEN p >= 0.9 THEN 'WEAK' END, 'INSUFFICIENT') AS grade
 FROM re LEFT JOIN (SELECT ticker, theta, p, r <= coalesce((SELECT max(r) FROM pv WHERE p2 <= 0.1 * r / m), 0) AS significant FROM pv) USING (ticker)""", *PREDS, _planted_sql(_LEVEL), _products_sql("src", "pl"), _effects_sql("re", "src"),
    "ef AS (SELECT *, sum(x / v) OVER () / sum(1 / v) OVER () AS mu, 1 / sum(1 / v) OVER () AS mu_var, greatest(0, (sum(x * x / v) OVER () - pow(sum(x / v) OVER (), 2) / sum(1 / v) OVER () - (count(*) OVER () - 1)) / (sum(1 / v) OVER () - sum(1 / (v * v)) OVER () / sum(1 / v) OVER ())) AS tau2 FROM re WHERE v > 0)",
    f"pz AS (SELECT ticker, theta, CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END AS p FROM (SELECT ticker, theta, theta / sqrt(v * tau2 / (v + tau2) + b * b * mu_var) AS z FROM (SELECT *, v / (v + tau2) AS b, v / (v + tau2) * mu + (1 - v / (v + tau2)) * x AS theta FROM ef)))",
    "pv AS (SELECT *, row_number() OVER (ORDER BY p2) AS r, count(*) OVER () AS m FROM (SELECT *, 2 * least(p, 1 - p) AS p2 FROM pz))"))
def signed_grades(spark, d):
    """The older grading, which tells reliably backwards names from those without evidence."""
    products = grading.ranked_products(planted(spark, d, _level()), "y_true", "y_pred")
    products = tables.deal(products.select("fold", "ticker", "product"), tables.tasks(spark, d), "ticker")
    e = grading.name_effects(products.groupBy("fold", "ticker").agg(F.avg("product").alias("mean")), ["ticker"])
    return grading.grade_by_pooling(e.select("ticker", "x", "v")).select("ticker", F.round("theta", 5).alias("theta"), F.round("p_positive", 4).alias("p_positive"), "significant", "grade")


@query(_recursive(sql_of("SELECT CAST(k AS INT) AS k, round(q, 4) AS q, round(tau2, 6) AS tau2, tau2 <= 1e-6 OR q <= k - 1 AS degenerate FROM (SELECT count(*) AS k, any_value(tau2) AS tau2, sum(x * x / v) - pow(sum(x / v), 2) / sum(1 / v) AS q FROM fv, ta)", *PREDS, _TICS,
    "fv AS MATERIALIZED (SELECT 0 AS g, ticker, avg(ic) AS x, var_samp(ic) / count(ic) AS v FROM tics GROUP BY ticker HAVING count(ic) >= 2 AND var_samp(ic) > 0)", _REML.replace("{src}", "fv"))))
def degeneracy_test(spark, d):
    """Whether the spread of effects between tickers can be told from none, heterogeneity by restricted maximum likelihood."""
    t = xs.rank_ic(tested(spark, d).filter("roc is not null"), "y_true", "roc", ["fold", "ticker"])
    v = grading.name_effects(t.select("ticker", F.col("ic").alias("mean")), ["ticker"]).withColumn("_all", F.lit(1))
    p = grading.pool(v, ["_all"])
    return p.select("k", F.round("q", 4).alias("q"), F.round("tau2", 6).alias("tau2"), grading.degenerate(F.col("tau2"), F.col("q"), F.col("k")).alias("degenerate"))
