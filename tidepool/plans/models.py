"""Registered queries of probes, tuning, pooled trees, run logs and snapshots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidepool.operators import pooled, probe, runlog, snapshots, tuning
from tidepool.operators.pooling import shared_path
from tidepool.plans.catalog import DAY, LAB, W, labelled, query, rows, shown, sql_of
from tidepool.plans.extra import average_ranks
from tidepool.sources import tables

# probe ---------------------------------------------------------------------------------------------------------------

_DATES, _EDGES = 100, (0, 20, 40, 70, 100)


def _probe_rows(spark, d):
    """Embeddings with the quality of their document as outcome, on a hundred positions in the order of ids; others have none."""
    e, q = tables.table(spark, d, "embeddings"), tables.table(spark, d, "labels")
    n = e.agg(F.max("vec_id").alias("_last"))  # one row
    rows = e.join(n).join(q.select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("double").alias("y")), "vec_id", "left")
    return rows.select("vec_id", F.floor(F.col("vec_id") * _DATES / (F.col("_last") + 1)).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("x"), "y")


@query(f"""WITH p AS (SELECT CAST(floor(vec_id * {_DATES} / ((SELECT max(vec_id) FROM embeddings) + 1)) AS INT) AS pos, list_concat(list_concat([1.0::DOUBLE], list_transform(embedding, lambda v: CAST(v AS DOUBLE))), [CAST(quality AS DOUBLE)]) AS z FROM embeddings JOIN labels ON doc_id = vec_id),
u AS (SELECT CASE WHEN pos < 20 THEN 0 WHEN pos < 40 THEN 1 WHEN pos < 70 THEN 2 ELSE 3 END AS stretch, i, j, z[i + 1] * z[j + 1] AS v FROM p, range(0, 66) a(i), range(0, 66) b(j) WHERE i <= j)
SELECT CAST(stretch AS INT) AS stretch, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(v), 6) AS v FROM u GROUP BY 1, 2, 3""")
def probe_gram(spark, d):
    """Sums of products of constant, features and outcome for four stretches of positions, from one pass."""
    out = probe.moments(_probe_rows(spark, d), list(_EDGES), 64)
    cells = [(s, i, j, float(m.m[i, j])) for s, m in enumerate(out) for i in range(66) for j in range(i, 66) if m.n]
    return spark.createDataFrame(cells, "stretch int, i int, j int, v double").withColumn("v", F.round("v", 6))


def _fits(spark, d):
    return probe.fit_probe(_probe_rows(spark, d), _DATES, 64, n_folds=3, min_train=40, horizon=3, inner_folds=3, inner_min_train=12, alphas=tuple(10.0**k for k in range(-1, 6)))


@query()
def probe_alpha(spark, d):
    """Rows and chosen penalty of each fold (tested against dense linear algebra)."""
    return spark.createDataFrame([(f.fold, f.rows, f.alpha) for f in _fits(spark, d)], "fold int, n long, alpha double")


@query()
def probe_predictions(spark, d):
    out = probe.predict_probe(_probe_rows(spark, d), _fits(spark, d))
    return out.select("fold", "vec_id", "y", F.round("y_pred", 6).alias("y_pred"))


@query(sql_of(f"SELECT ticker, {DAY}, round(coalesce(stddev_pop(s) OVER w, 0), 6) AS ctx_std, round(v, 6) AS ctx_last FROM (SELECT ticker, date, ln(close) AS v, ln(close) - lag(ln(close)) OVER {W} AS s FROM bars) WINDOW w AS {rows(63)}"))
def embedding_scalars(spark, d):
    b = tables.bars(spark, d).withColumn("v", F.log("close"))
    return shown(probe.context_scalars(b, "v", 64), "ticker date", "ctx_std ctx_last")


# tuning --------------------------------------------------------------------------------------------------------------

_ALPHAS = (1.0, 1000.0, 100000.0)


@query(sql_of(f"""SELECT ticker, alpha, round(avg(e), 6) AS mae, round(avg(i), 5) AS rank_ic FROM (SELECT ticker, alpha, fold, avg(abs(p - y)) AS e, coalesce(-(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)), 1) AS i
 FROM (SELECT *, {average_ranks('y', 'ticker, alpha, fold')} AS a, {average_ranks('p', 'ticker, alpha, fold')} AS b FROM (SELECT te.ticker, te.fold, alpha, y, my + xy / (xx + alpha) * (x - mx) AS p FROM te JOIN tn USING (ticker, fold), (VALUES (1.0::DOUBLE), (1000.0), (100000.0)) t(alpha))) GROUP BY ticker, alpha, fold) GROUP BY ticker, alpha""", LAB,
              f"pl AS (SELECT ticker, date, coalesce(roc, 0) AS x, target AS y, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM lab)",
              "fd AS (SELECT *, least(s + step, n) AS z FROM (SELECT *, first + fold * step AS s FROM (SELECT ticker, n, first, greatest(1, (n - first) // 3) AS step, unnest([0, 1, 2]) AS fold FROM (SELECT DISTINCT ticker, n, greatest(120, n // 3) AS first FROM pl) WHERE n > first)) WHERE s - 60 >= first // 2 AND least(s + step, n) > s)",
              "tn AS (SELECT pl.ticker, fold, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy FROM pl JOIN fd ON fd.ticker = pl.ticker AND pos < s - 60 WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50)",
              "te AS (SELECT * FROM (SELECT pl.ticker, fold, x, y, count(*) OVER (PARTITION BY pl.ticker, fold) AS m FROM pl JOIN fd ON fd.ticker = pl.ticker AND pos >= s AND pos < z WHERE y IS NOT NULL) WHERE m >= 10)"))
def purged_cv(spark, d):
    """Three penalties of a ridge on the rate of change, scored on each name's own purged folds by both objectives."""
    s = tuning.purged_cv(labelled(spark, d).select("ticker", "date", "roc", "target"), "ticker", "roc", "target", list(_ALPHAS))
    return s.select("ticker", "alpha", F.round("mae", 6).alias("mae"), F.round("rank_ic", 5).alias("rank_ic"))


@query()
def penalty_search(spark, d):
    """The penalty that a seeded density search finds for the probe's inner folds, from moments alone (tested against a dense grid)."""
    parts = probe.moments(_probe_rows(spark, d), list(_EDGES), 64)
    train, test = parts[0] + parts[1], parts[2] + parts[3]

    def score(log_alpha: float) -> float:
        w, mean, sd, y = probe.ridge_path(train, (10.0**log_alpha,))
        return probe.squared_error(test, w[0], mean, sd, y)

    x, s, seen = tuning.density_search(score, -2.0, 6.0)
    return spark.createDataFrame([(float(round(x, 6)), float(round(s, 8)), len(seen))], "log_alpha double, mse double, trials int") if math.isfinite(s) else spark.createDataFrame([], "log_alpha double, mse double, trials int")


# pooled trees --------------------------------------------------------------------------------------------------------


@query()
def pooled_trees(spark, d):
    """Out-of-sample predictions of boosted trees on two standardised features, two purged folds (tested on a planted signal)."""
    panel = tables.deal(labelled(spark, d).select("date", "ticker", "roc", "volume", "target"), tables.tasks(spark, d), "date")
    p = pooled.prepare(panel, ["roc", "volume"])
    out = pooled.walk_forward(p, ["roc", "volume"], n_folds=2, min_train=1200, params={"maxIter": 5, "maxDepth": 3}, tasks=tables.tasks(spark, d))
    return out.select("fold", F.col("date").cast("string").alias("date"), "ticker", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))


# logs and snapshots --------------------------------------------------------------------------------------------------

_STATUS = "CASE event_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END"


@query(f"""WITH e AS (SELECT event_id AS version, 'run-' || user_id AS run_id, event_type AS job, {_STATUS} AS status, ts FROM events),
o AS (SELECT run_id, min(version) AS v, arg_min(job, version) AS job, arg_min(ts, version) AS started FROM e WHERE status = 'RUNNING' GROUP BY run_id),
c AS (SELECT run_id, arg_min(status, version) AS status, arg_min(ts, version) AS finished FROM e JOIN o USING (run_id) WHERE e.status <> 'RUNNING' AND version > v GROUP BY run_id)
SELECT run_id, o.job, coalesce(status, 'RUNNING') AS status, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished_at FROM o LEFT JOIN c USING (run_id)""")
def run_replay(spark, d):
    """States of runs from a log of changes, those that do not fit ignored."""
    e = tables.table(spark, d, "events").select(F.col("event_id").alias("version"), F.concat(F.lit("run-"), F.col("user_id")).alias("run_id"), F.col("event_type").alias("job"), F.expr(_STATUS).alias("status"), F.col("ts").alias("at"), F.col("props").alias("facts"))
    s = runlog.replay(e)
    return s.select("run_id", "job", "status", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")])


@query(sql_of("""SELECT ticker, CAST(effective_from AS VARCHAR) AS effective_from, CAST(effective_to AS VARCHAR) AS effective_to FROM iv UNION ALL SELECT ticker, CAST(min(date) AS VARCHAR), '9999-12-31' FROM bars b WHERE dayofmonth(date) = 15 AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.ticker = b.ticker AND b.date BETWEEN effective_from AND effective_to) GROUP BY ticker""",
              "iv AS (SELECT ticker, min(date) AS effective_from, CAST(min(date) + INTERVAL 400 DAY AS DATE) AS effective_to FROM bars WHERE ticker % 3 <> 0 GROUP BY ticker)"))
def membership_snapshots(spark, d):
    """Mid-month lists merged into stored intervals."""
    b = tables.bars(spark, d)
    iv = b.filter("ticker % 3 <> 0").groupBy("ticker").agg(F.min("date").alias("effective_from")).withColumn("effective_to", F.date_add("effective_from", 400))
    return shown(runlog.merge_snapshots(iv, b.filter("day(date) = 15").select("ticker", F.col("date").alias("day"))), "ticker effective_from effective_to", "")


def _digest_sql(name: str, columns: list[str]) -> str:
    cells = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE '+' || {c} END" for c in sorted(columns))
    part = lambda at: f"coalesce(sum(CAST(('0x' || substr(h, {at}, 12))::BIGINT AS HUGEINT)), 0)"
    return f"SELECT '{name}' AS \"table\", n, md5(n || '|' || a || '|' || b) AS digest FROM (SELECT count(*) AS n, {part(1)} AS a, {part(13)} AS b FROM (SELECT md5(concat_ws('|', {cells})) AS h FROM {name}))"


@query(f"{_digest_sql('nation', ['n_nationkey', 'n_name', 'n_regionkey'])} UNION ALL {_digest_sql('customer', ['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment'])} UNION ALL {_digest_sql('labels', ['doc_id', 'quality', 'toxic'])}")
def snapshot_manifest(spark, d):
    """The manifest of a snapshot that was written, checked and read again."""
    path = shared_path(spark)
    frames = {"nation": tables.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "customer": tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "labels": tables.table(spark, d, "labels").select("doc_id", "quality", "toxic")}
    manifest = snapshots.write_snapshot(frames, path, "c_custkey")
    if set(snapshots.load_snapshot(spark, path)) != set(frames):
        raise RuntimeError("the snapshot lacks a table")
    return manifest
