"""Work and memory of a task do not grow with the panel: dealing by size, single passes, and steps that are written once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_panel import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.operators import cells, inference, placebos, pooled, pooling, quality
from tidepool.operators import crosssection as xs
from tidepool.plans import audit, catalog, evidence, extra, grades, models, study  # noqa: F401
from tidepool.sources import tables

DEALT = ["rank_product_panel", "signed_grades", "purged_cv", "outcome_resolution", "realised_accuracy", "point_in_time_sue", "objective_null_se"]


@pytest.mark.parametrize("name", DEALT)
def test_more_tasks_than_the_session_names_where_the_table_is_larger(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)  # 6,000 line items: 13 tasks, the session names 4
    out = catalog.queries()[name](spark, SF)
    assert tables.tasks(spark, SF) > 4
    plan = out._jdf.queryExecution().toString()
    assert f", {tables.tasks(spark, SF)})" in plan and "REPARTITION_BY_NUM" in plan
    assert plain(out.toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())


def test_small_tables_keep_the_number_of_the_session(spark):
    assert tables.tasks(spark, SF) is None and tables.deal(spark.range(3), None, "id").collect() == spark.range(3).collect()


def test_bars_are_shuffled_once(spark):
    plan = catalog.labelled(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_one_window_ranks_with_ties_at_their_average(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 1.0, None, -0.0, 0.0, float("nan"), float("nan"))], "k string, v double")
    got = sorted(((r["v"], r["x"]) for r in df.select("v", xs.average_rank(F.col("v"), "k").alias("x")).collect() if r["v"] is not None), key=lambda p: p[1])
    assert [x for _, x in got] == [2.5, 2.5, 4.5, 4.5, 6.0, 7.5, 7.5]
    assert df.select(xs.average_rank(F.col("v"), "k"))._jdf.queryExecution().executedPlan().toString().count("+- Window ") <= 1


def _days(n):
    return [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(n)]


@pytest.mark.parametrize("days,block", [(50, 30), (20, 30), (7, 3)])
def test_bootstrap_makes_up_no_rows_for_dates_that_a_name_lacks(spark, days, block):
    rows = [(0, t, d, float(i * t % 7)) for t in (1, 2, 3) for i, d in enumerate(_days(days)) if t == 1 or i % t == 0] + [(0, 1, dt.date(2010, 1, 1), None)]
    df = spark.createDataFrame(rows, "fold int, ticker int, date date, x double")
    out = inference.block_bootstrap_means(df, "x", 5, block, 7)
    got = {(r["ticker"], r["replicate"]): r["mean"] for r in out.collect()}
    import hashlib
    value, grid = {(t, d): x for _, t, d, x in rows}, [*_days(days), dt.date(2010, 1, 1)]
    n = len(grid)
    for t in (1, 2, 3):
        for r in range(1, 6):
            drawn = []
            for j in range(-(-n // block)):
                at = int(hashlib.md5(f"7|0|{r}|{j}".encode()).hexdigest()[:12], 16) % n
                drawn += [p % n for p in range(at, min(at + block, n + min(n, block)))]
            xs_ = [value[t, grid[p]] for p in drawn if value.get((t, grid[p])) is not None]
            assert (t, r) not in got if not xs_ else got[t, r] == pytest.approx(sum(xs_) / len(xs_))
    assert "_c" not in out._jdf.queryExecution().analyzed().toString()  # no filled-in rows


def test_null_spread_equals_surrogates_of_every_series(spark):
    rows = [(d, t, float((i * 37 + t * 11) % 101)) for t in range(1, 7) for i, d in enumerate(_days(45)) if (i + t) % 3 or t < 3]
    some = spark.createDataFrame(rows, "date date, ticker int, y_true double")
    many = some.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("_k", F.concat_ws("|", "draw", "ticker"))
    noise = many.withColumn("x", placebos.normal(placebos.draw(F.lit(5), F.col("_k"), F.col("date"))))
    ics = xs.rank_ic(placebos.block_surrogate(noise, "_k", 10, 5), "y_true", "surrogate", ["draw", "date"]).groupBy("draw").agg(F.avg("ic").alias("m"))
    want = ics.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("se")).first()
    out = cells.null_spread(some, 3, 10, 5)
    got = out.first()
    assert (got["dates"], got["rows"]) == (45, len(rows)) and got["mean"] == pytest.approx(want["mean"]) and got["se"] == pytest.approx(want["se"])
    assert "_from" not in out._jdf.queryExecution().analyzed().toString()  # no join of every drawn row


@pytest.mark.parametrize("name", ["gate_driver", "panel_grades", "pooled_trees"])
def test_what_is_read_several_times_is_written_once(spark, monkeypatch, name):
    seen, kept = [], pooling.written
    for module in (study, grades.grading, pooled):
        monkeypatch.setattr(module, "written", lambda df: seen.append(df.columns) or kept(df))
    if name == "pooled_trees":
        rows = [(d, t, float(i % 5), float((i + t) % 9)) for t in range(12) for i, d in enumerate(_days(90))]
        pooled.walk_forward(spark.createDataFrame(rows, "date date, ticker int, x double, target double").withColumn("y_raw", F.col("target")), ["x"], n_folds=1, min_train=40, horizon=5, params={"maxIter": 1, "maxDepth": 1}).collect()
    else:
        catalog.queries()[name](spark, SF)
    assert seen
    assert quality and len(seen) == {"gate_driver": 1, "panel_grades": 3, "pooled_trees": 1}[name]
