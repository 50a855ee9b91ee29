"""The data-quality gate: relational checks, each one row (check, n_bad, status), and audits of silent defaults."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators import statistics
from tidepool.operators.windows import by_ticker
from tidepool.sources.tables import deal


def _verdict(name: str, bad: DataFrame, worst: str = "FAIL") -> DataFrame:
    n = F.count("*")
    return bad.agg(n.alias("n_bad")).select(F.lit(name).alias("check"), "n_bad", F.when(F.col("n_bad") > 0, worst).otherwise("PASS").alias("status"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    return _verdict("duplicate_keys", df.groupBy("ticker", "date").count().filter("count > 1"))


def future_dates(df: DataFrame, today: str) -> DataFrame:
    return _verdict("future_dates", df.filter(F.col("date") > F.lit(today).cast("date")))


def stale(df: DataFrame, today: str, days: int = 6) -> DataFrame:
    return _verdict("stale", df.agg(F.max("date").alias("d")).filter(F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("d")) > days, F.lit(True))))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return _verdict("not_finite", df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) | F.coalesce(F.isnan(c), F.lit(False)) for c in columns])))


def price_breaks(df: DataFrame, actions: DataFrame, size: float = 0.35, days: int = 4) -> DataFrame:
    """Log moves beyond ``size`` without a corporate action of the ticker within so many days: a warning.

    The days near an action are unrolled, so the anti join is an equi-join and no pairs of a ticker's rows are made."""
    moves = df.withColumn("r", F.log(F.col("close") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0)))).filter(F.abs("r") > size).select("ticker", "date")
    near = actions.select("ticker", F.explode(F.sequence(F.date_add("date", -days), F.date_add("date", days))).alias("date")).distinct()
    return _verdict("price_breaks", moves.join(near, ["ticker", "date"], "left_anti"), "WARN")


def label_coverage(df: DataFrame, universe: DataFrame, label: str, least: int) -> DataFrame:
    """Names of the universe with too few labels."""
    have = df.groupBy("ticker").agg(F.count(label).alias("n"))
    return _verdict("label_coverage", universe.join(have, "ticker", "left").filter(F.coalesce("n", F.lit(0)) < least))


def contiguous(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per ticker the sessions of the calendar inside its span that it lacks: ticker, expected, stored, gap."""
    pos = calendar.withColumn("pos", F.row_number().over(Window.orderBy("date")))
    own = df.select("ticker", "date").distinct().join(F.broadcast(pos), "date")  # pos has one row a session
    return own.groupBy("ticker").agg((F.max("pos") - F.min("pos") + 1).cast("long").alias("expected"), F.count("*").alias("stored")).withColumn("gap", F.col("expected") - F.col("stored"))


def flat_days(df: DataFrame, share: float = 0.9, least: int = 10) -> DataFrame:
    """Dates on which nearly all of at least ``least`` names have open = high = low = close."""
    flat = F.avg(((F.col("open") == F.col("close")) & (F.col("high") == F.col("low"))).cast("double"))
    return df.groupBy("date").agg(F.count("*").alias("names"), flat.alias("flat_share")).filter((F.col("names") >= least) & (F.col("flat_share") >= share))


def silent_neutral(df: DataFrame, c: str, neutral: float = 0.0) -> DataFrame:
    """Shares of nulls, of the neutral value and of the modal value, and the number of tickers with one value only."""
    n = df.agg(F.count("*").alias("rows"), F.avg(F.col(c).isNull().cast("double")).alias("null_share"), F.avg(F.coalesce((F.col(c) == neutral).cast("double"), F.lit(0.0))).alias("neutral_share"))
    mode = df.filter(F.col(c).isNotNull()).groupBy(c).count().agg(F.max("count").alias("modal_rows"))
    flat = df.groupBy("ticker").agg(F.countDistinct(c).alias("k")).agg(F.sum((F.col("k") <= 1).cast("long")).alias("constant_tickers"))
    return n.join(mode).join(flat)  # one row each


def benchmark_coverage(df: DataFrame, universe: DataFrame, c: str) -> DataFrame:
    """Names of the universe without any value of the benchmark."""
    have = df.groupBy("ticker").agg(F.count(c).alias("n"))
    return _verdict("benchmark_coverage", universe.join(have, "ticker", "left").filter(F.coalesce("n", F.lit(0)) == 0))


def distribution(df: DataFrame, c: str, limit: float) -> DataFrame:
    """n, sd, q01, q99 (exact, interpolated) and how many values lie beyond the limit on either side."""
    x = df.filter(F.col(c).isNotNull())
    out = x.agg(F.count("*").alias("n"), F.stddev_samp(c).alias("sd"), F.coalesce(F.sum((F.abs(c) > limit).cast("long")), F.lit(0)).alias("beyond")).join(statistics.quantiles(x, c, [0.01, 0.99]))  # one row each
    return out.select("n", F.round("sd", 6).alias("sd"), F.round(F.col("q")[0], 6).alias("q01"), F.round(F.col("q")[1], 6).alias("q99"), "beyond")


def panel_checks(bars: DataFrame, labelled: DataFrame, universe: DataFrame, actions: DataFrame, today: str, least_labels: int, tasks: int | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The gate's checks by name, each a function without arguments that gives one row. ``tasks``: to how many tasks rows are dealt by ticker."""
    sessions, own = bars.select("date").distinct(), deal(bars, tasks, "ticker")
    lone = deal(labelled.filter("roc is not null").select("ticker", "roc"), tasks, "ticker").groupBy("ticker").agg(F.count_distinct("roc").alias("n")).filter("n = 1")
    return {
        "duplicate_keys": lambda: duplicate_keys(own), "future_dates": lambda: future_dates(bars, today), "stale": lambda: stale(bars, today),
        "finite_features": lambda: not_finite(labelled, ["roc"]), "label_coverage": lambda: label_coverage(labelled, universe, "target", least_labels),
        "benchmark_coverage": lambda: benchmark_coverage(labelled, universe, "roc"), "price_breaks": lambda: price_breaks(own, actions),
        "target_distribution": lambda: _verdict("target_distribution", labelled.filter(F.abs("target") > 1.5), "WARN"),
        "sessions_contiguous": lambda: _verdict("sessions_contiguous", contiguous(own, sessions).filter("gap > 0")),
        "flat_days": lambda: _verdict("flat_days", flat_days(bars)), "silent_neutrals": lambda: _verdict("silent_neutrals", lone, "WARN"),
    }


def drive(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run every check to its end; one that raises is a FAIL with one bad row and does not stop the others. One row a check."""
    found = []
    for name, check in checks.items():
        try:
            r = check().first()
            found.append((name, int(r["n_bad"]), r["status"]))
        except (PySparkException, ValueError, KeyError, TypeError):
            found.append((name, 1, "FAIL"))
    return spark.createDataFrame(found, "check string, n_bad long, status string")


def status_lists(report: DataFrame) -> DataFrame:
    """Names of the failed checks and of the warnings, comma-joined; null where there are none."""
    names = lambda s: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check")))), ","), F.lit(""))
    one = report.agg(names("FAIL").alias("failures"), names("WARN").alias("warnings"))
    return one.select(F.explode(F.array(F.struct(F.lit("failures").alias("list"), F.col("failures").alias("checks")), F.struct(F.lit("warnings").alias("list"), F.col("warnings").alias("checks")))).alias("x")).select("x.*")


def run_gate(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
