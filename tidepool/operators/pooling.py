"""Random-effects pooling and symbol histories."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reml_tau2(effects: DataFrame, x: str, var: str, rounds: int = 200, tolerance: float = 1e-12) -> float:
    """Restricted maximum-likelihood heterogeneity by fixed-point steps; each step is one aggregation of the effects."""
    rows = effects.filter(F.col(x).isNotNull() & (F.col(var) > 0)).select(F.col(x).cast("double").alias("x"), F.col(var).cast("double").alias("v")).cache()
    try:
        tau2 = 0.0
        for _ in range(rounds):
            w = 1 / (F.col("v") + F.lit(tau2))
            s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * w).alias("w2"), F.count("*").alias("k")).first()
            if s["k"] < 2:
                return 0.0
            mean = s["wx"] / s["w"]
            num = rows.agg(F.sum(w * w * ((F.col("x") - F.lit(mean)) ** 2 - F.col("v")))).first()[0]
            new = max(0.0, num / s["w2"] + 1 / s["w"])
            if abs(new - tau2) < tolerance:
                return new
            tau2 = new
        return tau2
    finally:
        rows.unpersist()


def pooled_interval(effects: DataFrame, x: str, var: str, tau2: float, t_quantile: float) -> DataFrame:
    """k, mean, low, high with the Hartung-Knapp-Sidik-Jonkman variance; t_quantile is Student's with k - 1 degrees of freedom."""
    w = 1 / (F.col(var) + F.lit(tau2))
    mean = effects.agg(F.count("*").alias("k"), F.sum(w).alias("sw"), (F.sum(w * F.col(x)) / F.sum(w)).alias("mean"))  # one row
    spread = effects.join(mean).groupBy("k", "sw", "mean").agg(F.sum(w * (F.col(x) - F.col("mean")) ** 2).alias("q"))
    half = F.lit(t_quantile) * F.sqrt(F.col("q") / F.nullif((F.col("k") - 1) * F.col("sw"), F.lit(0.0)))
    return spread.select("k", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{named.rstrip('/')}/tidepool-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def symbol_intervals(changes: DataFrame, longest: int | None = None, start: str = "1900-01-01", forever: str = "9999-12-31") -> DataFrame:
    """symbol (the newest), used, valid_from, valid_to (exclusive) from renames (old, new, day), each chain walked back.

    A step joins every open chain to the rename before it, until none is open; a chain that comes back to one of its own
    symbols stops there. ``longest`` bounds the steps only where a caller names it. Each step is written, so plans stay short.
    """
    first, last = F.lit(start).cast("date"), F.lit(forever).cast("date")
    newest = changes.select(F.col("new").alias("symbol")).distinct().join(changes.select(F.col("old").alias("symbol")).distinct(), "symbol", "left_anti")
    front = newest.select("symbol", F.col("symbol").alias("used"), last.alias("valid_to"), F.array("symbol").alias("seen"))
    out, steps = None, 0
    while longest is None or steps < longest:
        steps += 1
        before = changes.select(F.col("old").alias("_old"), F.col("new").alias("used"), F.col("day").alias("_day"))
        step = front.join(before, "used", "left").withColumn("_ok", F.col("_old").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("_old")), F.lit(False)) & (F.col("_day") < F.col("valid_to")))
        step = written(step)
        row = step.select("symbol", "used", F.when(F.col("_ok"), F.col("_day")).otherwise(first).alias("valid_from"), "valid_to")
        out = row if out is None else out.union(row)
        front = step.filter("_ok").select("symbol", F.col("_old").alias("used"), F.col("_day").alias("valid_to"), F.concat("seen", F.array("_old")).alias("seen"))
        if front.isEmpty():
            break
    return out.distinct()


def parse_holidays(payload: DataFrame, column: str = "json") -> DataFrame:
    """segment, date, description from a calendar's JSON, an object of lists by segment with dates like 26-Jan-2024."""
    kind = "map<string,array<struct<tradingDate:string,description:string>>>"
    rows = payload.select(F.explode(F.from_json(F.col(column), kind)).alias("segment", "days")).select("segment", F.explode("days").alias("d"))
    return rows.select("segment", F.to_date(F.try_to_timestamp("d.tradingDate", F.lit("dd-MMM-yyyy"))).alias("date"), F.col("d.description").alias("description")).filter("date is not null")


def parse_flows(payload: DataFrame, column: str = "json") -> DataFrame:
    """date, category and net from a JSON list of flows whose numbers hold commas; rows without a number go."""
    kind = "array<struct<category:string,date:string,netValue:string>>"
    rows = payload.select(F.explode(F.from_json(F.col(column), kind)).alias("r"))
    net = F.regexp_replace("r.netValue", ",", "").try_cast("double")
    return rows.select(F.to_date(F.try_to_timestamp("r.date", F.lit("dd-MMM-yyyy"))).alias("date"), F.lower(F.regexp_extract("r.category", "^([A-Za-z]+)", 1)).alias("category"), net.alias("net")).filter("net is not null")
