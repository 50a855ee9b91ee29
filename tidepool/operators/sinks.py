"""Writes that keep what they must: window replace, label-loss guard, interval sync, upserts with a revision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class RefusedWrite(RuntimeError):
    """A write that would lose rows; the old rows stay."""


def replace_window(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows before each ticker's first new date, then the new rows; tickers without new rows keep theirs."""
    first = new.groupBy("ticker").agg(F.min("date").alias("_first"))
    kept = old.join(first, "ticker", "left").filter(F.col("_first").isNull() | (F.col("date") < F.col("_first"))).select(*old.columns)
    return kept.unionByName(new)


def label_losses(old: DataFrame, new: DataFrame, labels: list[str]) -> DataFrame:
    """Tickers whose replaced range would hold fewer labels than before: ticker, label, before, after."""
    first = new.groupBy("ticker").agg(F.min("date").alias("_first"))
    held = old.join(first, "ticker").filter(F.col("date") >= F.col("_first"))
    count = lambda df, name: df.groupBy("ticker").agg(*[F.count(c).alias(c) for c in labels]).unpivot(["ticker"], labels, "label", name)
    both = count(held, "before").join(count(new, "after"), ["ticker", "label"], "left").fillna(0, ["after"])
    return both.filter(F.col("after") < F.col("before"))


def guarded_replace(old: DataFrame, new: DataFrame, labels: list[str]) -> DataFrame:
    lost = label_losses(old, new, labels)
    if not lost.isEmpty():
        raise RefusedWrite(f"labels would be lost: {lost.orderBy('ticker').limit(5).collect()}")
    return replace_window(old, new)


def sync_intervals(intervals: DataFrame, members: DataFrame, as_of: Column, forever: str = "9999-12-31") -> DataFrame:
    """Close the open interval of each name that left at ``as_of`` and open one for each that joined."""
    end = F.lit(forever).cast("date")
    is_open = F.col("effective_to") == end
    now = members.select("ticker").distinct().withColumn("_in", F.lit(True))
    closed = intervals.join(now, "ticker", "left").withColumn("effective_to", F.when(is_open & F.col("_in").isNull(), as_of).otherwise(F.col("effective_to"))).drop("_in")
    joined = now.join(intervals.filter(is_open).select("ticker"), "ticker", "left_anti").select("ticker", as_of.alias("effective_from"), end.alias("effective_to"))
    return closed.select("ticker", "effective_from", "effective_to").unionByName(joined)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    both = old.unionByName(new).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return both.filter("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def revisions(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Fields that moved: keys, field, old_value, new_value; a null against a value is a change."""
    long = lambda df, name: df.select(*keys, *[F.col(c).cast("double").alias(c) for c in fields]).unpivot(keys, fields, "field", name)
    both = long(old, "old_value").join(long(new, "new_value"), [*keys, "field"])
    a, b = F.col("old_value"), F.col("new_value")
    return both.filter((a.isNull() != b.isNull()) | (F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))))
