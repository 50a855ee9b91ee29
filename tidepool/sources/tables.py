"""Panel inputs read from columnar tables: bars, sectors, macro series, fundamentals, memberships and news."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items for which a shuffle of the panel has one task, where the session names fewer tasks.
ROWS_A_TASK = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks a shuffle of the panel needs so that none gets more as the table grows; None where the session's number will do."""
    n = ceil(table(spark, sf_dir, "lineitem").count() / ROWS_A_TASK)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def deal(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to n tasks, for the windows, groups and joins by them that follow; as it is where n is None."""
    return df.repartition(n, *keys) if n else df


def _cents(c: str) -> Column:
    """A sum of amounts in whole hundredths: exact, whatever the order of the rows."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (ticker, date, open, high, low, close, adj_close, volume) from line items: ticker is the supplier.

    Line items are dealt by supplier once, to as many tasks as the table needs; days and windows of a ticker need no other shuffle.
    """
    n, li = tasks(spark, sf_dir), table(spark, sf_dir, "lineitem").withColumn("ticker", F.col("l_suppkey"))
    li = deal(li, n, "ticker") if n else li.repartition("ticker")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    close = _cents("l_extendedprice") / _cents("l_quantity")
    return (li.groupBy("ticker", F.to_date("l_shipdate").alias("date"))
            .agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 close.alias("close"), (close * (1 + _cents("l_tax") / 100 / F.count("*") - _cents("l_discount") / 100 / F.count("*"))).alias("adj_close"),
                 (_cents("l_quantity") / 100).alias("volume")))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, company, sector: the supplier's nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("company"), F.col("n_name").alias("sector"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, level: mean order value of each day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((_cents("o_totalprice") / 100 / F.count("*")).alias("level"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, period_end, effective_date (60 days later), eps, book: yearly sums of a supplier."""
    li = table(spark, sf_dir, "lineitem")
    end = F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31))
    return (li.groupBy(F.col("l_suppkey").alias("ticker"), end.alias("period_end"))
            .agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_quantity")).alias("eps"), F.avg("l_extendedprice").alias("book"))
            .withColumn("effective_date", F.date_add("period_end", 60)))


def memberships(bars: DataFrame) -> DataFrame:
    """ticker, effective_from, effective_to: one interval from the first to the last bar; the end is open for the newest."""
    return bars.groupBy("ticker").agg(F.min("date").alias("effective_from"), F.max("date").alias("effective_to"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated scores: article_id, date, ticker, source, score from events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), F.to_date("ts").alias("date"), F.col("user_id").alias("ticker"),
                                                 F.col("event_type").alias("source"), F.col("value").alias("score"))
