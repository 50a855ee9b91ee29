"""Filings, runs, forecasts and names: picks of one row, counts over a domain, guards on deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_disclosures(filings: DataFrame, keys: list[str]) -> DataFrame:
    """The first filing of each key: originals before revisions, then the earliest; filings never disclosed do not count."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("revised", "disclosed", "filing_id"))
    return filings.filter("disclosed is not null").withColumn("_n", n).filter("_n = 1").drop("_n")


def pick_announcements(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: consolidated with a finite surprise, else standalone with one, else the first disclosure with null in place
    of surprise and basis. A filing without a disclosure comes after all others."""
    finite = F.col("sue").isNotNull() & ~F.isnan("sue") & (F.abs("sue") != float("inf"))
    order = F.when(finite & (F.col("basis") == "consolidated"), 0).when(finite, 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col("disclosed").asc_nulls_last(), "filing_id"))
    picked = table.withColumn("_ok", finite).withColumn("_n", n).filter("_n = 1")
    return picked.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("sue", "basis")}).drop("_n", "_ok")


def structural_breaks(actions: DataFrame, curated: DataFrame) -> DataFrame:
    """symbol, day: demergers of the actions and curated mergers."""
    return actions.filter("kind = 'demerger'").select("symbol", "day").union(curated.select("symbol", "day")).distinct()


def merge_splits(primary: DataFrame, second: DataFrame, days: int = 5) -> DataFrame:
    """Primary actions and those splits of a second source that no primary bonus or split is near (symbol, day, kind, factor);
    symbols that the primary source does not know stay out. The near days are unrolled, so the anti join is an equi-join."""
    near = primary.filter(F.col("kind").isin("bonus", "split")).select("symbol", F.explode(F.sequence(F.date_add("day", -days), F.date_add("day", days))).alias("day")).distinct()
    more = second.join(primary.select("symbol").distinct(), "symbol", "left_semi").join(near, ["symbol", "day"], "left_anti")
    return primary.select("symbol", "day", "kind", "factor").union(more.select("symbol", "day", F.lit("split_yf"), "factor"))


def counts_over(df: DataFrame, c: str, domain: list[str]) -> DataFrame:
    """Rows of each value of a fixed domain, zeros included."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{c} string")
    return values.join(df.groupBy(c).agg(F.count("*").alias("n")), c, "left").select(c, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prune(stored: DataFrame, universe: DataFrame, key: str, most: float = 0.25) -> DataFrame:
    """Stored rows of the universe; raises if that would delete more than ``most`` of them, or if the universe is empty."""
    gone, n = stored.join(universe.select(key).distinct(), key, "left_anti").count(), stored.count()
    if universe.isEmpty() or gone > most * n:
        raise ValueError(f"{gone} of {n} rows lie outside the universe: refused")
    return stored.join(universe.select(key).distinct(), key, "left_semi")


def assert_coverage(returned: DataFrame, asked: DataFrame, key: str, least: float = 0.5) -> None:
    """Raise if fewer than ``least`` of the asked keys came back."""
    n = asked.select(key).distinct().count()
    m = returned.join(asked.select(key).distinct(), key, "left_semi").select(key).distinct().count()
    if m < least * n:
        raise ValueError(f"{m} of {n} keys returned: refused")


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, key: str, n: int, clamp: tuple[int, int] = (1, 2000)) -> DataFrame:
    """The last n rows in time of each key, n clamped, in ascending order of the ``pos`` that it adds (1 is the oldest)."""
    n = min(max(n, clamp[0]), clamp[1])
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col("date").desc()))
    kept = df.withColumn("_b", back).filter(F.col("_b") <= n).drop("_b")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("date")))


def largest_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n keys that have most rows, ties to the smaller key."""
    top = df.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    return df.join(top, key, "left_semi")


def rotating_sample(universe: DataFrame, key: str, day: Column, size: int) -> DataFrame:
    """``size`` keys of a sorted universe, the window moving on by its size each day and around the end."""
    ranked = universe.select(key).distinct().withColumn("_r", F.row_number().over(Window.orderBy(key)) - 1)  # the universe is metadata
    total = ranked.agg(F.count("*").alias("_n"))
    start = F.pmod(F.unix_date(day) * F.lit(size), F.col("_n"))
    return ranked.join(total).filter(F.pmod(F.col("_r") - start, F.col("_n")) < size).select(key)


def resumable(windows: DataFrame, log: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Windows that no ``ok`` entry of the log completes, and those whose latest entry is not ok."""
    done = log.filter("status = 'ok'").select(*keys).distinct()
    blocked = log.groupBy(*keys).agg(F.max_by("status", "seq").alias("status")).filter("status <> 'ok'")
    return windows.join(done, keys, "left_anti"), blocked


def month_windows(start: Column, end: Column) -> Column:
    """Calendar-month windows clipped to the range: array of (start, end); null if the range is empty."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end"))))


def split_windows(counts: DataFrame, cap: int = 100, rounds: int = 12) -> DataFrame:
    """Windows in which fewer than ``cap`` rows lie, by halving saturated ones down to one day: key, start, end, n, saturated.

    counts: key, date, n (rows of a day). A round halves every window that is still saturated; totals come from prefix sums,
    so a window costs two look-ups and nothing is fetched again."""
    w = Window.partitionBy("key").orderBy("date")
    cum = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = cum.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("date", "upto"))).alias("days"))  # one entry a day of a key
    upto = lambda day: F.coalesce(F.element_at(F.filter("days", lambda d: d["date"] <= day), -1)["upto"], F.lit(0))
    total = lambda a, b: upto(b) - F.when(F.size(F.filter("days", lambda d: d["date"] < a)) > 0, F.element_at(F.filter("days", lambda d: d["date"] < a), -1)["upto"]).otherwise(0)
    open_ = days.select("key", "days", F.col("days")[0]["date"].alias("start"), F.element_at("days", -1)["date"].alias("end"))
    level = lambda d: d.withColumn("n", total(F.col("start"), F.col("end")))
    done = []
    open_ = level(open_)
    for _ in range(rounds):
        again = (F.col("n") >= cap) & (F.col("start") < F.col("end"))
        done.append(open_.filter(~again).select("key", "start", "end", "n"))
        mid = F.date_add("start", F.floor(F.datediff("end", "start") / 2).cast("int"))
        halves = F.array(F.struct(F.col("start").alias("start"), mid.alias("end")), F.struct(F.date_add(mid, 1).alias("start"), F.col("end").alias("end")))
        open_ = level(open_.filter(again).select("key", "days", F.explode(halves).alias("h")).select("key", "days", "h.start", "h.end"))
    out = reduce(DataFrame.union, [*done, open_.select("key", "start", "end", "n")])
    return out.withColumn("saturated", F.col("n") >= cap)


def aliases(name: Column, symbol: Column, core: Column, ambiguous: list[str]) -> Column:
    """Distinct names of a company, longest first: full, core, and the symbol if it is three letters or more and not ambiguous."""
    plain = F.when(symbol.rlike("^[A-Za-z]{3,}$") & ~symbol.isin(ambiguous), symbol)
    some = F.array_distinct(F.filter(F.array(name, core, plain), lambda x: x.isNotNull() & (x != "")))
    return F.transform(F.array_sort(F.transform(some, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def search_query(name: Column, symbol: Column, core: Column, ambiguous: list[str]) -> Column:
    """The full name of an ambiguous symbol's company, else its core name."""
    return F.concat(F.lit('"'), F.when(symbol.isin(ambiguous), name).otherwise(core), F.lit('"'))


def real(x: Column) -> Column:
    """A double through a single-precision column and its shortest text."""
    return x.cast("float").cast("string").cast("double")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two sets of keys, of what both hold, and the share of that in their union."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"), F.count("*").alias("n"))
    return j.select("n_a", "n_b", "both", (F.col("both") / F.nullif(F.col("n"), F.lit(0))).alias("jaccard"))
