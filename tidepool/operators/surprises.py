"""Earnings surprises as they were known at each disclosure, on one share basis, and what prices did at the announcement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import crosssection as xs
from tidepool.operators.announcements import share_factors, usable_sessions
from tidepool.operators.joins import asof_backward
from tidepool.operators.pooling import written
from tidepool.operators.records import pick_announcements
from tidepool.sources.tables import deal

_KEYS = ["ticker", "basis", "period_end"]


def straddled(breaks: DataFrame) -> DataFrame:
    """ticker, period_end: quarter ends whose year, from a year before (exclusive) to the quarter's end, holds a break (ticker, day)."""
    first = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.last_day(F.add_months(first, 3 * k)))
    return breaks.select("ticker", F.explode(ends).alias("period_end")).distinct()


def point_in_time_surprises(quarters: DataFrame, actions: DataFrame, breaks: DataFrame, most: int = 8, least: int = 4, tasks: int | None = None) -> DataFrame:
    """Every quarter (ticker, basis, period_end, eps, disclosed) with diff, sigma, n_sigma and sue, as of its own disclosure.

    Earnings of other quarters count only if they were disclosed strictly before, and all are restated to the shares of the
    quarter's disclosure by actions (ticker, ex_date, kind, factor) that were ex by then. A difference is on the quarter a year
    before and void where a break (ticker, day) lies between. sue is the quarter's difference over the sample deviation of the
    ``most`` before it, of which ``least`` must exist. Of several rows for one quarter the first disclosed counts; rows without
    earnings or disclosure go. The twelve quarters that a quarter's figures can need come by windows of months over its own series,
    so no rows are made for them. ``tasks``: to how many tasks the rows are dealt (the session's number by default).
    """
    one = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("disclosed", "eps"))
    known = quarters.filter(F.col("eps").isNotNull() & ~F.isnan("eps") & F.col("disclosed").isNotNull()).select(*_KEYS, "eps", "disclosed").withColumn("_n", one).filter("_n = 1").drop("_n")
    splits = actions.filter(F.col("kind").isin("bonus", "split", "split_yf")).select("ticker", "ex_date", "factor")
    known = share_factors(known.withColumn("_day", F.to_date("disclosed")), splits, "_day", tasks).drop("_day")
    known = deal(known, tasks, "ticker", "period_end").join(straddled(breaks).withColumn("_void", F.lit(True)), ["ticker", "period_end"], "left")
    month = F.year("period_end") * 12 + F.month("period_end")
    there = F.when(F.col("period_end") == F.last_day("period_end"), F.struct("eps", "factor", F.col("disclosed").alias("d"), "_void"))  # one a month
    before = Window.partitionBy("ticker", "basis").orderBy("_month")
    met = deal(known, tasks, "ticker", "basis").withColumns({"_month": month, "_there": there})
    met = met.withColumns({f"_q{k}": F.max("_there").over(before.rangeBetween(-3 * k, -3 * k)) for k in range(most + 5)})
    seen = lambda k, x: x if k == 0 else F.when(F.col(f"_q{k}.d") < F.col("disclosed"), x)
    wide = met.withColumns({f"_a{k}": seen(k, F.col(f"_q{k}.eps") * F.col(f"_q{k}.factor") / F.col("factor")) for k in range(most + 5)} | {f"_v{k}": seen(k, F.col(f"_q{k}._void")) for k in range(most + 1)})
    diff = [F.when(F.col(f"_v{k}").isNull(), F.col(f"_a{k}") - F.col(f"_a{k + 4}")) for k in range(most + 1)]
    wide = wide.select(*_KEYS, "eps", "disclosed", diff[0].alias("diff"), F.filter(F.array(*diff[1:]), lambda x: x.isNotNull()).alias("_p")).withColumn("n_sigma", F.size("_p"))
    mean = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.col("n_sigma"), F.lit(0))
    wide = wide.withColumn("_m", mean)
    square = F.aggregate("_p", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m")))
    wide = wide.withColumn("sigma", F.when(F.col("n_sigma") >= least, F.sqrt(square / (F.col("n_sigma") - 1))))
    return wide.select(*_KEYS, "eps", "disclosed", "diff", "sigma", "n_sigma", (F.col("diff") / F.when(F.col("sigma") > 0, F.col("sigma"))).alias("sue"))


def announced(surprises: DataFrame) -> DataFrame:
    """One row a ticker and quarter: the consolidated surprise where there is one, else the standalone one, else the first disclosure without."""
    return pick_announcements(surprises.withColumn("filing_id", F.col("basis")), ["ticker", "period_end"]).select("ticker", "period_end", "basis", "disclosed", "sue")


def event_features(sessions: DataFrame, events: DataFrame, live: int = 30, cap: int = 63) -> DataFrame:
    """Per (ticker, date, pos): sue_evt, sue_age, sue_missing and sue_ffill of what had become usable by the session.

    events: ticker, pos of the usable session, sue. sue_evt is the latest announcement's surprise for ``live`` sessions and 0
    after, null where it has none; sue_age counts sessions up to ``cap``, null before the first; sue_missing is 1 where the
    latest announcement has no surprise or there is none; sue_ffill carries the last surprise that exists without an end.
    """
    a = events.select("ticker", F.col("pos").alias("_pos"), F.struct(F.col("sue").alias("v")).alias("_one"))
    with_sue = events.filter("sue is not null").select("ticker", F.col("pos").alias("_was"), F.col("sue").alias("sue_ffill"))
    found = asof_backward(sessions, a, by=["ticker"], left_on="pos", right_on="_pos", values=["_one"])
    found = asof_backward(found, with_sue, by=["ticker"], left_on="pos", right_on="_was", values=["sue_ffill"]).drop("_was")
    age, sue = F.col("pos") - F.col("_pos"), F.col("_one.v")
    evt = F.when(F.col("_pos").isNotNull() & sue.isNotNull(), F.when(age < live, sue).otherwise(0.0))
    return found.select("ticker", "date", "pos", evt.alias("sue_evt"), F.when(age.isNotNull(), F.least(age, F.lit(cap))).cast("double").alias("sue_age"), sue.isNull().cast("double").alias("sue_missing"), "sue_ffill")


def attach_standardised(panel: DataFrame, features: DataFrame, names: list[str], imputed: list[str] = ()) -> DataFrame:
    """``panel`` with features joined by (date, ticker) and standardised within the date; ``imputed`` ones take the date's median for nulls first."""
    for c in imputed:
        features = xs.impute_median(features, c, c)
    out = panel.join(features.select("date", "ticker", *names), ["date", "ticker"], "left")
    for c in names:
        out = xs.zscore(out, c, c)
    return out


def announcement_returns(events: DataFrame, splits: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker, period_end, sue, ann_ret, sessions, year: a name's return less the market's from the last session before an
    announcement's day to the first at whose close it was public.

    events: ticker, period_end, sue, disclosed; without a surprise they go, and so do those that a split (ticker, ex_date) falls
    into, those before the first session and those of names without a price at either end. The market is each session's mean of
    log returns on the session before.
    """
    bars = written(bars.select("ticker", "date", "close"))  # read several times, as are the events
    days = bars.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # one row a session
    priced = bars.join(days, "date").select("ticker", "pos", F.log("close").alias("p"))
    w = Window.partitionBy("ticker").orderBy("pos")
    step = priced.withColumn("r", F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.col("p") - F.lag("p").over(w)))
    market = step.groupBy("pos").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("m")).withColumn("cum", F.sum("m").over(Window.orderBy("pos")))  # one row a session
    some = written(events.filter("sue is not null"))
    to = usable_sessions(some, days.select("date"), "disclosed").filter("session is not null").withColumn("_day", F.to_date("disclosed"))
    asked = to.select(F.lit(1).alias("_all"), "_day").distinct()  # one row a day, whatever the number of announcements
    back = asof_backward(asked, days.select(F.lit(1).alias("_all"), F.col("date").alias("d0"), F.col("pos").alias("i0")), by=["_all"], left_on="_day", right_on="d0", values=["i0"], strict=True)
    span = to.join(F.broadcast(back.filter("i0 is not null").drop("_all")), "_day").join(days.select(F.col("date").alias("session"), F.col("pos").alias("i1")), "session").filter("i1 > i0")
    so_far = splits.select("ticker", "ex_date").groupBy("ticker", "ex_date").agg(F.count("*").alias("_c"))
    so_far = so_far.select("ticker", "ex_date", F.sum("_c").over(Window.partitionBy("ticker").orderBy("ex_date")).alias("_s"))
    for end, name in (("d0", "_s0"), ("session", "_s1")):
        span = asof_backward(span, so_far, by=["ticker"], left_on=end, right_on="ex_date", values=["_s"]).withColumnRenamed("_s", name).drop("ex_date")
    whole = span.filter(F.coalesce("_s0", F.lit(0)) == F.coalesce("_s1", F.lit(0)))
    at = lambda k: priced.select("ticker", F.col("pos").alias(f"i{k}"), F.col("p").alias(f"p{k}"))
    level = lambda k: market.select(F.col("pos").alias(f"i{k}"), F.col("cum").alias(f"c{k}"))
    out = whole.join(at(0), ["ticker", "i0"]).join(at(1), ["ticker", "i1"]).join(level(0), "i0").join(level(1), "i1")
    return out.select("ticker", "period_end", "sue", (F.col("p1") - F.col("p0") - F.col("c1") + F.col("c0")).alias("ann_ret"), (F.col("i1") - F.col("i0")).alias("sessions"), F.year("session").alias("year"))
