"""More registered queries: writes, events, news windows, sampling and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import events
from tidepool.operators import crosssection as xs
from tidepool.operators import inference, sinks, statistics, windows
from tidepool.plans.catalog import DAY, HITS, LAB, MEM, PREDS, RET, W, labelled, query, rows, shown, sql_of
from tidepool.plans.extra import tested
from tidepool.sources import tables


@query(sql_of(f"""SELECT ticker, {DAY}, close, src FROM (SELECT b.ticker, b.date, b.close, 'old' AS src FROM bars b LEFT JOIN f USING (ticker) WHERE f.d IS NULL OR b.date < f.d
 UNION ALL SELECT ticker, date, adj_close, 'new' FROM bars WHERE year(date) >= 1997 AND ticker % 3 <> 0)""", "f AS (SELECT ticker, min(date) AS d FROM bars WHERE year(date) >= 1997 AND ticker % 3 <> 0 GROUP BY ticker)"))
def window_replace(spark, d):
    b = tables.bars(spark, d)
    old = b.select("ticker", "date", "close", F.lit("old").alias("src"))
    new = b.filter((F.year("date") >= 1997) & (F.col("ticker") % 3 != 0)).select("ticker", "date", F.col("adj_close").alias("close"), F.lit("new").alias("src"))
    return shown(sinks.replace_window(old, new), "ticker date src", "close", None)


@query(sql_of("""SELECT ticker, label, before, after FROM (SELECT ticker, 'target' AS label, count(target) FILTER (date >= DATE '1997-01-01') AS before, count(target) FILTER (date >= DATE '1997-01-01' AND volume < 60) AS after,
 count(*) FILTER (date >= DATE '1997-01-01' AND volume < 60) AS n FROM lab GROUP BY ticker) WHERE n > 0 AND after < before AND before > 0""", LAB))
def label_losses(spark, d):
    lab = labelled(spark, d)
    new = lab.filter("date >= '1997-01-01' and volume < 60")
    first = new.groupBy("ticker").agg(F.lit("1997-01-01").cast("date").alias("date")).withColumn("target", F.lit(None).cast("double"))  # the whole range is asked for
    return sinks.label_losses(lab.select("ticker", "date", "target"), new.select("ticker", "date", "target").unionByName(first), ["target"])


@query(sql_of("""SELECT ticker, CAST(effective_from AS VARCHAR) AS effective_from, CAST(CASE WHEN ticker % 4 = 0 THEN DATE '1999-01-31' ELSE DATE '9999-12-31' END AS VARCHAR) AS effective_to FROM mem WHERE ticker % 5 <> 0
 UNION ALL SELECT ticker, '1999-01-31', '9999-12-31' FROM mem WHERE ticker % 5 = 0 AND ticker % 4 <> 0""", MEM))
def membership_sync(spark, d):
    m = tables.memberships(tables.bars(spark, d))
    now = m.filter("ticker % 5 <> 0").withColumn("effective_to", F.lit("9999-12-31").cast("date"))
    return shown(sinks.sync_intervals(now, m.filter("ticker % 4 <> 0").select("ticker"), F.lit("1999-01-31").cast("date")), "ticker effective_from effective_to", "")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_latest(spark, d):
    e = tables.table(spark, d, "events").select("event_id", "user_id", "event_type")
    half = e.agg(F.max("event_id") / 2).first()[0]
    return sinks.upsert(e.filter(F.col("event_id") <= half), e.filter(F.col("event_id") > half), ["user_id", "event_type"], "event_id")


@query("""SELECT user_id, event_type FROM events WHERE value > 0 GROUP BY user_id, event_type EXCEPT SELECT user_id, event_type FROM events WHERE value > 100""")
def insert_ignore(spark, d):
    e = tables.table(spark, d, "events")
    return sinks.insert_ignore(e.filter("value > 100").select("user_id", "event_type"), e.filter("value > 0").select("user_id", "event_type"), ["user_id", "event_type"])


QUARTERS = "q AS (SELECT ticker, last_day(make_date(year(date), CAST(quarter(date) * 3 AS INT), 1)) AS period_end, round(avg(close) / 100, 4) AS eps FROM bars GROUP BY 1, 2)"


@query(sql_of("""SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, round(CASE WHEN n >= 4 THEN change / nullif(s, 0) END, 4) AS sue FROM (SELECT symbol, period_end, change, count(change) OVER w AS n, stddev_samp(change) OVER w AS s
 FROM (SELECT a.ticker AS symbol, a.period_end, a.eps - b.eps AS change FROM q a LEFT JOIN q b ON a.ticker = b.ticker AND a.period_end = last_day(b.period_end + INTERVAL 12 MONTH))
 WINDOW w AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))""", QUARTERS))
def seasonal_sue(spark, d):
    end = F.last_day(F.make_date(F.year("date"), (F.quarter("date") * 3).cast("int"), F.lit(1)))
    q = tables.bars(spark, d).groupBy(F.col("ticker").alias("symbol"), end.alias("period_end")).agg(F.round(F.avg("close") / 100, 4).alias("eps"))
    return shown(events.seasonal_surprise(q), "symbol period_end", "sue", 4)


_SUBJECT = """CASE p_partkey % 6 WHEN 0 THEN 'Bonus ' || p_size || ':' || (p_size % 7 + 1) WHEN 1 THEN 'Face Value Split From Rs.' || (p_size + 1) || '/- To Rs.2/-'
 WHEN 2 THEN 'Bonus 1:' || p_size || '/Face  Value Split (Sub-Division) - From Rs ' || (p_size * 2) || '/- Per Share To Re 1/- Per Share' WHEN 3 THEN 'Fv Split Rs.' || p_size || ' To Rs.5' WHEN 4 THEN 'Rights 1:' || p_size || ' @ Premium Rs 12' ELSE 'Demerger' END"""


@query(f"""WITH s AS (SELECT p_partkey, regexp_replace({_SUBJECT}, '\\s+', ' ', 'g') AS subject FROM part),
parts AS (SELECT p_partkey, unnest(string_split(regexp_replace(subject, '/(\\s*(bonus|face|fv|split))', chr(1) || '\\1', 'gi'), chr(1))) AS p FROM s),
f AS (SELECT p_partkey, CASE WHEN regexp_matches(p, '(?i)bonus\\s*\\d+\\s*:\\s*\\d+') THEN (TRY_CAST(regexp_extract(p, '(?i)bonus\\s*(\\d+)\\s*:\\s*(\\d+)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(p, '(?i)bonus\\s*(\\d+)\\s*:\\s*(\\d+)', 2) AS DOUBLE)) / TRY_CAST(regexp_extract(p, '(?i)bonus\\s*(\\d+)\\s*:\\s*(\\d+)', 2) AS DOUBLE)
 WHEN regexp_matches(p, '(?i)split|sub-division') THEN a[1] / nullif(a[2], 0) END AS x FROM (SELECT *, list_transform(regexp_extract_all(p, '(?i)R[se]\\.?\\s*(\\d+(?:\\.\\d+)?)', 1), lambda v: CAST(v AS DOUBLE)) AS a FROM parts))
SELECT p_partkey, round(product(x), 6) AS factor, CASE WHEN any_value(subject) = 'Demerger' THEN 'demerger' WHEN abs(product(x) - 1) > 1e-9 THEN CASE WHEN contains(any_value(subject), 'Bonus') THEN 'bonus' ELSE 'split' END END AS kind FROM f JOIN s USING (p_partkey) GROUP BY p_partkey""")
def action_factors(spark, d):
    subject = F.expr(_SUBJECT)
    return tables.table(spark, d, "part").select("p_partkey", F.round(events.action_factor(subject), 6).alias("factor"), events.action_kind(subject).alias("kind"))


@query("""WITH g AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)),
p AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, coalesce(stddev_samp(value), 0) AS sd FROM events GROUP BY 1, 2)
SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(sum(n) OVER w AS BIGINT) AS n30, CAST(sum(cents) OVER w AS DOUBLE) / 100 / (sum(n) OVER w) AS mean30, round(sqrt(greatest(0, sum(cents * cents / (10000.0::DOUBLE * n) + n * sd * sd) OVER w / (sum(n) OVER w)
 - (CAST(sum(cents) OVER w AS DOUBLE) / 100 / (sum(n) OVER w)) ** 2)), 4) AS dispersion FROM p JOIN g USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY pos RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def news_window_features(spark, d):
    """The last 30 sessions of the grid, whatever days a ticker had news on; the dispersion puts the sample deviation into the
    population identity n (mean^2 + sd^2), as the panel's definition does."""
    a = tables.articles(spark, d)
    grid = a.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # one row a date
    cents = F.sum(F.round(F.col("score") * 100).cast("long"))
    per = a.groupBy("ticker", "date").agg(F.count("*").alias("n"), cents.alias("cents"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s")).join(grid, "date")
    over = Window.partitionBy("ticker").orderBy("pos").rangeBetween(-29, 0)
    n, mean = F.sum("n").over(over), F.sum("cents").over(over).cast("double") / 100 / F.sum("n").over(over)
    second = F.sum(F.col("cents") * F.col("cents") / (F.lit(10000.0) * F.col("n")) + F.col("n") * F.col("s") * F.col("s")).over(over) / n
    out = per.withColumns({"n30": n, "mean30": mean, "dispersion": F.sqrt(F.greatest(F.lit(0.0), second - mean * mean))})
    return out.select("ticker", F.col("date").cast("string").alias("date"), "n30", "mean30", F.round("dispersion", 4).alias("dispersion"))


@query(sql_of(f"""SELECT ticker, {DAY}, round(abnormal, 6) AS abnormal, round(abnormal5, 6) AS abnormal5 FROM (SELECT ticker, date, CASE WHEN count(s) OVER a >= 40 THEN s - avg(s) OVER a END AS abnormal,
 CASE WHEN count(s) OVER a >= 40 AND count(s) OVER b >= 5 THEN avg(s) OVER b - avg(s) OVER a END AS abnormal5 FROM (SELECT ticker, date, lag(volume / (volume + 10)) OVER {W} AS s FROM bars) WINDOW a AS {rows(60)}, b AS {rows(5)})"""))
def delivery_style_abnormal(spark, d):
    s = tables.bars(spark, d).withColumn("s", F.lag(F.col("volume") / (F.col("volume") + 10)).over(windows.by_ticker()))
    mean = lambda n, least: F.when(F.count("s").over(windows.rows(n)) >= least, F.avg("s").over(windows.rows(n)))
    return shown(s.withColumns({"abnormal": F.col("s") - mean(60, 40), "abnormal5": mean(5, 5) - mean(60, 40)}), "ticker date", "abnormal abnormal5")


@query(sql_of(f"""SELECT ticker, {DAY}, round(ret_5 - m5, 6) AS rel_5, round(ret_20 - m20, 6) AS rel_20 FROM (SELECT *, avg(ret_5) OVER (PARTITION BY date) AS m5, avg(ret_20) OVER (PARTITION BY date) AS m20
 FROM (SELECT ticker, date, close / lag(close, 5) OVER {W} - 1 AS ret_5, close / lag(close, 20) OVER {W} - 1 AS ret_20 FROM bars))"""))
def relative_momentum(spark, d):
    r = windows.lag_returns(tables.bars(spark, d), (5, 20))
    day = Window.partitionBy("date")
    return shown(r.withColumns({f"rel_{k}": F.col(f"ret_{k}") - F.avg(f"ret_{k}").over(day) for k in (5, 20)}), "ticker date", "rel_5 rel_20")


@query(sql_of("""SELECT h, round(avg(t), 6) AS mean, count(t) AS n FROM (""" + " UNION ALL ".join(f"SELECT {h} AS h, lead(ln(close), {h}) OVER {W} - ln(close) AS t FROM bars" for h in (5, 10, 30, 60)) + ") GROUP BY h"))
def retarget_horizon(spark, d):
    b = tables.bars(spark, d)
    wide = b
    for h in (5, 10, 30, 60):
        wide = windows.forward_label(wide, h, into=str(h))
    long = wide.unpivot(["ticker"], ["5", "10", "30", "60"], "h", "t")
    return long.groupBy(F.col("h").cast("int").alias("h")).agg(F.round(F.avg("t"), 6).alias("mean"), F.count("t").alias("n"))


@query(sql_of("""SELECT ticker, n, round(hit, 6) AS hit, round(greatest(0, (hit + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hit * (1 - hit) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low FROM hits""", LAB, HITS))
def hit_intervals(spark, d):
    hit = F.avg((F.col("target") > 0).cast("double"))
    per = labelled(spark, d).filter("target is not null").groupBy("ticker").agg(F.count("*").alias("n"), hit.alias("hit"))
    low, _ = statistics.wilson(F.col("hit") * F.col("n"), F.col("n"))
    return shown(per.withColumn("low", low), "ticker n", "hit low")


@query(sql_of("""SELECT ticker, round(b * m + (1 - b) * x, 6) AS theta FROM (SELECT ticker, x, m, v / (v + 0.01) AS b FROM (SELECT ticker, avg(target) AS x, var_samp(target) / count(target) AS v FROM lab WHERE target IS NOT NULL GROUP BY ticker),
 (SELECT avg(target) AS m FROM lab))""", LAB))
def shrinkage(spark, d):
    lab = labelled(spark, d).filter("target is not null")
    per = lab.groupBy("ticker").agg(F.avg("target").alias("x"), (F.var_samp("target") / F.count("target")).alias("v")).join(lab.agg(F.avg("target").alias("m")))  # one row
    return per.select("ticker", F.round(statistics.shrink(F.col("x"), F.col("v"), F.col("m"), F.lit(0.01)), 6).alias("theta"))


_BOOT = """, sg AS (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS days FROM (SELECT DISTINCT fold, date FROM src)),
 ds AS (SELECT k.fold, k.ticker, sg.pos + days * o.o AS pos, days, coalesce(x, 0) AS x, (x IS NOT NULL)::INT AS c FROM (SELECT DISTINCT fold, ticker FROM src) k JOIN sg USING (fold) JOIN (VALUES (0), (1)) o(o) ON o.o = 0 OR sg.pos < 30 LEFT JOIN src ON src.fold = k.fold AND src.ticker = k.ticker AND src.date = sg.date),
 bs AS (SELECT fold, ticker, pos, days, sum(x) OVER w AS s, sum(c) OVER w AS c FROM ds WINDOW w AS (PARTITION BY fold, ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
 dw AS (SELECT fold, replicate, j, CAST(('0x' || substr(md5('7|' || fold || '|' || replicate || '|' || j), 1, 12))::BIGINT % days AS BIGINT) AS pos FROM (SELECT DISTINCT fold, days FROM sg), range(1, {r}) a(replicate), range(0, 100) b(j) WHERE j < ceil(days / 30)),
 boot AS (SELECT fold, ticker, replicate, sum(s) / sum(c) AS mean FROM dw JOIN bs USING (fold, pos) GROUP BY fold, ticker, replicate HAVING sum(c) > 0)"""


@query(sql_of("SELECT CAST(fold AS INT) AS fold, ticker, count(*) AS replicates, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd FROM boot GROUP BY fold, ticker", *PREDS, "src AS (SELECT fold, ticker, date, y_true AS x FROM te)" + _BOOT.replace("{r}", "51")))
def block_bootstrap(spark, d):
    """Mean and spread of 50 block resamples within each fold, the same dates for all tickers."""
    out = inference.block_bootstrap_means(tested(spark, d).select("fold", "ticker", "date", F.col("y_true").alias("x")), "x", 50, 30)
    return shown(out.groupBy("fold", "ticker").agg(F.count("*").alias("replicates"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd")), "fold ticker replicates", "mean sd")


@query(sql_of("""SELECT ticker, round(t, 5) AS t, round(max(p) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS p_adjusted FROM (SELECT ticker, t, rank, (sum((top >= t)::INT) + 1) / (count(*) + 1) AS p FROM
 (SELECT ticker, t, rank, max(bt) OVER (PARTITION BY replicate ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT boot.ticker, replicate, pr.t, pr.rank, (boot.mean - pr.m) / pr.sd AS bt FROM boot JOIN pr USING (ticker))) GROUP BY ticker, t, rank)""", LAB,
              "src AS (SELECT 0 AS fold, ticker, date, target AS x FROM lab WHERE target IS NOT NULL)" + _BOOT.replace("{r}", "101"),
              "pr AS (SELECT ticker, avg(mean) AS m, stddev_samp(mean) AS sd, avg(mean) / stddev_samp(mean) AS t, row_number() OVER (ORDER BY avg(mean) / stddev_samp(mean) DESC, ticker) AS rank FROM boot GROUP BY ticker HAVING stddev_samp(mean) > 0)"))
def romano_wolf(spark, d):
    lab = labelled(spark, d).filter("target is not null").select(F.lit(0).alias("fold"), "ticker", "date", F.col("target").alias("x"))
    boot = inference.block_bootstrap_means(lab, "x", 100, 30)
    per = boot.groupBy("ticker").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd")).filter("sd > 0")
    centred = boot.withColumnRenamed("mean", "m").join(per, "ticker").select("ticker", "replicate", ((F.col("m") - F.col("mean")) / F.col("sd")).alias("bt"))
    out = inference.romano_wolf(per.select("ticker", (F.col("mean") / F.col("sd")).alias("t")), centred, "ticker")
    return out.select("ticker", F.round("t", 5).alias("t"), F.round("p_adjusted", 6).alias("p_adjusted"))


@query(sql_of("SELECT CAST(year(date) AS INT) AS year, count(DISTINCT ticker) AS tickers, count(*) AS n, count(DISTINCT date) AS dates FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) > 1"))
def archive_coverage(spark, d):
    b = tables.bars(spark, d)
    return b.groupBy(F.year("date").alias("year")).agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n"), F.countDistinct("date").alias("dates")).filter("tickers > 1")


@query("""SELECT l.toxic, count(*) AS n, count(*) FILTER (contains(lower(text), 'stupid')) AS flagged FROM documents d JOIN labels l USING (doc_id) GROUP BY l.toxic""")
def relevance_confusion(spark, d):
    j = tables.table(spark, d, "documents").join(tables.table(spark, d, "labels"), "doc_id")
    return j.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.contains(F.lower("text"), F.lit("stupid")).cast("long")).alias("flagged"))


@query(sql_of(f"""SELECT ticker, {DAY}, round(max(phantom) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING), 1) AS exposed FROM (SELECT ticker, date, CASE WHEN abs(r) < 0.001 THEN 1.0 ELSE 0.0 END AS phantom FROM ret)""", RET))
def phantom_exposure(spark, d):
    r = windows.rolling_beta(tables.bars(spark, d)).withColumn("phantom", F.when(F.abs("r") < 0.001, 1.0).otherwise(0.0))
    return shown(r.withColumn("exposed", F.max("phantom").over(windows.by_ticker().rowsBetween(0, 30))), "ticker date", "exposed", 1)


_SQL_EMA = f"""WITH RECURSIVE {{bars}}, n AS (SELECT ticker, date, close, row_number() OVER {W} AS i FROM bars), e AS (SELECT ticker, date, i, close AS ema FROM n WHERE i = 1
 UNION ALL SELECT n.ticker, n.date, n.i, e.ema + (n.close - e.ema) * 0.2 FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1) SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN i >= 9 THEN ema END, 5) AS ema_9 FROM e"""


@query(_SQL_EMA.replace("{bars}", sql_of("").removeprefix("WITH ").strip()))
def ema_9(spark, d):
    from tidepool.functions import recursive

    return shown(recursive.recursive_indicators(tables.bars(spark, d)), "ticker date", "ema_9", 5)


@query(sql_of("""SELECT CAST(date AS VARCHAR) AS date, round(corr_, 5) AS persistence FROM (SELECT date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS corr_ FROM (SELECT date, p AS a, lead(p, 20) OVER (PARTITION BY ticker ORDER BY date) AS b
 FROM (SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY roc) + (count(*) OVER (PARTITION BY date, roc) - 1) / 2) / count(*) OVER (PARTITION BY date) AS p FROM lab WHERE roc IS NOT NULL)) WHERE b IS NOT NULL GROUP BY date HAVING count(*) >= 10)""", LAB))
def rank_persistence(spark, d):
    some = labelled(spark, d).filter("roc is not null")
    p = some.withColumn("a", xs.average_rank(F.col("roc"), "date") / F.count("*").over(Window.partitionBy("date")))
    b = p.withColumn("b", F.lead("a", 20).over(windows.by_ticker())).filter("b is not null")
    c = F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    return shown(b.groupBy("date").agg(c.alias("persistence"), F.count("*").alias("n")).filter("n >= 10"), "date", "persistence", 5)
