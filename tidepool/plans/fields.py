"""Registered queries of parsers and small rules over whole tables: calendars, flows, delivery files, renames, answers, costs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import events, text
from tidepool.operators import inference, pooling, portfolio, records, sessions, statistics, windows
from tidepool.plans.catalog import DAY, LAB, W, labelled, query, shown, sql_of
from tidepool.plans.ledger import _GRADED, _TAIL, _graded
from tidepool.sources import tables
from tidepool.streaming import ingest

# parsers -------------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'fii' ELSE 'dii' END AS category, CASE WHEN o_orderkey % 7 <> 3 THEN round(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) END AS net FROM orders)
SELECT CAST(date AS VARCHAR) AS date, category, count(*) AS n, round(sum(CAST(round(net * 100) AS BIGINT)) / 100.0::DOUBLE, 2) AS net FROM f WHERE net IS NOT NULL GROUP BY 1, 2""")
def flow_rows(spark, d):
    """Daily flows out of JSON lists whose numbers hold commas; a row without a number goes."""
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 3, "-").otherwise(F.format_number(F.when(k % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")), 2))
    item = F.struct(F.when(k % 2 == 0, "FII/FPI *").otherwise("DII **").alias("category"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("date"), value.alias("netValue"))
    lists = tables.table(spark, d, "orders").groupBy((k % 500).alias("g")).agg(F.to_json(F.collect_list(item)).alias("json"))
    out = pooling.parse_flows(lists).groupBy("date", "category").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("net") * 100).cast("long")) / 100).alias("net"))
    return out.select(F.col("date").cast("string").alias("date"), "category", "n", F.round("net", 2).alias("net"))


@query("""SELECT 'CM' AS segment, CAST(date AS VARCHAR) AS date, 'order ' || n AS description FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) WHERE n % 3 = 0 UNION ALL SELECT 'FO', CAST(date AS VARCHAR), 'order ' || n FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) WHERE n % 3 = 0""")
def holiday_rows(spark, d):
    """Holidays by segment out of a calendar's JSON, one document a year."""
    days = tables.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n")).filter("n % 3 = 0")
    entry = F.collect_list(F.struct(F.date_format("date", "dd-MMM-yyyy").alias("tradingDate"), F.concat(F.lit("order "), "n").alias("description")))
    docs = days.groupBy(F.year("date").alias("y")).agg(entry.alias("e")).select(F.to_json(F.create_map(F.lit("CM"), "e", F.lit("FO"), "e")).alias("json"))
    return shown(pooling.parse_holidays(docs), "segment date description", "")


@query(sql_of("SELECT CAST(year(date) AS INT) AS year, count(DISTINCT date) AS days, count(DISTINCT date) FILTER (isodow(date) < 6 AND dayofmonth(date) <> 15) AS sessions FROM bars GROUP BY 1"))
def calendar_coverage(spark, d):
    """Days with bars of each year and those that a calendar, written as JSON from the years of the bars and read back, calls sessions."""
    days = tables.bars(spark, d).select("date").distinct()
    years = days.agg(F.collect_set(F.year("date")).alias("years"), F.min("date").alias("a"), F.max("date").alias("z"))  # one row
    all_days = F.sequence("a", "z")
    closed = F.transform(F.filter(all_days, lambda x: (F.weekday(x) < 5) & (F.day(x) == 15)), lambda x: x.cast("string"))
    raw = years.select(F.to_json(F.struct(F.map_from_arrays(closed, F.transform(closed, lambda x: F.lit("closed"))).alias("closed_weekdays"), F.create_map().cast("map<string,string>").alias("weekend_sessions"), "years")).alias("raw"))
    marked = sessions.with_session(days, sessions.decode(raw))
    return marked.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("days"), F.sum(F.col("is_session").cast("long")).alias("sessions"))


_MTO = "CASE WHEN l_linenumber = 3 AND l_orderkey % 50 = 7 THEN '20,x,short' ELSE '20,' || l_linenumber || ',S' || l_suppkey || ' ,EQ,' || CAST(l_quantity AS INT) || ',' || CAST(l_quantity AS INT) % 9 || ',12.5' END"


@query(f"""WITH f AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, CAST(l_quantity AS INT) AS q, l_linenumber = 3 AND l_orderkey % 50 = 7 AS bad FROM lineitem),
g AS (SELECT day, bool_or(bad) AS bad, dayofmonth(day) = 31 AS wrong FROM f GROUP BY day)
SELECT CAST(g.day AS VARCHAR) AS day, CASE WHEN wrong THEN 'wrong_date' WHEN g.bad THEN 'bad_record' ELSE 'ok' END AS status, CASE WHEN NOT wrong AND NOT g.bad THEN n END AS n, CASE WHEN NOT wrong AND NOT g.bad THEN q END AS quantity, CASE WHEN NOT wrong AND NOT g.bad THEN dq END AS delivered
FROM g JOIN (SELECT day, count(*) AS n, CAST(sum(q) AS DOUBLE) AS q, CAST(sum(q % 9) AS DOUBLE) AS dq FROM f GROUP BY day) USING (day)""")
def delivery_files(spark, d):
    """A delivery file a day: files of another day or with a record of other than seven fields are refused whole, not guessed at."""
    li = tables.table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    named = F.when(F.day("day") == 31, F.date_add("day", 1)).otherwise(F.col("day"))
    files = li.groupBy("day").agg(F.concat_ws("\n", F.collect_list(F.expr(_MTO))).alias("body"), F.first(named).alias("named")).select("day", F.concat(F.lit("title\n10,MTO,"), F.date_format("named", "ddMMyyyy"), F.lit(",x\n"), "body").alias("file"))
    r = files.select("day", events.delivery_file(F.col("file"), F.col("day")).alias("f"))
    total = lambda c: F.aggregate("f.rows", F.lit(0.0), lambda s, x: s + x[c])
    ok = F.col("f.status") == "ok"
    return r.select(F.col("day").cast("string").alias("day"), F.col("f.status").alias("status"), F.when(ok, F.size("f.rows").cast("long")).alias("n"), F.when(ok, total("quantity")).alias("quantity"), F.when(ok, total("delivered")).alias("delivered"))


_CHAIN = "CASE WHEN c_custkey % 4 < 3 THEN 'S' || (c_custkey + 1) ELSE 'N' || c_custkey END"


@query("""WITH c AS (SELECT c_custkey AS k, DATE '1995-01-01' + CAST((c_custkey % 4) * 300 + c_custkey % 90 AS INT) AS day FROM customer), g AS (SELECT *, k - k % 4 AS root FROM c),
u AS (SELECT root, 'S' || k AS used, lag(day) OVER (PARTITION BY root ORDER BY k) AS valid_from, day AS valid_to, k FROM g UNION ALL SELECT root, CASE WHEN k % 4 = 3 THEN 'N' || k ELSE 'S' || (k + 1) END, day, NULL, k + 1 FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY k DESC) AS r FROM g) WHERE r = 1),
n AS (SELECT root, arg_max(used, k) AS symbol FROM u GROUP BY root)
SELECT symbol, used, CAST(coalesce(valid_from, DATE '1900-01-01') AS VARCHAR) AS valid_from, CAST(coalesce(valid_to, DATE '9999-12-31') AS VARCHAR) AS valid_to FROM u JOIN n USING (root)""")
def symbol_history(spark, d):
    """Every symbol that a name has had, from renames in chains of up to four."""
    c = tables.table(spark, d, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("old"), F.expr(_CHAIN).alias("new"), F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("c_custkey") % 4) * 300 + F.col("c_custkey") % 90).cast("int")).alias("day"))
    return shown(pooling.symbol_intervals(c), "symbol used valid_from valid_to", "")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN 12000 + event_id % 7 END AS number, CASE WHEN event_id % 5 = 2 THEN 'Acme' END AS label, CASE WHEN event_id % 4 < 2 THEN CAST(user_id AS VARCHAR) END AS answer FROM (SELECT event_id, user_id, round(value, 2) AS value FROM events)""")
def messy_fields(spark, d):
    """Numbers, labels and fenced JSON answers out of text that may be none."""
    e, k = tables.table(spark, d, "events"), F.col("event_id")
    number = F.when(k % 6 == 0, F.round("value", 2).cast("string")).when(k % 6 == 1, F.concat(F.lit("12,00"), (k % 7).cast("string"))).when(k % 6 == 2, "NaN").when(k % 6 == 3, "-Infinity").when(k % 6 == 4, "n/a")
    label = F.when(k % 5 == 0, " unknown ").when(k % 5 == 1, "NaN").when(k % 5 == 2, " Acme ").when(k % 5 == 3, "")
    body = F.concat(F.lit('{"user": '), "user_id", F.lit("}"))
    answer = F.when(k % 4 == 0, F.concat(F.lit("<think>{no}</think>```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, body).when(k % 4 == 2, F.concat(F.lit("<think>"), body)).otherwise("none")
    return e.select("event_id", text.parse_number(number).alias("number"), text.clean_label(label).alias("label"), F.get_json_object(text.extract_json(text.strip_reasoning(answer)), "$.user").alias("answer"))


# rules ---------------------------------------------------------------------------------------------------------------


@query(sql_of(f"SELECT ticker, {DAY}, close FROM (SELECT ticker, date, coalesce(adj_close, close) AS close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars) WHERE r = 1"))
def latest_row(spark, d):
    """The newest bar of each ticker, on the adjusted basis where there is one."""
    b = tables.bars(spark, d).withColumn("close", F.coalesce("adj_close", "close"))
    return shown(windows.latest(b, ["ticker"], [F.desc("date")]), "ticker date", "close", None)


HITS = "hits AS (SELECT ticker, exp(-2 * count(*) * greatest(avg((target > 0)::INT) - 0.5, 0) ** 2) AS p FROM lab WHERE target IS NOT NULL GROUP BY ticker)"


@query(sql_of("""SELECT ticker, round(p, 6) AS p, k <= coalesce((SELECT max(k) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM hits) WHERE p <= 0.1 * k / m / (SELECT sum(1.0::DOUBLE / i) FROM range(1, CAST((SELECT count(*) FROM hits) AS INT) + 1) h(i))), 0) AS significant
 FROM (SELECT ticker, p, row_number() OVER (ORDER BY p) AS k FROM hits)""", LAB, HITS))
def benjamini_yekutieli(spark, d):
    """The step-up mask that holds under any dependence."""
    hit = F.avg((F.col("target") > 0).cast("double"))
    per = labelled(spark, d).filter("target is not null").groupBy("ticker").agg(F.exp(-2 * F.count("*") * F.greatest(hit - 0.5, F.lit(0.0)) ** 2).alias("p"))
    return statistics.benjamini_hochberg(per, "p", dependent=True).select("ticker", F.round("p", 6).alias("p"), "significant")


@query(sql_of(f"""SELECT ticker, CASE WHEN abs(theta / sqrt(v)) > 2 AND theta < 0 THEN 'ANTI_SIGNAL' WHEN abs(theta / sqrt(v)) > 2 AND theta > 0.0051 AND CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END >= 0.9 THEN 'STRONG' WHEN theta > 0.0051 AND CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END >= 0.5 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS grade
 FROM (SELECT ticker, theta, v, theta / sqrt(v)::DOUBLE AS z FROM gr WHERE v > 0)""", LAB, _GRADED))
def evidence_gate(spark, d):
    """Grades of mean labels by significance, the break-even and the chance of a positive effect."""
    from tidepool.operators import comparators

    g = _graded(spark, d).filter("v > 0")
    t = F.abs(F.col("theta") / F.sqrt("v"))
    return g.select("ticker", inference.grade(F.col("theta"), comparators.positive_chance(F.col("theta"), F.col("v")), t > 2).alias("grade"))


@query(sql_of(f"""SELECT ticker, n, round(sharpe, 6) AS sharpe, round(sharpe / sd - {{e}}, 6) AS excess FROM (SELECT ticker, n, sharpe, stddev_samp(sharpe) OVER () AS sd FROM (SELECT ticker, count(target) AS n, avg(target) / nullif(stddev_samp(target), 0) AS sharpe FROM lab GROUP BY ticker HAVING count(target) >= 30))""".replace("{e}", repr(statistics.expected_best_sharpe(100))), LAB))
def deflated_sharpe(spark, d):
    """Sharpe ratios of the labels in units of their own spread, less what the best of a hundred trials without skill would reach."""
    per = labelled(spark, d).groupBy("ticker").agg(F.count("target").alias("n"), (F.avg("target") / F.nullif(F.stddev_samp("target"), F.lit(0.0))).alias("sharpe")).filter("n >= 30")
    out = per.withColumn("excess", F.col("sharpe") / F.stddev_samp("sharpe").over(Window.partitionBy()) - statistics.expected_best_sharpe(100))
    return shown(out, "ticker n", "sharpe excess")


_BUY, _SELL = (portfolio.one_way_cost(s, 0.001, 0.00015, 0.0000325, 0.0005) for s in ("buy", "sell"))


@query(f"""SELECT l_suppkey AS ticker, round(sum(CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) / 100.0::DOUBLE * {_BUY!r} + sum(CASE WHEN l_linestatus <> 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) / 100.0::DOUBLE * {_SELL!r}, 2) AS charges,
 round({portfolio.ROUND_TRIP!r} * count(*) FILTER (l_linestatus = 'O') / count(*) / 0.35, 8) AS break_even FROM lineitem GROUP BY 1""")
def trade_charges(spark, d):
    """One-way charges of a ticker's trades, stamp duty on buys alone, and the rank correlation at which its turnover pays."""
    li, buy = tables.table(spark, d, "lineitem"), F.col("l_linestatus") == "O"
    cents = lambda c: F.sum(F.when(c, F.round(F.col("l_extendedprice") * 100).cast("long")).otherwise(0)) / 100
    per = li.groupBy(F.col("l_suppkey").alias("ticker")).agg((cents(buy) * _BUY + cents(~buy) * _SELL).alias("c"), (F.count(F.when(buy, 1)) / F.count("*")).alias("t"))
    unit = portfolio.break_even_ic(1.0, 0.35)
    return per.select("ticker", F.round("c", 2).alias("charges"), F.round(F.col("t") * unit, 8).alias("break_even"))


@query(sql_of(f"SELECT fi, ticker, {DAY} FROM (SELECT ticker, date, 'new' AS fi FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) % 2 = 1)) WHERE dayofmonth(date) = 1"))
def refreshed_rows(spark, d):
    """First-of-month rows of the names whose data a vendor returned, where coverage allows it."""
    b = tables.bars(spark, d)
    odd = b.groupBy("ticker").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("ticker")
    records.assert_coverage(odd, b.select("ticker"), "ticker", 0.2)
    return shown(b.join(odd, "ticker", "left_semi").filter("day(date) = 1").select(F.lit("new").alias("fi"), "ticker", "date"), "fi ticker date", "")


# streams -------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2")
def streamed_scores(spark, d):
    """Every event landed twice, read as a stream: repeats go within the watermark, days close in order, and the sink holds each once."""
    path = pooling.shared_path(spark)
    e = tables.table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    for part in (e.union(e).coalesce(4).sortWithinPartitions("ts"), last):  # the second landing moves the watermark past all days
        part.write.mode("append").parquet(f"{path}/landing")
        fresh = ingest.fresh_articles(ingest.read_landing(spark, f"{path}/landing", "event_id long, ts timestamp, event_type string, value double"), "event_id", late="60 days")
        ingest.write_once(fresh, f"{path}/fresh", f"{path}/check").awaitTermination()
    out = spark.read.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{path}/fresh").filter("event_id >= 0")
    return shown(out.groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), "date event_type n", "mean_value")
