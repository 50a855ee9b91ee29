"""Registered queries of the record operators: filings, names, runs, forecasts, windows, universes and grades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import comparators, filings, records, windows
from tidepool.operators import crosssection as xs
from tidepool.plans.catalog import DAY, LAB, MEM, PREDS, RET, W, floors, labelled, query, shown, sql_of
from tidepool.plans.extra import IC, average_ranks, tested
from tidepool.sources import tables

# filings -----------------------------------------------------------------------------------------------------------

_FILINGS = """fi AS (SELECT o_orderkey AS filing_id, o_custkey AS symbol, last_day(make_date(year(o_orderdate), CAST(quarter(o_orderdate) * 3 AS INT), 1)) AS period_end, CASE WHEN o_orderkey % 3 = 0 THEN 'consolidated' ELSE 'standalone' END AS basis,
 o_orderstatus = 'P' AS revised, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS disclosed, CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice / 1e5 END AS sue FROM orders)"""


def _filings(spark, d):
    o, day = tables.table(spark, d, "orders"), F.to_date("o_orderdate")
    end = F.last_day(F.make_date(F.year(day), (F.quarter(day) * 3).cast("int"), F.lit(1)))
    return o.select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("symbol"), end.alias("period_end"), F.when(F.col("o_orderkey") % 3 == 0, "consolidated").otherwise("standalone").alias("basis"),
                    (F.col("o_orderstatus") == "P").alias("revised"), F.when(F.col("o_orderkey") % 11 != 0, day).alias("disclosed"), F.when(F.col("o_orderkey") % 4 != 1, F.col("o_totalprice") / 1e5).alias("sue"))


@query(f"WITH {_FILINGS} SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, basis, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period_end, basis ORDER BY revised, disclosed, filing_id) AS k FROM fi WHERE disclosed IS NOT NULL) WHERE k = 1")
def first_disclosures(spark, d):
    return shown(records.first_disclosures(_filings(spark, d), ["symbol", "period_end", "basis"]), "symbol period_end basis filing_id", "")


@query(f"""WITH {_FILINGS} SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, filing_id, sue, CASE WHEN sue IS NOT NULL THEN basis END AS basis FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period_end ORDER BY CASE WHEN sue IS NOT NULL AND basis = 'consolidated' THEN 0 WHEN sue IS NOT NULL THEN 1 ELSE 2 END, disclosed NULLS LAST, filing_id) AS k FROM fi) WHERE k = 1""")
def announcement_pick(spark, d):
    return shown(records.pick_announcements(_filings(spark, d), ["symbol", "period_end"]), "symbol period_end filing_id basis", "sue", None)


_ACTIONS = "ac AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 5 WHEN 0 THEN 'bonus' WHEN 1 THEN 'split' WHEN 2 THEN 'demerger' ELSE 'dividend' END AS kind, CAST(o_orderkey % 3 + 1.5 AS DOUBLE) AS factor FROM orders WHERE o_orderkey % 2 = 0)"


def _actions(spark, d):
    o = tables.table(spark, d, "orders").filter("o_orderkey % 2 = 0")
    k = F.col("o_orderkey") % 5
    return o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.when(k == 0, "bonus").when(k == 1, "split").when(k == 2, "demerger").otherwise("dividend").alias("kind"), (F.col("o_orderkey") % 3 + 1.5).alias("factor"))


@query(f"WITH {_ACTIONS} SELECT DISTINCT symbol, CAST(day AS VARCHAR) AS day FROM (SELECT symbol, day FROM ac WHERE kind = 'demerger' UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 101 = 7)")
def structural_breaks(spark, d):
    curated = tables.table(spark, d, "orders").filter("o_orderkey % 101 = 7").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"))
    return shown(records.structural_breaks(_actions(spark, d), curated), "symbol day", "")


@query(f"""WITH {_ACTIONS}, yf AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, 2.0::DOUBLE AS factor FROM orders WHERE o_orderkey % 2 = 1)
SELECT symbol, CAST(day AS VARCHAR) AS day, kind, factor FROM ac UNION ALL SELECT symbol, CAST(day AS VARCHAR), 'split_yf', factor FROM yf WHERE symbol IN (SELECT symbol FROM ac) AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.symbol = yf.symbol AND kind IN ('bonus', 'split') AND abs(date_diff('day', ac.day, yf.day)) <= 5)""")
def merged_splits(spark, d):
    second = tables.table(spark, d, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.lit(2.0).alias("factor"))
    return shown(records.merge_splits(_actions(spark, d), second), "symbol day kind", "factor")


@query("""SELECT o_orderkey, CAST(greatest(CAST(o_orderdate AS DATE), CASE WHEN o_orderkey % 2 = 0 THEN DATE '1995-06-30' END) AS VARCHAR) AS disclosed, CASE o_orderkey % 5 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' WHEN 2 THEN 'standalone' END AS basis, round(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 1 THEN 1.5::DOUBLE END), 2) AS first_present FROM orders""")
def filing_fields(spark, d):
    """The latest stamp, the basis of a written one, and the first present of several rows."""
    o = tables.table(spark, d, "orders")
    k = F.col("o_orderkey")
    written = F.when(k % 5 == 0, " Consolidated").when(k % 5 == 1, "Standalone").when(k % 5 == 2, "NON-CONSOLIDATED ").when(k % 5 == 3, "Consolidated Audited").otherwise("other")
    stamp = F.greatest(F.to_date("o_orderdate"), F.when(k % 2 == 0, F.lit("1995-06-30").cast("date")))
    first = F.coalesce(F.when(k % 3 == 0, F.col("o_totalprice")), F.when(k % 3 == 1, F.lit(1.5)))
    return o.select("o_orderkey", stamp.cast("string").alias("disclosed"), filings.basis_of(written).alias("basis"), F.round(first, 2).alias("first_present"))


@query("""SELECT ticker, field, n, round(m, 6) AS median_change, round(x, 6) AS max_change FROM (SELECT ticker, field, count(c) AS n, median(c) AS m, max(c) AS x FROM (SELECT ticker, field, abs(v - lag(v) OVER (PARTITION BY ticker, field ORDER BY period_end)) / nullif(abs(lag(v) OVER (PARTITION BY ticker, field ORDER BY period_end)), 0) AS c
 FROM (SELECT l_suppkey AS ticker, make_date(year(l_shipdate), 12, 31) AS period_end, unnest(['eps', 'book']) AS field, unnest([sum(l_extendedprice * l_discount) / sum(l_quantity), avg(l_extendedprice)]) AS v FROM lineitem GROUP BY 1, 2)) GROUP BY ticker, field)""")
def restatement_summary(spark, d):
    f = tables.fundamentals(spark, d).unpivot(["ticker", "period_end"], ["eps", "book"], "field", "v")
    w = Window.partitionBy("ticker", "field").orderBy("period_end")
    c = f.withColumn("c", F.abs(F.col("v") - F.lag("v").over(w)) / F.nullif(F.abs(F.lag("v").over(w)), F.lit(0.0)))
    return shown(c.groupBy("ticker", "field").agg(F.count("c").alias("n"), F.percentile("c", F.lit(0.5)).alias("median_change"), F.max("c").alias("max_change")), "ticker field n", "median_change max_change")


# names -------------------------------------------------------------------------------------------------------------

_NAME = "replace(s_name, 'Supplier#', 'Acme ') || ' Limited'"
_CORE = "replace(s_name, 'Supplier#', 'Acme ')"
_SYM = "CASE s_suppkey % 4 WHEN 0 THEN 'TITAN' WHEN 1 THEN 'ACME' WHEN 2 THEN 'M1' ELSE 'AB' END"
_AMBIGUOUS = ["TITAN", "ACE"]


def _company():
    k = F.col("s_suppkey") % 4
    core = F.replace("s_name", F.lit("Supplier#"), F.lit("Acme "))
    return F.concat(core, F.lit(" Limited")), F.when(k == 0, "TITAN").when(k == 1, "ACME").when(k == 2, "M1").otherwise("AB")


@query(f"""SELECT s_suppkey AS ticker, CASE WHEN {_SYM} = 'ACME' THEN {_NAME} || '|' || {_CORE} || '|ACME' ELSE {_NAME} || '|' || {_CORE} END AS aliases, '"' || CASE WHEN {_SYM} = 'TITAN' THEN {_NAME} ELSE {_CORE} END || '"' AS search FROM supplier""")
def company_names(spark, d):
    name, symbol = _company()
    core = text.core_name(name)
    return tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.array_join(records.aliases(name, symbol, core, _AMBIGUOUS), "|").alias("aliases"), records.search_query(name, symbol, core, _AMBIGUOUS).alias("search"))


@query("""SELECT n_name AS sector, 'EW-LOO:' || n_name AS benchmark, CASE n_nationkey % 3 WHEN 0 THEN '^BANK' WHEN 1 THEN '^IT' ELSE '^MARKET' END AS index_id, n_nationkey % 3 <> 2 AS specific FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def benchmark_lookup(spark, d):
    """Sectors in use, their own benchmark, and the index that stands for them, the market where none does."""
    used = tables.table(spark, d, "nation").join(tables.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    table = F.create_map(F.lit(0), F.lit("^BANK"), F.lit(1), F.lit("^IT"))
    index = F.try_element_at(table, (F.col("n_nationkey") % 3).cast("int"))
    return used.select(F.col("n_name").alias("sector"), F.concat(F.lit("EW-LOO:"), "n_name").alias("benchmark"), F.coalesce(index, F.lit("^MARKET")).alias("index_id"), index.isNotNull().alias("specific"))


@query("SELECT n_name AS sector, count(*) AS tickers, min(s_suppkey) AS first_ticker, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS members FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def sector_members(spark, d):
    s = tables.sectors(spark, d)
    return s.groupBy("sector").agg(F.count("*").alias("tickers"), F.min("ticker").alias("first_ticker"), F.array_join(F.array_sort(F.collect_list(F.col("ticker").cast("string"))), ",").alias("members"))


@query("SELECT n_regionkey AS region, sha256('{\"n\":' || count(*) || ',\"region\":' || n_regionkey || '}') AS fingerprint FROM nation GROUP BY n_regionkey")
def rule_fingerprint(spark, d):
    """A digest of a rule's fields as JSON with sorted keys."""
    n = tables.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return n.select("region", F.sha2(F.to_json(F.struct("n", "region")), 256).alias("fingerprint"))


@query("SELECT p_partkey, CAST(CAST(CAST(p_retailprice * 1.1 / 3 AS FLOAT) AS VARCHAR) AS DOUBLE) AS price FROM part")
def real_round_trip(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", records.real(F.col("p_retailprice") * 1.1 / 3).alias("price"))


@query(sql_of(f"SELECT {DAY}, n, round(-1.0 / (n - 1), 8) AS induced FROM (SELECT date, count(*) AS n FROM bars GROUP BY date) WHERE n > 1"))
def induced_correlation(spark, d):
    """Pairwise correlation that demeaning within a date of n names leaves."""
    per = tables.bars(spark, d).groupBy("date").agg(F.count("*").alias("n")).filter("n > 1")
    return shown(per.withColumn("induced", -1.0 / (F.col("n") - 1)), "date n", "induced", 8)


# runs, forecasts, windows ------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, CAST(rank AS INT) AS rank FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20")
def recent_runs(spark, d):
    top = records.newest(tables.table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 20)
    return top.select("event_id", "event_type", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).alias("rank"))  # 20 rows


@query(sql_of(f"SELECT ticker, {DAY}, CAST(row_number() OVER {W} AS INT) AS pos, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 200"))
def signals_tail(spark, d):
    return shown(records.tail(tables.bars(spark, d), "ticker", 200), "ticker date pos", "close", None)


@query("SELECT user_id, event_id, CAST(k AS INT) AS k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def newest_headlines(spark, d):
    return windows_latest(tables.table(spark, d, "events"))


def windows_latest(e, n: int = 5):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.select("user_id", "event_id", k.alias("k")).filter(F.col("k") <= n)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, max(event_id) AS newest FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 5) GROUP BY 1")
def shadow_summary(spark, d):
    """Counts of the last five dates."""
    e = tables.table(spark, d, "events").withColumn("date", F.to_date("ts"))
    last = e.select("date").distinct().orderBy(F.desc("date")).limit(5)
    return e.join(last, "date", "left_semi").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("SELECT event_id, user_id, round(value, 4) AS value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def shadow_forecasts(spark, d):
    e = tables.table(spark, d, "events").withColumn("date", F.to_date("ts"))
    day = e.agg(F.max("date").alias("date"))
    return e.join(day, "date", "left_semi").select("event_id", "user_id", F.round("value", 4).alias("value"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def forecast_prune(spark, d):
    """Rows outside the universe go; more than the allowed share would raise."""
    u = tables.table(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("user_id"))
    return records.prune(tables.table(spark, d, "events").select("event_id", "user_id"), u, "user_id")


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)")
def largest_groups(spark, d):
    return records.largest_groups(tables.table(spark, d, "events").select("user_id", "event_id"), "user_id", 10)


@query("""SELECT ticker FROM (SELECT s_suppkey AS ticker, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier) WHERE ((r - (date_diff('day', DATE '1970-01-01', DATE '1998-03-02') * 4) % n) % n + n) % n < 4""")
def narrative_sample(spark, d):
    return records.rotating_sample(tables.sectors(spark, d), "ticker", F.lit("1998-03-02").cast("date"), 4)


@query(sql_of("SELECT ticker FROM mem WHERE effective_from <= DATE '1995-01-01' AND effective_to > DATE '1995-01-01' UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0", MEM))
def ingest_universe(spark, d):
    """The frozen list and today's members."""
    from tidepool.operators import joins

    now = joins.member_on(tables.memberships(tables.bars(spark, d)), F.lit("1995-01-01").cast("date")).select("ticker")
    return now.union(tables.sectors(spark, d).filter("ticker % 2 = 0").select("ticker")).distinct()


_LOGGED = "lg AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN value > 100 THEN 'ok' WHEN value > 50 THEN 'blocked' ELSE 'error' END AS status, event_id AS seq FROM events)"


def _log(spark, d):
    s = F.when(F.col("value") > 100, "ok").when(F.col("value") > 50, "blocked").otherwise("error")
    return tables.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), s.alias("status"), F.col("event_id").alias("seq"))


@query(f"WITH {_LOGGED} SELECT DISTINCT user_id, CAST(day AS VARCHAR) AS day FROM lg WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM lg WHERE status = 'ok')")
def open_windows(spark, d):
    """Windows that a resumed backfill still has to fetch."""
    g = _log(spark, d)
    return shown(records.resumable(g.select("user_id", "day").distinct(), g, ["user_id", "day"])[0], "user_id day", "")


@query(f"WITH {_LOGGED} SELECT user_id, CAST(day AS VARCHAR) AS day, status FROM (SELECT user_id, day, arg_max(status, seq) AS status FROM lg GROUP BY user_id, day) WHERE status <> 'ok'")
def blocked_windows(spark, d):
    g = _log(spark, d)
    return shown(records.resumable(g.select("user_id", "day").distinct(), g, ["user_id", "day"])[1], "user_id day status", "")


@query(sql_of("""SELECT ticker, CAST(greatest(m, effective_from) AS VARCHAR) AS start, CAST(least(last_day(m), effective_to) AS VARCHAR) AS "end" FROM (SELECT *, unnest(generate_series(date_trunc('month', effective_from), date_trunc('month', effective_to), INTERVAL 1 MONTH))::DATE AS m FROM mem)""", MEM))
def month_windows(spark, d):
    m = tables.memberships(tables.bars(spark, d)).withColumn("w", F.explode(records.month_windows(F.col("effective_from"), F.col("effective_to"))))
    return m.select("ticker", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end"))


@query("""WITH RECURSIVE dy AS (SELECT event_type AS key, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT key, min(date) AS start, max(date) AS "end", CAST(sum(n) AS BIGINT) AS n FROM dy GROUP BY key
 UNION ALL SELECT h.key, h.s, h.e, CAST((SELECT coalesce(sum(n), 0) FROM dy WHERE dy.key = h.key AND dy.date BETWEEN h.s AND h.e) AS BIGINT) FROM (SELECT key, unnest([start, start + (CAST("end" - start AS INT) // 2) + 1]) AS s, unnest([start + (CAST("end" - start AS INT) // 2), "end"]) AS e FROM w WHERE n >= 100 AND start < "end") h)
SELECT key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", n, n >= 100 AS saturated FROM w WHERE NOT (n >= 100 AND start < "end")""")
def split_windows(spark, d):
    c = tables.table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return shown(records.split_windows(c), "key start end n saturated", "")


# audits and grades -------------------------------------------------------------------------------------------------


@query(sql_of("SELECT CAST(min(effective_from) AS VARCHAR) AS first_day, count(DISTINCT ticker) AS tickers, count(*) AS intervals FROM mem", MEM))
def universe_bias(spark, d):
    return tables.memberships(tables.bars(spark, d)).agg(F.min("effective_from").cast("string").alias("first_day"), F.count_distinct("ticker").alias("tickers"), F.count("*").alias("intervals"))


_AUDIT = """au AS (SELECT ticker, count(*) AS sessions, min(date) AS a, max(date) AS z, median(close * volume) AS adv FROM bars GROUP BY ticker),
 br AS (SELECT date FROM bars GROUP BY date HAVING count(*) >= 0.02 * (SELECT count(*) FROM au)), ho AS (SELECT au.ticker, count(*) AS expected FROM au JOIN br ON br.date BETWEEN a AND z GROUP BY au.ticker),
 ow AS (SELECT ticker, count(*) AS held FROM bars JOIN br USING (date) GROUP BY ticker)"""


def _audit(spark, d):
    """Per ticker: sessions, span, traded value and the broad sessions inside its span that it lacks. Broad sessions are
    numbered, so a span's count is a difference of two positions and no range join is needed."""
    b = tables.bars(spark, d)
    per = b.groupBy("ticker").agg(F.count("*").alias("sessions"), F.min("date").alias("a"), F.max("date").alias("z"), F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("adv"))
    total = per.agg(F.count("*").alias("names"))
    days = b.groupBy("date").agg(F.count("*").alias("n")).join(total).withColumn("broad", (F.col("n") >= 0.02 * F.col("names")).cast("int"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    pos = days.select("date", "broad", F.sum("broad").over(w).alias("upto"))
    first, last = pos.select(F.col("date").alias("a"), (F.col("upto") - F.col("broad")).alias("before")), pos.select(F.col("date").alias("z"), F.col("upto").alias("through"))
    held = b.join(pos.filter("broad = 1"), "date").groupBy("ticker").agg(F.count("*").alias("held"))
    j = per.join(first, "a").join(last, "z").join(held, "ticker", "left")
    return j.withColumn("expected", F.col("through") - F.col("before")).withColumn("holes", F.col("expected") - F.coalesce("held", F.lit(0)))


@query(sql_of("SELECT ticker, sessions, CAST(a AS VARCHAR) AS first_day, CAST(z AS VARCHAR) AS last_day, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(expected, 0) - coalesce(held, 0) AS BIGINT) AS holes, round(adv, 3) AS adv FROM au LEFT JOIN ho USING (ticker) LEFT JOIN ow USING (ticker)", _AUDIT))
def universe_audit_scan(spark, d):
    return _audit(spark, d).select("ticker", "sessions", F.col("a").cast("string").alias("first_day"), F.col("z").cast("string").alias("last_day"), F.col("expected").cast("long").alias("expected"), F.col("holes").cast("long").alias("holes"), F.round("adv", 3).alias("adv"))


@query(sql_of("SELECT ticker, CASE WHEN sessions < 500 THEN 'short' WHEN coalesce(expected, 0) - coalesce(held, 0) > 0.5 * expected THEN 'holes' WHEN adv < 30000 THEN 'thin' ELSE 'candidate' END AS finding FROM au LEFT JOIN ho USING (ticker) LEFT JOIN ow USING (ticker)", _AUDIT))
def universe_audit(spark, d):
    finding = F.when(F.col("sessions") < 500, "short").when(F.col("holes") > 0.5 * F.col("expected"), "holes").when(F.col("adv") < 30000, "thin").otherwise("candidate")
    return _audit(spark, d).select("ticker", finding.alias("finding"))


@query("""SELECT event_type AS model, count(*) AS n, count(*) FILTER (value > 100) AS flagged, count(*) FILTER (value > 100 AND user_id % 2 = 0) AS flagged_open, count(*) FILTER (value > 100 AND user_id % 2 = 0 AND value > 150) AS changed FROM events GROUP BY 1""")
def critic_effect(spark, d):
    """How often a JSON list of objections is not empty, the gate is open and the answer changed."""
    e = tables.table(spark, d, "events")
    flags = F.size(F.from_json(F.when(F.col("value") > 100, F.lit('["too sure"]')).otherwise(F.lit("[]")), "array<string>")) > 0
    n = lambda c: F.sum(c.cast("long"))
    gate = F.col("user_id") % 2 == 0
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), n(flags).alias("flagged"), n(flags & gate).alias("flagged_open"), n(flags & gate & (F.col("value") > 150)).alias("changed"))


@query(sql_of("""SELECT 'ticker' AS kind, CAST(ticker AS VARCHAR) AS item FROM la WHERE v IS NOT NULL GROUP BY ticker HAVING count(DISTINCT v) = 1 UNION ALL SELECT 'date', CAST(date AS VARCHAR) FROM la WHERE v IS NOT NULL GROUP BY date HAVING count(DISTINCT v) = 1 AND count(*) >= 2""", LAB,
              "la AS (SELECT *, CASE WHEN ticker % 10 = 3 THEN abs(sign(roc)) WHEN dayofmonth(date) = 7 THEN -1 ELSE sign(roc) END AS v FROM lab WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 120))"))
def standing_findings(spark, d):
    """Tickers and dates that hold one value only within the last 120 dates; every tenth ticker is planted without a fall."""
    lab = labelled(spark, d)
    last = lab.select("date").distinct().orderBy(F.desc("date")).limit(120)
    la = lab.join(last, "date", "left_semi").withColumn("v", F.when(F.col("ticker") % 10 == 3, F.abs(F.signum("roc"))).when(F.day("date") == 7, F.lit(-1.0)).otherwise(F.signum("roc"))).filter("v is not null")
    lone = lambda k, least: la.groupBy(k).agg(F.count_distinct("v").alias("u"), F.count("*").alias("n")).filter((F.col("u") == 1) & (F.col("n") >= least)).select(F.lit(k).alias("kind"), F.col(k).cast("string").alias("item"))
    return lone("ticker", 1).union(lone("date", 2))


@query(sql_of("SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS \"both\", round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 6) AS jaccard FROM (SELECT ticker, avg(target) > 0 AS a, stddev_samp(target) > 0.5 AS b FROM lab GROUP BY ticker)", LAB))
def metric_agreement(spark, d):
    per = labelled(spark, d).groupBy("ticker").agg(F.avg("target").alias("m"), F.stddev_samp("target").alias("s"))
    return records.overlap(per.filter("m > 0"), per.filter("s > 0.5"), ["ticker"]).withColumn("jaccard", F.round("jaccard", 6))


@query(sql_of("""SELECT CAST(fold AS INT) AS fold, round(avg(u), 5) AS values_per_date, (SELECT count(*) FROM (SELECT 1 FROM preds q WHERE q.fold = p.fold GROUP BY q.ticker HAVING count(DISTINCT round(q.beta_market, 8)) = 1)) AS constant_cells FROM (SELECT fold, date, count(DISTINCT round(beta_market, 8)) AS u FROM preds GROUP BY fold, date) p GROUP BY fold""", *PREDS))
def resolution_stats(spark, d):
    p = floors(spark, d).withColumn("v", F.round("beta_market", 8))
    dates = p.groupBy("fold", "date").agg(F.count_distinct("v").alias("u")).groupBy("fold").agg(F.round(F.avg("u"), 5).alias("values_per_date"))
    cells = p.groupBy("fold", "ticker").agg(F.count_distinct("v").alias("u")).groupBy("fold").agg(F.count(F.when(F.col("u") == 1, 1)).alias("constant_cells"))
    return dates.join(cells, "fold")


_GRADED = "gr AS (SELECT ticker, avg(target) AS theta, var_samp(target) / count(target) AS v, CASE WHEN avg(target) > 0.02 THEN 'STRONG' WHEN avg(target) > 0 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS grade FROM lab WHERE target IS NOT NULL GROUP BY ticker)"


def _graded(spark, d):
    per = labelled(spark, d).filter("target is not null").groupBy("ticker").agg(F.avg("target").alias("theta"), (F.var_samp("target") / F.count("target")).alias("v"))
    return per.withColumn("grade", F.when(F.col("theta") > 0.02, "STRONG").when(F.col("theta") > 0, "WEAK").otherwise("INSUFFICIENT"))


@query(sql_of("SELECT g.grade, count(gr.ticker) AS n FROM (VALUES ('STRONG'), ('WEAK'), ('INSUFFICIENT'), ('ANTI_SIGNAL')) g(grade) LEFT JOIN gr USING (grade) GROUP BY g.grade", LAB, _GRADED))
def evidence_counts(spark, d):
    return records.counts_over(_graded(spark, d), "grade", ["STRONG", "WEAK", "INSUFFICIENT", "ANTI_SIGNAL"])


_PHI = "1 / (1 + 0.2316419 * abs(z))"
_TAIL = f"exp(-z * z / 2) / 2.5066282746310002 * ({_PHI} * (0.319381530 + {_PHI} * (-0.356563782 + {_PHI} * (1.781477937 + {_PHI} * (-1.821255978 + {_PHI} * 1.330274429)))))"


@query(sql_of(f"SELECT ticker, round(CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 6) AS p_positive FROM (SELECT ticker, theta / sqrt(v)::DOUBLE AS z FROM gr WHERE v > 0)", LAB, _GRADED))
def positive_chance(spark, d):
    g = _graded(spark, d).filter("v > 0")
    return g.select("ticker", F.round(comparators.positive_chance(F.col("theta"), F.col("v")), 6).alias("p_positive"))


_TICS = f"tics AS (SELECT ticker, fold, CASE WHEN count(*) >= 3 THEN {IC} END AS ic FROM (SELECT fold, ticker, {average_ranks('y_true', 'fold, ticker')} AS a, {average_ranks('roc', 'fold, ticker')} AS b FROM te WHERE roc IS NOT NULL) GROUP BY fold, ticker)"


@query(sql_of("SELECT ticker, count(ic) AS folds, round(avg(ic), 5) AS ic, round(CASE WHEN count(ic) >= 2 THEN var_samp(ic) / count(ic) END, 6) AS sigma2 FROM tics GROUP BY ticker", *PREDS, _TICS))
def fallback_variance(spark, d):
    """Sampling variance of a ticker's mean correlation from its folds."""
    t = xs.rank_ic(tested(spark, d).filter("roc is not null"), "y_true", "roc", ["fold", "ticker"])
    per = t.groupBy("ticker").agg(F.count("ic").alias("folds"), F.avg("ic").alias("ic"), F.when(F.count("ic") >= 2, F.var_samp("ic") / F.count("ic")).alias("sigma2"))
    return per.select("ticker", "folds", F.round("ic", 5).alias("ic"), F.round("sigma2", 6).alias("sigma2"))


@query("SELECT round(CAST(value AS DOUBLE) / 100, 6) AS spread FROM (SELECT value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1)")
def recorded_spread(spark, d):
    """A number inside the JSON metrics of the last run of a kind."""
    e = tables.table(spark, d, "events").filter("event_type = 'error'").withColumn("metrics", F.to_json(F.struct(F.struct((F.col("value") / 100).alias("spread_per_ic")).alias("book"))))
    return records.newest(e, [F.desc("ts"), F.desc("event_id")], 1).select(F.round(F.get_json_object("metrics", "$.book.spread_per_ic").cast("double"), 6).alias("spread"))


@query(sql_of("SELECT sector, count(*) AS names, round(median(r2), 6) AS median_r2 FROM (SELECT sector, ret.ticker, corr(r, m) ** 2 AS r2 FROM ret JOIN sec USING (ticker) JOIN (SELECT sector, date, avg(r) AS m FROM ret JOIN sec USING (ticker) GROUP BY sector, date HAVING count(r) >= 2) i USING (sector, date) WHERE r IS NOT NULL GROUP BY sector, ret.ticker HAVING count(*) >= 5) WHERE r2 IS NOT NULL AND NOT isnan(r2) GROUP BY sector", RET,
              "sec AS (SELECT s_suppkey AS ticker, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"))
def median_r2(spark, d):
    """Median squared correlation of a sector's members with its index."""
    r = windows.rolling_beta(tables.bars(spark, d)).filter("r is not null").select("ticker", "date", "r").join(tables.sectors(spark, d).select("ticker", "sector"), "ticker")
    index = r.groupBy("sector", "date").agg(F.avg("r").alias("m"), F.count("r").alias("n")).filter("n >= 2").drop("n")
    c = r.join(index, ["sector", "date"]).groupBy("sector", "ticker").agg((F.corr("r", "m") ** 2).alias("r2"), F.count("*").alias("n")).filter("n >= 5 and r2 is not null and not isnan(r2)")
    return shown(c.groupBy("sector").agg(F.count("*").alias("names"), F.percentile("r2", F.lit(0.5)).alias("median_r2")), "sector names", "median_r2")


@query(sql_of("SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg((y_true - market > -market)::INT), 6) AS p_up FROM preds GROUP BY fold", *PREDS))
def chance_up(spark, d):
    """Share of a fold's residuals above minus its prediction."""
    p = floors(spark, d)
    return shown(p.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("y_true") - F.col("market") > -F.col("market")).cast("double")).alias("p_up")), "fold n", "p_up")


@query(sql_of("SELECT fold, comparator, text FROM (SELECT CAST(fold AS INT) AS fold, comparator, comparator || ': MAE ' || printf('%.4f', mae) || ', hit rate ' || printf('%.1f', hit_rate) || ' % on ' || n || ' rows' AS text FROM (SELECT fold, 'market' AS comparator, count(*) AS n, avg(abs(market - y_true)) AS mae, avg(((market > 0) = (y_true > 0))::INT) * 100 AS hit_rate FROM preds GROUP BY fold))", *PREDS))
def comparison_text(spark, d):
    from tidepool.operators import folds

    m = folds.fold_metrics(floors(spark, d), ["market"])
    return m.select("fold", "comparator", F.format_string("%s: MAE %.4f, hit rate %.1f %% on %d rows", "comparator", "mae", "hit_rate", "n").alias("text"))


@query(sql_of(f"SELECT ticker, {DAY}, round(target, 5) AS realised, direction FROM (SELECT ticker, date, target, CASE WHEN target IS NULL THEN NULL ELSE (roc > 0) = (target > 0) END AS direction FROM lab WHERE roc IS NOT NULL)", LAB))
def graded_outcomes(spark, d):
    """Outcomes of forecasts, the direction null until the label is there."""
    lab = labelled(spark, d).filter("roc is not null")
    return shown(lab.withColumn("realised", F.col("target")).withColumn("direction", F.when(F.col("target").isNotNull(), (F.col("roc") > 0) == (F.col("target") > 0))), "ticker date direction", "realised", 5)
