"""Registered queries of results filings: both lists, earnings per share from XBRL instances and from result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import filings
from tidepool.plans.catalog import query
from tidepool.sources import tables

_DAY = "make_date(year(o_orderdate), CAST(quarter(o_orderdate) * 3 AS INT), 1)"

# lists ---------------------------------------------------------------------------------------------------------------

_DASH = "{f}(x, '{p}')"
_WRITTEN = """CASE o_orderkey % 5 WHEN 0 THEN 'Consolidated' WHEN 1 THEN ' Standalone' WHEN 2 THEN 'Non-Consolidated' WHEN 3 THEN 'Consolidated Audited' ELSE 'CONSOLIDATED ' END"""
_FORMAT = "CASE WHEN o_orderkey % 3 = 0 THEN 'Old' ELSE 'New' END"
_XBRL = "CASE WHEN o_orderkey % 7 = 3 THEN 'https://archive/xbrl/-' ELSE 'https://archive/xbrl/' || o_orderkey || '.xml' END"
_PAGE = "CASE WHEN o_orderkey % 4 = 1 THEN '-' ELSE 'https://archive/' || o_orderkey || '.html' END"


@query(f"""WITH o AS (SELECT *, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS a, last_day({_DAY}) AS z, o_orderdate + to_minutes(o_orderkey % 3000) AS seen, o_orderdate + to_minutes(o_orderkey % 2000 + 60) AS shown FROM orders),
legacy AS (SELECT o_orderkey, o_custkey AS symbol, CASE WHEN o_orderkey % 6 = 5 THEN a - INTERVAL 6 MONTH ELSE a END AS s, z, {_WRITTEN} AS b, {_FORMAT} AS f, {_XBRL} AS x, {_PAGE} AS p,
 CASE WHEN o_orderkey % 8 NOT IN (1, 2) THEN date_trunc('second', seen) END AS seen, CASE WHEN o_orderkey % 8 NOT IN (2, 3) THEN date_trunc('minute', shown) END AS shown, o_orderdate AS filed FROM o WHERE o_orderkey % 2 = 0 AND o_orderkey % 9 <> 4),
newer AS (SELECT o_orderkey, o_custkey AS symbol, a, z, {_WRITTEN} AS b, seen, shown FROM o WHERE o_orderkey % 2 = 1 AND o_orderkey % 10 <> 3)
SELECT symbol, CAST(CAST(s AS DATE) AS VARCHAR) AS period_start, CAST(z AS VARCHAR) AS period_end, CASE WHEN lower(trim(b)) = 'consolidated' THEN 'consolidated' ELSE 'standalone' END AS basis, CASE WHEN f = 'New' THEN 'legacy_xbrl' ELSE 'legacy_html' END AS source,
 strftime(CASE WHEN seen IS NULL AND shown IS NULL THEN filed ELSE greatest(coalesce(seen, shown), coalesce(shown, seen)) END, '%Y-%m-%d %H:%M:%S') AS disclosed, o_orderkey % 13 = 0 AS revised, CAST(o_orderkey AS VARCHAR) AS seq
 FROM legacy WHERE date_diff('day', CAST(s AS DATE), z) BETWEEN 80 AND 100 AND lower(trim(b)) IN ('consolidated', 'standalone', 'non-consolidated') AND CASE WHEN f = 'New' THEN NOT x LIKE '%-' ELSE p <> '-' END
UNION ALL SELECT symbol, CAST(a AS VARCHAR), CAST(z AS VARCHAR), CASE WHEN lower(trim(b)) = 'consolidated' THEN 'consolidated' ELSE 'standalone' END, 'integrated_xbrl',
 strftime(greatest(date_trunc('second', seen), date_trunc('second', shown)), '%Y-%m-%d %H:%M:%S'), o_orderkey % 13 = 0, CAST(o_orderkey AS VARCHAR) FROM newer WHERE lower(trim(b)) IN ('consolidated', 'standalone', 'non-consolidated') AND o_orderkey % 7 <> 3""")
def filings_normalised(spark, d):
    """Both kinds of list, written from orders as the exchange writes them: filings that are no quarter, cumulative, of no known basis or without a document go."""
    k = F.col("o_orderkey")
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    o = tables.table(spark, d, "orders").withColumns({"a": quarter, "z": F.last_day(F.add_months(quarter, 2)), "seen": F.col("o_orderdate") + F.make_dt_interval(mins=(k % 3000).cast("int")),
                                                      "shown": F.col("o_orderdate") + F.make_dt_interval(mins=(k % 2000 + 60).cast("int"))})
    say = lambda c, form: F.date_format(c, form)
    long, short, day = "dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "dd-MMM-yyyy"
    legacy = o.filter(k % 2 == 0).select(
        F.col("o_custkey").alias("symbol"), say(F.when(k % 6 == 5, F.add_months("a", -6)).otherwise(F.col("a")), day).alias("fromDate"), say("z", day).alias("toDate"), F.when(k % 9 == 4, "Cumulative").otherwise("Non-cumulative").alias("cumulative"),
        F.expr(_WRITTEN).alias("consolidated"), F.expr(_FORMAT).alias("format"), F.expr(_XBRL).alias("xbrl"), F.expr(_PAGE).alias("resultDetailedDataLink"), F.when(~(k % 8).isin(1, 2), F.upper(say("seen", long))).otherwise("-").alias("broadCastDate"),
        F.when(~(k % 8).isin(2, 3), say("shown", short)).otherwise("").alias("exchdisstime"), say("o_orderdate", day).alias("filingDate"), F.when(k % 13 == 0, "R").otherwise("N").alias("reInd"), k.cast("string").alias("seqNumber"))
    newer = o.filter(k % 2 == 1).select(
        F.col("o_custkey").alias("symbol"), F.when(k % 10 == 3, "Integrated Filing- Governance").otherwise("Integrated Filing- Financials").alias("type"), F.upper(say("z", day)).alias("qe_Date"), F.expr(_WRITTEN).alias("consolidated"),
        F.when(k % 7 == 3, "https://archive/x").otherwise("https://archive/x.XML").alias("xbrl"), say("seen", long).alias("broadcast_Date"), say("shown", long).alias("creation_Date"), F.when(k % 13 == 0, "Revised").otherwise("Original").alias("type_Sub"), k.cast("string").alias("seq_Id"))
    both = filings.normalise_legacy(legacy).unionByName(filings.normalise_integrated(newer))
    return both.select("symbol", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "basis", "source", F.date_format("disclosed", "yyyy-MM-dd HH:mm:ss").alias("disclosed"), "revised", "seq")


# XBRL ----------------------------------------------------------------------------------------------------------------


def _context(name: str, start: str, end: str, member: str = "") -> str:
    return f"""'<xbrli:context id="{name}"><xbrli:entity/><xbrli:period><xbrli:startDate>' || {start} || '</xbrli:startDate><xbrli:endDate>' || {end} || '</xbrli:endDate></xbrli:period>{member}</xbrli:context>'"""


def _fact(tag: str, context: str, value: str) -> str:
    return f"""'<in-fin:{tag} contextRef="{context}" unitRef="u" decimals="2">' || {value} || '</in-fin:{tag}>'"""


_SEGMENT = '<xbrli:scenario><xbrldi:explicitMember dimension="d">m</xbrldi:explicitMember></xbrli:scenario>'
_EPS, _AFTER = filings.EPS_TAGS[:2]
_V = "(k % 900 + 1) || '.25'"
_INSTANCE = f"""'<xbrli:xbrl>' || CASE k % 7
 WHEN 0 THEN {_context('OneD', 's', 'e')} || {_context('FourD', 's0', 'e')} || {_context('Seg', 's', 'e', _SEGMENT)} || {_fact(_EPS, 'FourD', "'37.13'")} || {_fact(_EPS, 'Seg', "'99'")} || {_fact(_EPS, 'OneD', _V)}
 WHEN 1 THEN {_context('Seg', 's', 'e', _SEGMENT)} || {_fact(_EPS, 'OneD', _V)}
 WHEN 2 THEN {_context('OneD', 's0', 'e')} || {_fact(_EPS, 'OneD', _V)}
 WHEN 3 THEN {_context('OneD', 's', 'e')} || {_context('FourD', 's', 'e')} || {_fact(_EPS, 'FourD', "'47.96'")} || {_fact(_EPS, 'OneD', _V)}
 WHEN 4 THEN {_context('A', 's', 'e')} || {_context('B', 's', 'e')} || {_fact(_EPS, 'A', "'47.96'")} || {_fact(_EPS, 'B', _V)}
 WHEN 5 THEN {_context('A', 's', 'e')} || '<xbrli:context id="I"><xbrli:period><xbrli:instant>' || e || '</xbrli:instant></xbrli:period></xbrli:context>' || {_fact(_AFTER, 'A', "'1,' || (k % 900 + 100) || '.5'")} || {_fact('ProfitLossForPeriod', 'A', "(k % 5000 + 7)")}
  || {_fact('PaidUpValueOfEquityShareCapital', 'I', "'2,000'")} || {_fact('FaceValueOfEquityShareCapital', 'A', "'2'")}
 ELSE {_context('A', 's', 'e')} || {_fact('ProfitLossForPeriod', 'A', "'12'")} END || '</xbrli:xbrl>'"""


@query(f"""WITH o AS (SELECT o_orderkey AS k, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS s, strftime(last_day({_DAY}), '%Y-%m-%d') AS e, strftime(date_trunc('quarter', o_orderdate) - INTERVAL 6 MONTH, '%Y-%m-%d') AS s0 FROM orders),
x AS (SELECT *, {_INSTANCE} AS t FROM o),
cx AS (SELECT k, s, e, regexp_extract(c, 'id="([^"]+)"', 1) AS id, nullif(regexp_extract(c, 'startDate>([^<]+)<', 1), '') AS a, coalesce(nullif(regexp_extract(c, 'endDate>([^<]+)<', 1), ''), nullif(regexp_extract(c, 'instant>([^<]+)<', 1), '')) AS z, contains(c, 'explicitMember') AS dim
 FROM (SELECT k, s, e, unnest(regexp_extract_all(t, '<xbrli:context id="[^"]+">.*?</xbrli:context>')) AS c FROM x)),
q0 AS (SELECT k, id FROM cx WHERE a = s AND z = e AND NOT dim),
one AS (SELECT DISTINCT k FROM cx WHERE id = 'OneD'),
q AS (SELECT k, id FROM q0 UNION ALL SELECT k, 'OneD' FROM o WHERE k NOT IN (SELECT k FROM q0) AND k NOT IN (SELECT k FROM one)),
f AS (SELECT k, regexp_extract(c, '<in-fin:(\\w+)', 1) AS tag, regexp_extract(c, 'contextRef="([^"]+)"', 1) AS id, CAST(replace(regexp_extract(c, '>([^<]*)<', 1), ',', '') AS DOUBLE) AS v FROM (SELECT k, unnest(regexp_extract_all(t, '<in-fin:\\w+ contextRef="[^"]+"[^>]*>[^<]*<')) AS c FROM x)),
eps AS (SELECT f.k, tag, f.id, v FROM f JOIN q ON f.k = q.k AND f.id = q.id WHERE contains(tag, 'Basic')),
pick AS (SELECT k, min(tag) AS tag, count(DISTINCT v) AS n, max(CASE WHEN id = 'OneD' THEN v END) AS own, max(v) AS v FROM eps GROUP BY k),
extra AS (SELECT k, max(CASE WHEN tag = 'ProfitLossForPeriod' THEN v END) / (max(CASE WHEN contains(tag, 'PaidUp') THEN v END) / max(CASE WHEN contains(tag, 'FaceValue') THEN v END)) AS implied FROM f GROUP BY k)
SELECT o.k AS filing_id, CASE WHEN n = 1 THEN v WHEN n > 1 THEN own END AS eps, CASE WHEN n = 1 OR own IS NOT NULL THEN tag END AS eps_tag, CASE WHEN o.k % 7 IN (5, 6) THEN round(implied, 6) END AS implied,
 CASE WHEN o.k IN (SELECT k FROM one) AND o.k NOT IN (SELECT k FROM q0) THEN 'no_quarter_context' WHEN n IS NULL THEN 'no_eps' WHEN n > 1 AND own IS NULL THEN 'conflicting_eps' ELSE 'ok' END AS status,
 CASE WHEN o.k NOT IN (SELECT k FROM q0) AND o.k NOT IN (SELECT k FROM one) THEN 'oned_convention' WHEN n > 1 AND own IS NOT NULL THEN 'oned_preferred' ELSE 'defined' END AS via
FROM o LEFT JOIN pick ON pick.k = o.k LEFT JOIN extra ON extra.k = o.k""")
def xbrl_eps(spark, d):
    """An instance for each order, of seven makes: year-to-date contexts, dimensions, undefined and misdated contexts, conflicts, later tags, no figure."""
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), quarter.alias("period_start"), F.last_day(F.add_months(quarter, 2)).alias("period_end"), F.add_months(quarter, -6).cast("string").alias("s0"))
    docs = o.withColumns({"s": F.col("period_start").cast("string"), "e": F.col("period_end").cast("string")}).withColumn("xbrl", F.expr(_INSTANCE))
    found = filings.xbrl_eps(docs.select("k", "period_start", "period_end", "xbrl"))
    return found.select(F.col("k").alias("filing_id"), "found.eps", "found.eps_tag", F.round("found.implied", 6).alias("implied"), "found.status", "found.via")


# pages ---------------------------------------------------------------------------------------------------------------


def _lines(rows: list[tuple[str, str] | str], closed: bool = True) -> str:
    end = "</tr>" if closed else ""
    return " || ".join(f"'<tr><td colspan=2>{r}</td>{end}'" if isinstance(r, str) else f"'<TR><TD class=t1>{r[0]}</td><TD class=t0 nowrap>' || {r[1]} || '</td>{end}'" for r in rows)


_BANK = [("Net Profit (+) / Loss (-) for the period", "(i * 500 + 500)"), ("Face Value (in Rs.)", "'-'"), ("Paid-up Equity Share Capital (in Rs.)", "'2.00'"), ("Reserves &amp; surplus", "'1,000.00'"), ("Capital Adequacy Ratio", "'0.00'"),
         ("Basic EPS before Extraordinary items", "'7.77'"), ("Basic EPS  after Extraordinary items", "'0.01'"), ("Diluted EPS after Extraordinary items", "{eps}"), ("Gross/Net NPA", "'15.00'")]
_BEFORE = [("Net Profit / (Loss) for the period", "'75'"), ("Net Profit / (Loss) after taxes, minority interest and share of profit of associates", "(i * 100 + 100)"), ("Face Value&nbsp;(in Rs.)", "'10.00'"), ("Paid-up equity share capital", "'1000.00'"),
           "Earnings per share (before extraordinary items):", ("(a) Basic", "'3.21'"), "Earnings per share (after extraordinary items):", ("(a) <b>Basic</b>", "(i + 1)")]
_OPEN = [("Net Profit / (Loss) for the period", "(i * 100 + 300)"), ("Face Value (in Rs.)", "'2.00'"), ("Paid-up equity share capital", "'200.00'"), ("Basic EPS for continued and discontinued operations", "'0.00'"), ("Basic EPS for continuing operations", "(i + 3)")]
_NOTES = "'<tr><td>Notes To Accounts</td><td>x</td></tr><tr><td>Basic EPS after</td><td>1</td></tr></table>'"
_TABLE = f"""CASE i % 5 WHEN 0 THEN '<table>' || {_lines(_BEFORE)} || {_NOTES} WHEN 1 THEN '<table>' || {_lines([(a, b.replace('{eps}', '(i + 1)')) for a, b in _BANK])} || {_NOTES}
 WHEN 2 THEN '<table>' || {_lines(_OPEN, False)} || {_NOTES} WHEN 3 THEN '<table>' || {_lines([(a, b.replace('{eps}', "'9999'")) for a, b in _BANK])} || {_NOTES} ELSE '' END"""
_CLEAN = r"trim(regexp_replace(replace(replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
_PAGES = rf"""pg AS (SELECT page_id AS i, html || {_TABLE} AS page FROM pages),
rw AS (SELECT i, j, list_transform(regexp_extract_all(r, '(?is)<td[^>]*>(.*?)</td>', 1), lambda c: {_CLEAN}) AS c FROM (SELECT i, unnest(p[2:]) AS r, unnest(range(len(p) - 1)) AS j FROM (SELECT i, regexp_split_to_array(page, '(?i)<tr(?:\s[^>]*)?>') AS p FROM pg))),
kept AS (SELECT i, j, c, min(CASE WHEN starts_with(lower(c[1]), 'notes to accounts') THEN j END) OVER (PARTITION BY i) AS stop FROM rw WHERE len(c) > 0),
cell AS (SELECT i, j, c, coalesce(last_value(CASE WHEN len(c) = 1 THEN c[1] END IGNORE NULLS) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING), '') AS header FROM kept WHERE stop IS NULL OR j < stop),
lines AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos, c[1] AS label, c[2] AS value, header FROM cell WHERE len(c) = 2)"""


def _pages(spark, d):
    return tables.table(spark, d, "pages").withColumn("i", F.col("page_id")).withColumn("page", F.concat("html", F.expr(_TABLE)))


@query(f"WITH {_PAGES} SELECT i AS page_id, CAST(pos AS INT) AS pos, label, value, header FROM lines")
def html_rows(spark, d):
    """The rows of result tables in pages, closed or not, up to the notes."""
    return _pages(spark, d).select("page_id", F.posexplode(filings.result_rows(F.col("page"))).alias("pos", "x")).select("page_id", "pos", "x.label", "x.value", "x.header")


@query(f"""WITH {_PAGES}, num AS (SELECT *, TRY_CAST(replace(value, ',', '') AS DOUBLE) AS v, lower(label) AS a, lower(header) AS h FROM lines),
tries AS (SELECT i, pos, CASE WHEN starts_with(a, 'basic eps') AND contains(a, 'discontinued operations') AND contains(a, 'continued and') THEN 1 WHEN starts_with(a, 'basic eps') AND contains(a, 'after') THEN 2 WHEN starts_with(a, '(a) basic') AND contains(h, 'earnings per share') AND contains(h, 'after') THEN 3
 WHEN starts_with(a, 'basic eps') AND contains(a, 'continuing operations') THEN 4 WHEN starts_with(a, 'basic eps') AND contains(a, 'before') THEN 5 WHEN starts_with(a, '(a) basic') AND contains(h, 'earnings per share') AND contains(h, 'before') THEN 6 END AS t FROM num),
cand AS (SELECT i, t, min(pos) AS pos FROM tries WHERE t IS NOT NULL GROUP BY i, t),
need AS (SELECT i, min(CASE WHEN starts_with(a, 'face value') THEN pos END) AS fv, min(CASE WHEN contains(a, 'paid-up') OR contains(a, 'paid up') THEN pos END) AS pu,
 coalesce(CASE WHEN i % 2 = 0 THEN min(CASE WHEN (starts_with(a, 'net profit') AND contains(a, 'minority interest and share of')) OR starts_with(a, 'consolidated net profit') THEN pos END) END, min(CASE WHEN starts_with(a, 'net profit') AND contains(a, 'for the period') THEN pos END)) AS np, count(*) AS n FROM num GROUP BY i),
fit AS (SELECT c.i, c.t, s.s AS shift, e.v AS eps, p.v / (u.v / f.v) AS implied FROM cand c JOIN need USING (i) JOIN (VALUES (0), (1)) s(s) ON TRUE JOIN num e ON e.i = c.i AND e.pos = c.pos + s JOIN num f ON f.i = c.i AND f.pos = fv + s JOIN num u ON u.i = c.i AND u.pos = pu + s JOIN num p ON p.i = c.i AND p.pos = np
 WHERE f.v <> 0 AND u.v <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t, shift) AS r FROM fit WHERE abs(eps - implied) <= greatest(0.15 * abs(implied), 0.1))
SELECT pg.i AS page_id, round(eps, 4) AS eps, round(implied, 4) AS implied, shift, CASE WHEN need.n IS NULL THEN 'no_rows' WHEN fv IS NULL OR pu IS NULL OR np IS NULL OR pg.i NOT IN (SELECT i FROM cand) THEN 'missing_rows' WHEN best.i IS NULL THEN 'unvalidated' ELSE 'ok' END AS status
FROM pg LEFT JOIN need ON need.i = pg.i LEFT JOIN best ON best.i = pg.i AND r = 1""")
def html_eps(spark, d):
    """Earnings per share that reconcile with profit and shares, of four templates; other pages have none."""
    found = filings.html_eps(_pages(spark, d).select("page_id", "page", F.when(F.col("page_id") % 2 == 0, "consolidated").otherwise("standalone").alias("basis")))
    return found.select("page_id", F.round("found.eps", 4).alias("eps"), F.round("found.implied", 4).alias("implied"), "found.shift", "found.status")
