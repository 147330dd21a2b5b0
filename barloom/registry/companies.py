"""Verified queries on sources, calendars, joins, fundamentals, screens and sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import bar_windows as b, clock, fixed_values as fv
from barloom.operators import asof, features, history, joins, scoring, screen, sectors
from barloom.registry.core import query
from barloom.registry.market import (
    DELIVERY, RESULT_FEATURES, SIGNAL, day, delivery_days, rounded, signal_rows,
)
from barloom.registry.snippets import BARS, MARKET, SECTORS, TICKS, UNIVERSE, r, rs
from barloom.session import parted, stage
from barloom.sources import feeds, sinks
from barloom.sources.bindings import (
    HOLIDAYS, TODAY, bars_daily, brand_master, brand_number, listings, market_index, meeting_rows, part_master, quotes,
    result_feed, sector_index, stored_bars, table, trade_ticks, universe,
)

# ---- SQL building blocks ---------------------------------------------------------------------------


def fund_sql(key: str) -> str:
    cur, prev = "date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30'", "date BETWEEN DATE '1999-07-01' AND DATE '2000-06-30'"
    return f"""facts AS (SELECT {key}, s1 / 1000 AS sales, p1 / 1000 AS profit, alls / 1000 AS mcap, last_price, low / 100 - 5 AS pe,
  100 * (p1 - p0) / nullif(abs(p0), 0) AS pg, 100 * (s1 / s0 - 1) AS sg, q1 AS roce, da * 12 AS cfo, d1 * 20 AS de,
  100 * p1 / s1 + 15 AS opm, 100 * (d1 - d0) AS fii, (low / 100 - 5) / nullif(100 * (p1 - p0) / nullif(abs(p0), 0), 0) AS peg
 FROM (SELECT {key}, sum(CASE WHEN {cur} THEN price * qty END) AS s1, sum(CASE WHEN {prev} THEN price * qty END) AS s0,
  sum(CASE WHEN {cur} THEN price * qty * (0.06::DOUBLE - discount) END) AS p1, sum(CASE WHEN {prev} THEN price * qty * (0.06::DOUBLE - discount) END) AS p0,
  avg(CASE WHEN {cur} THEN qty END) AS q1, avg(CASE WHEN {cur} THEN discount END) AS d1, avg(CASE WHEN {prev} THEN discount END) AS d0,
  avg(CASE WHEN flag = 'A' THEN discount END) AS da, min(CASE WHEN {cur} THEN price END) AS low, sum(price * qty) AS alls,
  last(price ORDER BY date, k1, k2, k3, k4) AS last_price FROM ticks GROUP BY {key}))"""


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(1, (({x}) - {lo}::DOUBLE) / {hi - lo}::DOUBLE)) END"


def wavg(parts: list[tuple[float, str]]) -> str:
    top = " + ".join(f"coalesce({w}::DOUBLE * ({v}), 0)" for w, v in parts)
    low = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE {w}::DOUBLE END" for w, v in parts)
    return f"(({top}) / nullif({low}, 0))"


def score_sql(keep: str, source: str, adv: str = "CAST(NULL AS DOUBLE)") -> str:
    """fund_score over rows with pg, sg, roce, opm, cfo, de, pe, peg, fii."""
    return f"""fs1 AS (SELECT {keep}, {wavg([(.5, clip('ln(1 + greatest(-90, least(300, pg)) / 100)', 0, 1.4).replace(
        'CASE WHEN ln(1 + greatest(-90, least(300, pg)) / 100) IS NOT NULL', 'CASE WHEN pg IS NOT NULL')), (.5, clip('sg', 0, 60))])} AS growth,
  {wavg([(.4, clip('roce', 10, 35)), (.3, clip('opm', 8, 30)), (.3, clip('cfo', 0, 1))])} AS quality,
  {clip('1.5::DOUBLE - de', 0, 1.5)} AS balance,
  {wavg([(.5, f"CASE WHEN pe <= 0 THEN 0 ELSE {clip('60 - pe', 0, 50)} END"), (.5, f"CASE WHEN peg > 0 THEN {clip('2.5::DOUBLE - peg', 0, 2)} END")])} AS value,
  {clip('fii', 0, 2)} AS fiis, {clip(f'log10(greatest(0.1::DOUBLE, {adv}))', .3, 2).replace(f'CASE WHEN log10(greatest(0.1::DOUBLE, {adv})) IS NOT NULL', f'CASE WHEN {adv} IS NOT NULL')} AS liq
  FROM {source}),
scored AS (SELECT *, CASE WHEN growth IS NOT NULL OR quality IS NOT NULL OR value IS NOT NULL THEN 100 *
  {wavg([(.30, 'growth'), (.25, 'quality'), (.10, 'balance'), (.15, 'value'), (.10, 'fiis'), (.10, 'liq')])} END AS fund_score FROM fs1)"""


PARTS = f"WITH {TICKS}, {fund_sql('part_id')}"


# ---- source parsing --------------------------------------------------------------------------------

@query("src05_listed_equities", """SELECT 'P' || p_partkey AS symbol, trim(p_name) AS name, printf('PRT%08d', p_partkey) AS isin,
  ['EQ', 'BE', 'SM', 'GB'][p_size % 4 + 1] AS series, '' AS listed FROM part WHERE p_size % 4 IN (0, 1)""")
def listed(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("SYMBOL"), F.concat(F.lit("  "), "p_name").alias(" NAME OF COMPANY"),
        F.element_at(F.array(*[F.lit(f" {s} ") for s in ("EQ", "BE", "SM", "GB")]), F.col("p_size") % 4 + 1).alias(" SERIES"),
        F.format_string("PRT%08d", "p_partkey").alias(" ISIN NUMBER"))
    return feeds.listed_equities(raw)


@query("src06_universe", """WITH lists AS (
  SELECT c_custkey AS k, 0 AS p FROM customer WHERE c_custkey % 10 < 2 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 10 < 5
  UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 10 < 8 UNION ALL SELECT c_custkey, 3 FROM customer),
best AS (SELECT k, min(p) AS p FROM lists GROUP BY k)
SELECT 'C' || k AS symbol, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Other' ELSE c_mktsegment END AS sector,
  ['Large', 'Mid', 'Small', 'Micro'][p + 1] AS cap, printf('CUS%08d', k) AS isin, k % 20 = 0 AS flagship, 'NSE_EQ|' || printf('CUS%08d', k) AS key
FROM best JOIN customer ON c_custkey = k""")
def build_universe(spark, sf_dir):
    """Four overlapping constituent lists of customers; the first that has one sets its bucket."""
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey"), F.lit(" ")).alias("Symbol"), F.col("c_name").alias("Company Name"),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("Industry"),
        F.format_string("CUS%08d", "c_custkey").alias("ISIN Code"), "c_custkey")
    lists = [(bucket, rows.filter(F.col("c_custkey") % 10 < cut)) for bucket, cut in zip(fv.SIZE_BUCKETS, (2, 5, 8, 10))]
    return feeds.size_buckets(lists, rows.filter("c_custkey % 20 = 0"), at_least=100)


@query("src07_delivery_rows", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, 'P' || l_partkey AS symbol,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS deliv_qty, l_quantity AS traded_qty,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_discount END AS deliv_pct
FROM lineitem WHERE l_linenumber <> 5 AND l_returnflag <> 'N'""")
def delivery_rows(spark, sf_dir):
    """Line items spelled as a delivery file: blanks, dashes, a foreign series and unreadable quantities."""
    k = F.col("l_linenumber")
    raw = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias(" DATE1"), F.concat(F.lit("P"), "l_partkey").alias("SYMBOL"),
        F.when(F.col("l_returnflag") == "N", "GB").when(F.col("l_returnflag") == "A", " EQ").otherwise("ST ").alias(" SERIES"),
        F.when(k % 3 == 0, " -").otherwise(F.col("l_quantity").cast("string")).alias(" DELIV_QTY"),
        F.when(k == 5, "none").otherwise(F.col("l_quantity").cast("string")).alias(" TTL_TRD_QNTY"),
        F.when(k % 4 == 0, "").otherwise(F.col("l_discount").cast("string")).alias(" DELIV_PER"))
    return feeds.delivery_day(raw)


MEETINGS = """meetings AS (SELECT 500001 + o_custkey % 25 AS bse_code, CAST(o_orderdate AS DATE) AS result_date,
  'Company ' || (1 + o_custkey % 25) || ' Ltd-$' AS company, 'Steel' AS bm_industry, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'Results and dividend' ELSE 'Quarterly Results' END AS purpose
  FROM orders WHERE o_orderkey % 8 <> 6 AND o_orderkey % 50 <> 0 GROUP BY o_custkey % 25, CAST(o_orderdate AS DATE))"""


@query("src09_board_meetings", f"WITH {MEETINGS} SELECT bse_code, CAST(result_date AS VARCHAR) AS result_date, company, bm_industry, purpose FROM meetings")
def board_meetings(spark, sf_dir):
    return feeds.parse_board_meetings(meeting_rows(spark, sf_dir)).select(
        "bse_code", day("result_date"), "company", "bm_industry", "purpose")


@query("src09_board_meeting_counts", f"""WITH {MEETINGS}, n AS (SELECT count(*) AS all_, count(*) FILTER (o_orderkey % 8 = 6 OR o_orderkey % 50 = 0) AS bad FROM orders)
SELECT all_ AS rows_read, bad AS rows_unparseable, all_ - bad - (SELECT count(*) FROM meetings) AS duplicates_removed FROM n""")
def board_meeting_counts(spark, sf_dir):
    return feeds.board_meeting_counts(meeting_rows(spark, sf_dir))


FEED = """feed AS (SELECT 'Brand#' || (1 + o_custkey % 25) AS symbol, printf('INE%07d', 1 + o_custkey % 25) AS isin, 'Company ' || (1 + o_custkey % 25) AS company,
  CAST(o_orderdate AS DATE) AS result_date,
  arg_min(CASE WHEN o_orderkey % 2 = 0 THEN '-' WHEN o_orderkey % 5 = 0 THEN 'Realty' ELSE 'Healthcare' END, o_orderkey) AS ind
  FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0 GROUP BY o_custkey % 25, CAST(o_orderdate AS DATE))"""


@query("src10_upcoming_results", f"""WITH {FEED} SELECT symbol, isin, company, CAST(result_date AS VARCHAR) AS result_date, nullif(ind, '-') AS industry FROM feed""")
def upcoming_results(spark, sf_dir):
    return feeds.upcoming_results(result_feed(spark, sf_dir)).select("symbol", "isin", "company", day("result_date"), "industry")


@query("src11_past_result_dates", f"""WITH {FEED} SELECT symbol, count(*) AS n, CAST(max(result_date) AS VARCHAR) AS newest, string_agg(CAST(result_date AS VARCHAR), ',' ORDER BY result_date DESC) AS dates
FROM (SELECT DISTINCT symbol, result_date FROM feed WHERE result_date < DATE '{TODAY}' AND result_date >= DATE '{TODAY}' - 1095) GROUP BY symbol""")
def past_dates(spark, sf_dir):
    """Distinct dates per symbol, newest first; a symbol has at most one per calendar day."""
    dates = feeds.past_result_dates(result_feed(spark, sf_dir), TODAY)
    return dates.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("date").cast("string").alias("newest"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.col("date").cast("string")), asc=False)).alias("dates"))


@query("src12_filing_feeds", """SELECT c_custkey AS company_id, strftime(l_shipdate + INTERVAL (l_orderkey % 1440) MINUTE - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS at,
  CASE WHEN l_linenumber = 1 THEN 'Announcement' ELSE 'Line ' || l_linenumber END AS title,
  CASE WHEN l_linestatus = 'F' THEN 'ships by ' || l_returnflag ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'more ' ELSE 'head ' END || l_returnflag END AS text,
  CASE WHEN l_linenumber = 1 THEN '' ELSE CASE WHEN l_linestatus = 'F' THEN 'Line ' || l_linenumber ELSE 'General' END END AS category,
  CASE WHEN l_linestatus = 'F' THEN 'NSE filing' ELSE 'BSE filing' END AS source, 'exchange' AS source_type, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber <> 7 GROUP BY ALL""")
def filing_feeds(spark, sf_dir):
    """Line items spelled as the two exchanges' announcement feeds; line 7 has no readable time."""
    lines = table(spark, sf_dir, "lineitem")
    sent = parted(lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag"), lines, "l_orderkey").join(
        parted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = sent.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.timestamp_seconds(F.unix_timestamp("l_shipdate") + (F.col("l_orderkey") % 1440) * 60)
    k = F.col("l_linenumber")
    line = F.when(k == 1, "").otherwise(F.concat(F.lit("Line "), k))
    a = rows.filter("l_linestatus = 'F'").select(
        F.col("c_custkey").alias("company_id"), F.when(k == 7, "soon").otherwise(F.date_format(at, "dd-MMM-yyyy HH:mm:ss")).alias("an_dt"),
        line.alias("desc"), F.concat(F.lit(" ships by "), "l_returnflag").alias("attchmntText"),
        F.lit(None).cast("string").alias("attchmntFile"))
    c = rows.filter("l_linestatus = 'O'").select(
        F.col("c_custkey").alias("company_id"), F.lit(None).cast("string").alias("NEWS_DT"),
        F.when(k == 7, "soon").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("DT_TM"),
        line.alias("NEWSSUB"), F.when(k % 2 == 0, F.concat(F.lit("more "), "l_returnflag")).otherwise("").alias("MORE"),
        F.concat(F.lit("head "), "l_returnflag").alias("HEADLINE"),
        F.when(k != 1, "General").alias("CATEGORYNAME"), F.lit("").alias("ATTACHMENTNAME"))
    both = screen.union_all(feeds.filings_from_symbol_feed(a), feeds.filings_from_code_feed(c))
    facts = ["company_id", "at", "title", "text", "category", "source", "source_type"]
    told = both.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm")).select(*facts)
    return parted(told, lines, "company_id", "at").groupBy(*facts).agg(F.count("*").alias("n"))


@query("src13_instruments", """SELECT CAST(s AS VARCHAR) AS bse_code, isin, 'B' || s AS bse_symbol, CASE WHEN s % 5 <> 0 THEN 'N' || s END AS nse_symbol, name FROM (
  SELECT p_partkey AS s, printf('PRT%08d', p_partkey) AS isin, p_name AS name FROM part WHERE p_size % 7 <> 0)""")
def instruments(spark, sf_dir):
    """Parts spelled as an instrument master with two segments; some rows are other instrument types."""
    p = table(spark, sf_dir, "part")
    isin = F.format_string("PRT%08d", "p_partkey")
    base = p.select(F.lit("BSE_EQ").alias("segment"), F.when(F.col("p_size") % 7 == 0, "F").otherwise("A").alias("instrument_type"),
                    F.col("p_partkey").cast("string").alias("exchange_token"), isin.alias("isin"),
                    F.concat(F.lit("B"), "p_partkey").alias("trading_symbol"), F.col("p_name").alias("name"))
    other = p.select(F.lit("NSE_EQ").alias("segment"), F.when(F.col("p_partkey") % 5 == 0, "IDX").otherwise("EQ").alias("instrument_type"),
                     F.lit("0").alias("exchange_token"), isin.alias("isin"),
                     F.concat(F.lit("N"), "p_partkey").alias("trading_symbol"), F.col("p_name").alias("name"))
    return feeds.listing_table(base.unionByName(other))


@query("src14_typed_master", f"""{PARTS} SELECT CASE WHEN part_id % 9 <> 0 THEN part_id END AS bse_code, {r('sales', 6)}, {r('opm', 4)} FROM facts""")
def typed_master(spark, sf_dir):
    raw = part_master(trade_ticks(spark, sf_dir)).withColumn(
        "BSE Code", F.when(F.col("part_id") % 9 == 0, "unknown").otherwise(F.col("part_id").cast("string")))
    return feeds.typed_master(raw).select(
        F.col("BSE Code").alias("bse_code"), (F.round("Sales latest quarter", 6) + 0.0).alias("sales"), (F.round("OPM", 4) + 0.0).alias("opm"))


@query("src15_fundamentals_upsert", f"""{PARTS}, old AS (SELECT part_id, opm FROM facts WHERE part_id % 3 <> 0),
new AS (SELECT part_id, opm + CASE WHEN part_id % 4 = 0 THEN 2 ELSE 1 END AS opm FROM facts WHERE part_id % 2 = 0 AND part_id % 10 <> 0)
SELECT part_id, round(opm, 5) + CAST(0 AS DOUBLE) AS opm FROM (SELECT * FROM old WHERE part_id NOT IN (SELECT part_id FROM new) UNION ALL SELECT * FROM new)""")
def fundamentals_upsert(spark, sf_dir):
    """Even parts are uploaded again (every fourth twice, every tenth without ISIN)."""
    m = part_master(trade_ticks(spark, sf_dir))
    up = m.filter("part_id % 2 = 0").withColumns({
        "OPM": F.col("OPM") + 1, "ISIN Code": F.when(F.col("part_id") % 10 != 0, F.col("ISIN Code"))})
    again = up.filter("part_id % 4 = 0").withColumns({"OPM": F.col("OPM") + 1, "row_no": F.col("row_no") + 1})
    return feeds.upsert_fundamentals(m.filter("part_id % 3 <> 0"), up.unionByName(again)).select(
        "part_id", (F.round("OPM", 5) + 0.0).alias("opm"))


@query("src16_provider_fundamentals", """SELECT CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'none' WHEN s_suppkey % 3 = 0 THEN 'master' ELSE 'provider' END AS source,
  CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE s_acctbal END AS price,
  CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 THEN round(s_acctbal * 1000 / 1e7, 8) + CAST(0 AS DOUBLE) END AS mcap,
  CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 THEN s_nationkey * 0.01::DOUBLE END AS de
FROM supplier""".replace("CASE WHEN s_suppkey % 4 = 0 THEN 'none' WHEN s_suppkey % 3 = 0 THEN 'master'", "CASE WHEN s_suppkey % 3 = 0 THEN 'master' WHEN s_suppkey % 4 = 0 THEN 'none'"))
def provider_fundamentals(spark, sf_dir):
    """Suppliers as provider quotes: the first listing has no price for odd keys, none at all for every fourth."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    null = F.lit(None).cast("double")

    def listing(no: int, price):
        return s.select(
            F.concat(F.lit("S"), k).alias("symbol"), F.lit(no).alias("suffix_no"), price.alias("currentPrice"), null.alias("regularMarketPrice"),
            null.alias("trailingPE"), (F.col("s_acctbal") * 1000).alias("marketCap"), F.col("s_nationkey").cast("double").alias("debtToEquity"),
            null.alias("operatingMargins"), null.alias("earningsQuarterlyGrowth"), null.alias("revenueGrowth"), F.lit("Tools").alias("industry"))

    raw = listing(0, F.when((k % 2 == 0) & (k % 4 != 0), F.col("s_acctbal"))).unionByName(
        listing(1, F.when(k % 4 != 0, F.col("s_acctbal"))))
    rows = s.select(
        F.concat(F.lit("S"), k).alias("nse_symbol"), k.cast("long").alias("k"),
        F.when(k % 3 == 0, "master").otherwise("none").alias("fundamentals_source"),
        F.when(k % 3 == 0, 1.0).alias("Current Price"), null.alias("Market Capitalization"), null.alias("Debt to equity"))
    return feeds.fill_from_provider(rows, feeds.provider_fundamentals(raw)).select(
        "k", F.col("fundamentals_source").alias("source"), F.col("Current Price").alias("price"),
        (F.round("Market Capitalization", 8) + 0.0).alias("mcap"), F.col("Debt to equity").alias("de"))


# ---- clock and calendar ---------------------------------------------------------------------------------

HOL = "[" + ", ".join(f"DATE '{d}'" for d in HOLIDAYS) + "]"


@query("dat01_trading_days", f"""WITH day AS (SELECT CAST(g AS DATE) AS d FROM range(DATE '1990-01-01', DATE '2040-01-01', INTERVAL 1 DAY) AS x(g)),
calendar AS (SELECT d, coalesce(sum(CASE WHEN isodow(d) < 6 AND NOT list_contains({HOL}, d) THEN 1 ELSE 0 END)
  OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM day)
SELECT o_orderkey AS k, CAST(greatest(e.before - s.before, 0) AS BIGINT) AS sessions
FROM orders JOIN calendar s ON s.d = CAST(o_orderdate AS DATE) CROSS JOIN (SELECT before FROM calendar WHERE d = DATE '{TODAY}') e""")
def trading_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), clock.trading_days(
        F.to_date("o_orderdate"), F.to_date(F.lit(TODAY)), clock.holiday_literal(*HOLIDAYS)).cast("long").alias("sessions"))


LOCAL = """local AS (SELECT event_id, ts, t, isodow(t) AS dow, hour(t) * 60 + minute(t) AS m FROM (SELECT event_id, ts, ts + INTERVAL 330 MINUTE AS t FROM events))"""
STATUS = """status AS (SELECT *, CASE WHEN dow >= 6 THEN 'closed' WHEN m < 540 THEN 'before-open' WHEN m < 555 THEN 'pre-open' WHEN m < 930 THEN 'open' ELSE 'closed' END AS s FROM local)"""


@query("dat02_market_status", f"""WITH {LOCAL}, {STATUS} SELECT event_id, s AS status, CASE WHEN s IN ('open', 'pre-open') THEN NULL
  WHEN dow < 6 AND m < 555 THEN CASE WHEN 555 - m < 60 THEN (555 - m) || 'm' ELSE ((555 - m) // 60) || 'h ' || ((555 - m) % 60) || 'm' END
  ELSE CASE dow WHEN 5 THEN '3d' WHEN 6 THEN '2d' ELSE '1d' END END AS opens_in,
  CASE s WHEN 'open' THEN 30 WHEN 'pre-open' THEN 60 WHEN 'closed' THEN 300 ELSE 600 END AS poll FROM status""")
def market_status(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", clock.market_status(ts).alias("status"), clock.time_until_open(ts).alias("opens_in"),
        clock.poll_seconds(ts).alias("poll"))


@query("dat03_exchange_dates", """SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS exchange_day,
  CAST(floor(epoch(ts + INTERVAL 330 MINUTE)) AS BIGINT) AS axis FROM events""")
def exchange_dates(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", clock.exchange_date(ts).cast("string").alias("exchange_day"), clock.local_epoch_seconds(ts).alias("axis"))


# ---- as-of joins and behaviour around events --------------------------------------------------------------

PAST = "past AS (SELECT symbol, min(date) AS date FROM bars WHERE date < DATE '2001-06-30' GROUP BY symbol, date_trunc('quarter', date))"


def quarter_starts(bars: DataFrame) -> DataFrame:
    """The first session of each quarter stands for a past result date."""
    return bars.filter(f"date < '{TODAY}'").groupBy("symbol", F.trunc("date", "quarter").alias("q")).agg(
        F.min("date").alias("date")).drop("q")


AROUND = f"""{BARS}, {MARKET}, {PAST}, nb AS (SELECT b.*, last_value(m.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS mkt,
  row_number() OVER (PARTITION BY symbol ORDER BY b.date) - 1 AS pos FROM bars b LEFT JOIN market m ON m.date = b.date),
ev AS (SELECT p.symbol, p.date, n.pos FROM past p ASOF JOIN nb n ON p.symbol = n.symbol AND p.date <= n.date),
re AS (SELECT e.symbol, e.date, a.c / z.c - 1 AS pre_ret, (a.c / z.c - 1) - (a.mkt / z.mkt - 1) AS pre_excess, x.o / q.c - 1 AS gap, x.c / a.c - 1 AS reaction_2d
  FROM ev e JOIN nb a ON a.symbol = e.symbol AND a.pos = e.pos - 1 JOIN nb z ON z.symbol = e.symbol AND z.pos = e.pos - 11
  JOIN nb q ON q.symbol = e.symbol AND q.pos = e.pos JOIN nb x ON x.symbol = e.symbol AND x.pos = e.pos + 1)"""


@query("win14_result_drift", f"WITH {AROUND} SELECT symbol, CAST(date AS VARCHAR) AS date, {rs('pre_ret', 'pre_excess', 'gap', 'reaction_2d')} FROM re")
def result_drift(spark, sf_dir):
    bars = stored_bars(spark, sf_dir)
    return history.result_events(bars, quarter_starts(bars), market_index(bars)).select(
        "symbol", day(), *rounded("pre_ret", "pre_excess", "gap", "reaction_2d"))


@query("agg06_results_history", f"""WITH {AROUND} SELECT symbol, count(*) AS hist_events, {r('avg(pre_excess)', 6, 'hist_pre_excess_mean')},
 {r('median(pre_excess)', 6, 'hist_pre_excess_median')}, {r('avg(CASE WHEN pre_excess > 0 THEN 1.0 ELSE 0 END)', 6, 'hist_pre_hit_rate')},
 {r('avg(gap)', 6, 'hist_gap_mean')}, {r('avg(abs(gap))', 6, 'hist_gap_abs_mean')}, {r('avg(reaction_2d)', 6, 'hist_reaction_mean')},
 {r('avg(abs(reaction_2d))', 6, 'hist_reaction_abs_mean')}, {r('avg(CASE WHEN reaction_2d > 0 THEN 1.0 ELSE 0 END)', 6, 'hist_reaction_pos_rate')},
 array_to_string(list_slice(list(CAST(date AS VARCHAR) ORDER BY date DESC), 1, 8), ',') AS latest FROM re GROUP BY symbol""")
def results_history(spark, sf_dir):
    bars = stored_bars(spark, sf_dir)
    h = history.results_history(bars, quarter_starts(bars), market_index(bars))
    names = [c for c in h.columns if c.startswith("hist_") and c not in ("hist_events", "hist_detail")]
    return h.select("symbol", "hist_events", *rounded(*names),
                    F.concat_ws(",", F.transform("hist_detail", lambda x: x["date"].cast("string"))).alias("latest"))


@query("jon07_first_session_after", f"""WITH {BARS}, asked AS (SELECT DISTINCT 'Brand#' || (1 + o_custkey % 25) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT a.symbol, CAST(a.date AS VARCHAR) AS date, CAST(b.date AS VARCHAR) AS session FROM asked a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.date <= b.date""")
def first_session_after(spark, sf_dir):
    return asof.first_session_on_or_after(order_dates(spark, sf_dir), bars_daily(spark, sf_dir), F.col("date")).select(
        "symbol", day(), F.col("found").cast("string").alias("session"))


def order_dates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("symbol"), F.to_date("o_orderdate").alias("date"))


ITEM_TIMES = """stamped AS (SELECT o_orderkey AS k, 'Brand#' || (1 + o_custkey % 25) AS symbol, o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE AS ts FROM orders),
eff AS (SELECT *, CASE WHEN hour(t) * 60 + minute(t) >= 930 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) - 1 END AS d FROM (SELECT *, ts + INTERVAL 330 MINUTE AS t FROM stamped))"""


def order_times(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("symbol"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 1440) * 60).alias("ts"))


@query("jon08_reference_session", f"""WITH {BARS}, {ITEM_TIMES}
SELECT k, CAST(b.date AS VARCHAR) AS session FROM eff e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.d >= b.date""")
def reference_session(spark, sf_dir):
    items = order_times(spark, sf_dir).withColumn("date", history.effective_date(F.col("ts")))
    found = asof.last_session_on_or_before(items, bars_daily(spark, sf_dir), F.col("date"))
    return items.join(found, ["symbol", "date"]).select("k", F.col("found").cast("string").alias("session"))


REACTION = f"""{BARS}, {ITEM_TIMES}, rb AS (SELECT *, nullif(stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 0) AS sd FROM (
  SELECT *, row_number() OVER w AS n, ln(c / lag(c) OVER w) AS lr, c / lag(c, 5) OVER w - 1 AS pre, count(*) OVER (PARTITION BY symbol) AS total,
  first_value(c) OVER (PARTITION BY symbol ORDER BY date DESC) AS last_c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))),
reaction AS (SELECT e.k, b.pre AS pre_move, b.pre / (b.sd * sqrt(5)) AS pre_move_z, CASE WHEN total > n THEN last_c / c - 1 END AS post_move,
  CASE WHEN total > n THEN (last_c / c - 1) / (b.sd * sqrt(least(total - n, 20))) END AS post_move_z, CASE WHEN total > n THEN total - n END AS post_sessions
  FROM eff e ASOF JOIN rb b ON e.symbol = b.symbol AND e.d >= b.date WHERE total >= 30 AND n >= 25)"""


@query("win15_price_reaction", f"""WITH {REACTION} SELECT e.k, {r('pre_move', 4)}, {r('pre_move_z', 2)}, {r('post_move', 4)}, {r('post_move_z', 2)},
  CAST(post_sessions AS DOUBLE) AS post_sessions FROM eff e LEFT JOIN reaction USING (k)""")
def price_reaction(spark, sf_dir):
    return history.price_reactions(order_times(spark, sf_dir), bars_daily(spark, sf_dir)).select(
        "k", *rounded("pre_move", "post_move", digits=4), *rounded("pre_move_z", "post_move_z", digits=2),
        F.col("post_sessions").cast("double").alias("post_sessions"))


@query("jon06_benchmark_alignment", f"""WITH {BARS}, {MARKET}, thin AS (SELECT * FROM market WHERE day(date) % 3 <> 0)
SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, CAST(CAST(last_value(t.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS FLOAT) AS DOUBLE) AS mkt
FROM bars b LEFT JOIN thin t ON t.date = b.date""")
def benchmark_alignment(spark, sf_dir):
    """A benchmark that lacks every third day, so the carry-forward shows."""
    bars = bars_daily(spark, sf_dir)
    thin = market_index(bars).filter(F.dayofmonth("date") % 3 != 0)
    return features.align_benchmark(bars, thin, ["date"], "mkt").select(
        "symbol", day(), F.col("mkt").cast("float").cast("double").alias("mkt"))


@query("jon09_align_by_date", f"""WITH {BARS} SELECT CAST(date AS VARCHAR) AS date, x.c AS a, y.c AS b FROM
 (SELECT date, c FROM bars WHERE symbol = 'Brand#1') x FULL JOIN (SELECT date, c FROM bars WHERE symbol = 'Brand#2') y USING (date)""")
def align_by_date(spark, sf_dir):
    bars = bars_daily(spark, sf_dir).select("symbol", "date", "c")
    one = lambda s: bars.filter(F.col("symbol") == s).drop("symbol")
    return asof.align_by_date(one("Brand#1"), one("Brand#2")).select(day(), F.col("a.c").alias("a"), F.col("b.c").alias("b"))


# ---- identity, calendar, enrichment -------------------------------------------------------------------------

BRAND_MASTER = f"""{fund_sql('symbol')}, master AS (SELECT *, n, 'Company ' || n AS name, 500000 + n AS code, CASE WHEN n % 5 <> 0 THEN printf('INE%07d', n) END AS isin,
  ['Pharmaceuticals', 'Software Products', 'Steel', 'Cement', 'Retailing'][n % 5 + 1] AS industry
  FROM (SELECT *, CAST(split_part(symbol, '#', 2) AS INT) AS n FROM facts) WHERE n % 7 <> 0)"""
LISTINGS = """listings AS (SELECT bse_code, CASE WHEN n % 9 <> 0 THEN isin END AS isin, 'B' || n AS bse_symbol, CASE WHEN n % 4 <> 0 THEN symbol END AS nse_symbol,
  CASE WHEN n % 3 = 0 THEN upper(name) ELSE name || '.' END AS name, n FROM (SELECT *, CAST(split_part(symbol, '#', 2) AS INT) AS n FROM universe))"""


@query("jon01_identity_resolution", f"""WITH {BARS}, {UNIVERSE}, {BRAND_MASTER}, {LISTINGS}, {MEETINGS}
SELECT m.bse_code, CAST(m.result_date AS VARCHAR) AS result_date, coalesce(l.nse_symbol, f.symbol) AS nse_symbol, coalesce(l.isin, f.isin) AS isin,
  CASE WHEN f.code IS NULL THEN 'none' ELSE 'master' END AS fundamentals_source, {r('f.opm', 5, 'opm')}
FROM meetings m LEFT JOIN listings l USING (bse_code) LEFT JOIN master f ON f.isin = l.isin OR
  (f.code = m.bse_code AND NOT EXISTS (SELECT 1 FROM master g WHERE g.isin = l.isin))""")
def identity(spark, sf_dir):
    ticks = trade_ticks(spark, sf_dir)
    meetings = feeds.parse_board_meetings(meeting_rows(spark, sf_dir))
    out = joins.resolve_meetings(meetings, listings(universe(bars_daily(spark, sf_dir))), brand_master(ticks))
    return out.select("bse_code", day("result_date"), "nse_symbol", "isin", "fundamentals_source", (F.round("OPM", 5) + 0.0).alias("opm"))


@query("jon02_company_profiles", f"""WITH {BARS}, {UNIVERSE}, {BRAND_MASTER}, {LISTINGS},
q AS (SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 3 = 0 THEN 'BRAND#' || (1 + c_custkey % 25) END AS symbol0,
  CASE WHEN c_custkey % 3 = 1 THEN printf('INE%07d', 1 + c_custkey % 25) END AS isin0, CASE WHEN c_custkey % 3 = 2 THEN 500001 + c_custkey % 25 END AS code0 FROM customer),
q2 AS (SELECT q.*, coalesce(isin0, s.isin, c.isin) AS isin FROM q LEFT JOIN listings s ON upper(s.nse_symbol) = symbol0 LEFT JOIN listings c ON c.bse_code = code0),
q3 AS (SELECT q2.ask_id, q2.isin, code0, coalesce(symbol0, upper(l.nse_symbol)) AS symbol, l.name AS lname, l.bse_code AS lcode FROM q2 LEFT JOIN listings l ON l.isin = q2.isin),
q4 AS (SELECT q3.*, coalesce(f.name, g.name) AS fname, coalesce(f.code, g.code) AS fcode, coalesce(f.sales, g.sales) AS sales, coalesce(f.mcap, g.mcap) AS mcap
  FROM q3 LEFT JOIN master f ON f.isin = q3.isin LEFT JOIN master g ON upper(g.symbol) = q3.symbol AND f.symbol IS NULL)
SELECT ask_id, symbol, isin, coalesce(CASE WHEN lname = upper(lname) THEN 'Company ' || split_part(lname, ' ', 2) ELSE rtrim(lname, '.') END, fname) AS name,
  CASE WHEN lname IS NOT NULL THEN fname END AS short_name, CAST(coalesce(code0, fcode, lcode) AS BIGINT) AS bse_code, {r('nullif(sales, 0) * 4', 6, 'annual_revenue_cr')}, {r('mcap', 6, 'market_cap_cr')} FROM q4""")
def profiles(spark, sf_dir):
    """Customers ask for companies by symbol, by ISIN or by code."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(
        k.alias("ask_id"), F.when(k % 3 == 0, F.concat(F.lit("Brand#"), 1 + k % 25)).alias("symbol"),
        F.when(k % 3 == 1, F.format_string("INE%07d", 1 + k % 25)).alias("isin"),
        F.when(k % 3 == 2, 500001 + k % 25).alias("bse_code"))
    li = listings(universe(bars_daily(spark, sf_dir))).withColumn("nse_symbol", F.upper("nse_symbol"))
    out = joins.company_profiles(asked, li, brand_master(trade_ticks(spark, sf_dir)))
    return out.select("ask_id", "symbol", "isin", "name", "short_name", F.col("bse_code").cast("long").alias("bse_code"),
                      *rounded("annual_revenue_cr", "market_cap_cr"))


CAL_DAYS = 45


def calendar_entries(spark, sf_dir) -> DataFrame:
    """Uploaded board meetings (priority 0) and the exchange's feed (priority 1)."""
    li = listings(universe(bars_daily(spark, sf_dir)))
    up = feeds.parse_board_meetings(meeting_rows(spark, sf_dir)).join(li, "bse_code").select(
        "isin", F.lit("upload").alias("source"), F.lit(0).alias("priority"), "result_date", F.col("nse_symbol").alias("symbol"),
        "company", F.col("bse_code").cast("long").alias("bse_code"), F.lit("").alias("industry"))
    feed = feeds.upcoming_results(result_feed(spark, sf_dir)).select(
        "isin", F.lit("nse").alias("source"), F.lit(1).alias("priority"), "result_date", "symbol", "company",
        F.lit(None).cast("long").alias("bse_code"), "industry")
    return up.unionByName(feed)


CALENDAR = f"""{LISTINGS}, {MEETINGS}, {FEED}, entries AS (
  SELECT l.isin, 'upload' AS source, 0 AS p, result_date, l.nse_symbol AS symbol, 'Company ' || (m.bse_code - 500000) || ' Ltd' AS company, m.bse_code AS bse_code, CAST(NULL AS VARCHAR) AS industry
  FROM meetings m JOIN listings l USING (bse_code) UNION ALL
  SELECT isin, 'nse', 1, result_date, symbol, company, NULL, nullif(ind, '-') FROM feed),
calendar AS (SELECT isin, min(result_date) AS result_date, first(symbol ORDER BY p, result_date) FILTER (symbol IS NOT NULL) AS symbol,
  first(company ORDER BY p, result_date) AS company, first(bse_code ORDER BY p, result_date) FILTER (bse_code IS NOT NULL) AS bse_code,
  first(industry ORDER BY p, result_date) FILTER (industry IS NOT NULL) AS industry,
  array_to_string(list_distinct(list(source ORDER BY p)), ',') AS srcs, bool_or(p = 0) AS has_up, bool_or(p = 1) AS has_feed
  FROM entries WHERE isin IS NOT NULL AND result_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + {CAL_DAYS} GROUP BY isin)"""


@query("jon03_calendar_merge", f"""WITH {BARS}, {UNIVERSE}, {CALENDAR} SELECT isin, CAST(result_date AS VARCHAR) AS result_date, symbol, company, CAST(bse_code AS DOUBLE) AS bse_code, industry,
  CASE WHEN has_up AND has_feed THEN 'upload,nse' WHEN has_up THEN 'upload' ELSE 'nse' END AS sources FROM calendar""")
def calendar_merge(spark, sf_dir):
    return merged_calendar(spark, sf_dir).select(
        "isin", day("result_date"), "symbol", "company", F.col("bse_code").cast("double").alias("bse_code"), "industry",
        F.concat_ws(",", "calendar_sources").alias("sources"))


def merged_calendar(spark, sf_dir) -> DataFrame:
    return joins.merge_calendars(calendar_entries(spark, sf_dir), TODAY, CAL_DAYS)


@query("jon04_fundamentals_join", f"""WITH {BARS}, {UNIVERSE}, {BRAND_MASTER} SELECT u.isin, CASE WHEN m.isin IS NULL THEN 'none' ELSE 'master' END AS fund_source, m.industry,
  {r('nullif(sales, 0) * 4', 6, 'annual_revenue_cr')}, {r('mcap', 6, 'market_cap_cr')} FROM universe u LEFT JOIN master m USING (isin)""")
def fundamentals_join(spark, sf_dir):
    members = universe(bars_daily(spark, sf_dir)).select("isin")
    return joins.with_fundamentals(members, brand_master(trade_ticks(spark, sf_dir))).select(
        "isin", "fund_source", F.col("Industry").alias("industry"), *rounded("annual_revenue_cr", "market_cap_cr"))


@query("jon05_sector_benchmark", """SELECT p_partkey AS k, CASE p_size % 6 WHEN 0 THEN 'Nifty Energy' WHEN 1 THEN 'Nifty Pharma' WHEN 2 THEN 'Nifty IT'
  WHEN 3 THEN CASE p_type WHEN 'STANDARD' THEN NULL ELSE 'Nifty Metal' END WHEN 4 THEN 'Nifty Infra' ELSE NULL END AS sector_index FROM part""")
def sector_benchmark(spark, sf_dir):
    """Labels that hit the exact table, a keyword of the second label, or nothing."""
    k = F.col("p_size") % 6
    first = F.when(k == 0, " Oil  Gas & Consumable Fuels ").when(k == 1, "Unlisted").when(k == 2, "INFORMATION technology") \
        .when(k == 4, "Steel pipes").otherwise("")
    second = F.when(k == 0, "software").when(k == 1, "Biotech tools").when(
        (k == 3) & (F.col("p_type") != "STANDARD"), "Copper Wire").when(k == 4, "Capital Goods")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), joins.sector_index_for(first, second).alias("sector_index"))


@query("jon13_first_source_wins", f"""{PARTS}, a AS (SELECT part_id, 'provider' AS source, opm FROM facts WHERE part_id % 2 = 0), b AS (SELECT part_id, 'csv' AS source, sg AS opm FROM facts WHERE part_id % 3 = 0)
SELECT part_id, source, {r('opm', 5)} FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE part_id NOT IN (SELECT part_id FROM a))""")
def first_source(spark, sf_dir):
    m = part_master(trade_ticks(spark, sf_dir))
    a = m.filter("part_id % 2 = 0").select("part_id", F.lit("provider").alias("source"), F.col("OPM").alias("opm"))
    c = m.filter("part_id % 3 = 0").select("part_id", F.lit("csv").alias("source"), F.col("YOY Quarterly sales growth").alias("opm"))
    return joins.first_source_wins(a, c, "part_id").select("part_id", "source", *rounded("opm", digits=5))


# ---- fundamentals scores --------------------------------------------------------------------------------------

@query("sco05_fundamental_score", f"{PARTS}, {score_sql('part_id', 'facts')} SELECT part_id, {r('fund_score', 5)} FROM scored")
def fundamental_score(spark, sf_dir):
    m = part_master(trade_ticks(spark, sf_dir))
    return scoring.add_fundamental_score(m, include_liquidity=False).select("part_id", *rounded("fund_score", digits=5))


@query("agg08_weighted_mean", f"{PARTS} SELECT part_id, round({wavg([(.5, 'pg'), (.3, 'roce'), (.2, 'opm')])}, 5) + CAST(0 AS DOUBLE) AS mean FROM facts")
def weighted_mean(spark, sf_dir):
    from barloom.functions.scalars import weighted_mean as wm

    m = part_master(trade_ticks(spark, sf_dir))
    mean = wm([(.5, F.col("YOY Quarterly profit growth")), (.3, F.col("Return on capital employed")), (.2, F.col("OPM"))])
    return m.select("part_id", (F.round(mean, 5) + 0.0).alias("mean"))


QUALITY = """quality AS (SELECT part_id, round(greatest(0, least(100, 50 + coalesce(least(20, sg / 100 * 80), 0)
  + CASE WHEN de IS NULL THEN 0 WHEN de * 3 < 0.5 THEN 15 WHEN de * 3 < 1 THEN 8 WHEN de * 3 < 2 THEN 2 WHEN de * 3 < 3 THEN -5 ELSE -15 END
  + coalesce(least(15, opm / 100 * 50), 0) + coalesce(least(10, pg / 100 * 40), 0)
  + CASE WHEN pe IS NULL THEN 0 WHEN pe < 0 THEN -10 WHEN pe > 80 THEN -10 WHEN pe > 50 THEN -5 WHEN pe BETWEEN 12 AND 30 THEN 5 ELSE 0 END)), 1) AS score FROM facts)"""


def provider_rows(spark, sf_dir) -> DataFrame:
    m = part_master(trade_ticks(spark, sf_dir))
    return m.select(
        "part_id", (F.col("YOY Quarterly sales growth") / 100).alias("roe"), (F.col("Debt to equity") * 300).alias("debt_equity"),
        (F.col("OPM") / 100).alias("net_margin"), (F.col("YOY Quarterly profit growth") / 100).alias("rev_growth"),
        F.col("Price to Earning").alias("pe"))


@query("sco08_provider_quality", f"{PARTS}, {QUALITY} SELECT part_id, CAST(score AS DOUBLE) AS score FROM quality")
def provider_quality(spark, sf_dir):
    rows = provider_rows(spark, sf_dir)
    return rows.select("part_id", scoring.provider_quality_score(rows).alias("score"))


@query("agg12_mean_quality", f"{PARTS}, {QUALITY} SELECT count(*) AS loaded, round(avg(CAST(score AS DOUBLE)), 4) AS mean_score FROM quality")
def mean_quality(spark, sf_dir):
    rows = provider_rows(spark, sf_dir)
    return rows.select(scoring.provider_quality_score(rows).alias("score")).agg(
        F.count("*").alias("loaded"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("sco09_clip_helpers", """SELECT l_orderkey AS k, l_linenumber AS n, round(avg(greatest(0, least(1, (l_quantity - 10) / 30))), 6) AS q,
  count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS numbers FROM lineitem GROUP BY ALL""")
def clip_helpers(spark, sf_dir):
    """Clipping to 0..1 and text that is or is not a number."""
    from barloom.functions.scalars import clip_range, number

    text = F.when(F.col("l_returnflag") == "A", "12.5").when(F.col("l_returnflag") == "N", "NaN").otherwise("n/a")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.round(F.avg(clip_range(F.col("l_quantity"), 10, 40)), 6).alias("q"), F.count(number(text)).alias("numbers"))


# ---- filters ---------------------------------------------------------------------------------------------------

SCREEN = f"""{SIGNAL}, {UNIVERSE}, q0 AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY date) AS pc, lead(date) OVER (PARTITION BY symbol ORDER BY date) IS NULL AS is_last,
  row_number() OVER (PARTITION BY symbol ORDER BY date) AS n,
  avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING) AS a200, avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS a50,
  avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS a14, max(h) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS hi52,
  min(l) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS lo52, avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS v20 FROM bars),
q1 AS (SELECT *, CAST(split_part(symbol, '#', 2) AS INT) AS num FROM q0 WHERE is_last),
screen AS (SELECT q1.symbol, u.name, u.sector, u.cap, q1.c AS ltp, q1.v AS volume, v20, q1.v / v20 AS relVol, hi52, lo52, CASE WHEN q1.n >= 200 THEN a200 END AS sma200, a50 AS sma50, a14 AS sma14,
  coalesce(CASE WHEN num % 3 = 0 THEN 1.5::DOUBLE - num % 4 END, CASE WHEN num % 3 <> 2 AND num % 6 <> 5 THEN (q1.c - q1.pc) / (q1.c - (q1.c - q1.pc)) * 100 END,
           CASE WHEN num % 6 <> 5 THEN (q1.c - q1.pc) / q1.pc * 100 END) AS changePct,
  signal_score, CASE WHEN signal_score >= 40 THEN 'STRONG BUY' WHEN signal_score >= 15 THEN 'BUY' WHEN signal_score <= -40 THEN 'STRONG SELL'
  WHEN signal_score <= -15 THEN 'SELL' ELSE 'NEUTRAL' END AS signal, CASE WHEN num % 2 = 0 THEN CAST(40 + num AS DOUBLE) END AS fs,
  t.rsi14 AS rsi, t.ema21, t.ema50, t.macd_hist
  FROM q1 JOIN sig USING (symbol) JOIN universe u USING (symbol) JOIN (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1) t USING (symbol))"""


def screener(spark, sf_dir) -> DataFrame:
    """The screener table: quotes, listing facts, signals and fundamentals in one row per symbol."""
    from barloom.plans.screener import screener_table

    bars = stored_bars(spark, sf_dir)
    n = brand_number(F.col("symbol"))
    scores = bars.select("symbol").distinct().filter(n % 2 == 0).select("symbol", (40 + n).cast("double").alias("fundamentalScore"))
    return screener_table(quotes(bars), bars, universe(bars), scores)


@query("pip05_screener_table", f"""{SCREEN} SELECT symbol, name, sector, cap, ltp, {r('changePct', 5)}, volume, {rs('relVol', digits=5)}, CAST(signal_score AS DOUBLE) AS signalScore, signal, hi52 AS week52High,
 lo52 AS week52Low, {rs('sma200', 'sma50', 'sma14', 'rsi', digits=5)}, fs AS fundamentalScore FROM screen""")
def screener_query(spark, sf_dir):
    return screener(spark, sf_dir).select(
        "symbol", "name", "sector", "cap", "ltp", *rounded("changePct", digits=5), "volume", *rounded("relVol", digits=5),
        F.col("signalScore").cast("double").alias("signalScore"), "signal", "week52High", "week52Low",
        *rounded("sma200", "sma50", "sma14", "rsi", digits=5), "fundamentalScore")


@query("flt01_rule_screen", f"""{SCREEN}, tested AS (SELECT *, coalesce(rsi > 55, false) AS a, coalesce(lower(signal) = 'strong buy', false) AS b, coalesce(ltp > sma200, false) AS c,
  fs IS NOT NULL AND fs <> 44 AS d FROM screen) SELECT symbol FROM tested WHERE (((true AND a) OR b) AND c) OR d""")
def rule_screen(spark, sf_dir):
    """rsi > 55 OR signal = 'Strong Buy' AND price > sma200 OR fund != 44, folded left to right."""
    return screen.rule_screen(screener(spark, sf_dir), [
        {"logic": "AND", "field": "RSI", "op": ">", "value": "55"},
        {"logic": "OR", "field": "Signal", "op": "=", "value": "'Strong Buy'"},
        {"logic": "AND", "field": "price", "op": ">", "value": "SMA200"},
        {"logic": "OR", "field": "fund", "op": "!=", "value": 44}]).select("symbol")


@query("flt02_text_search", "SELECT p_partkey AS k FROM part WHERE contains(lower('P' || p_partkey || ' ' || p_name), 'red w')")
def text_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("symbol", F.concat(F.lit("P"), "p_partkey"))
    return p.filter(screen.contains_text("Red W", "symbol", "p_name")).select(F.col("p_partkey").alias("k"))


@query("flt03_equality_filters", f"{SCREEN} SELECT symbol FROM screen WHERE sector = 'Healthcare' OR (cap = 'Mid' AND signal = 'BUY')")
def equality_filters(spark, sf_dir):
    e = screen.equals_unless_all
    return screener(spark, sf_dir).filter(
        (e("sector", "Healthcare") & e("cap", "All")) | (e("cap", "Mid") & e("signal", "BUY"))).select("symbol")


@query("flt04_technical_presets", f"""{SCREEN} SELECT symbol, coalesce(ltp > sma200, false) AS p200, coalesce(ltp > sma50, false) AS p50, coalesce(sma50 > sma200, false) AS g50,
  coalesce(sma14 > sma50, false) AS g14, coalesce(ltp >= hi52 * 0.98::DOUBLE, false) AS hi FROM screen""")
def technical_presets(spark, sf_dir):
    names = ["p200", "p50", "g50", "g14", "hi"]
    return screener(spark, sf_dir).select("symbol", *[c.alias(n) for n, c in zip(names, screen.technical_presets().values())])


@query("flt05_watchlist", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#3', 'Brand#8') GROUP BY 1")
def watchlist(spark, sf_dir):
    watched = spark.createDataFrame([("Brand#3",), ("Brand#8",)], "symbol string")
    return screen.only_watched(trade_ticks(spark, sf_dir), watched).groupBy(F.col("line.l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@query("flt06_fundamental_presets", f"""{PARTS} SELECT part_id, coalesce(pg >= 25 AND sg >= 15, false) AS growth, coalesce(roce >= 20 AND de <= 0.5::DOUBLE AND cfo >= 0.7::DOUBLE, false) AS quality,
  coalesce(pe <= 25 AND peg <= 1.5::DOUBLE AND pg >= 20, false) AS value, coalesce(opm >= 15 AND pg >= 30, false) AS margin FROM facts""")
def fundamental_presets(spark, sf_dir):
    names = ["growth", "quality", "value", "margin"]
    return part_master(trade_ticks(spark, sf_dir)).select("part_id", *[
        screen.within_bounds(bounds).alias(n) for n, bounds in zip(names, fv.FUNDAMENTAL_PRESETS.values())])


@query("flt11_prj04_look_back_and_run_rate", f"""WITH {ITEM_TIMES} SELECT k, date_diff('day', CAST(ts AS DATE), DATE '{TODAY}') AS days_left FROM stamped
WHERE ts >= TIMESTAMP '{TODAY}' - INTERVAL 365 DAY AND ts < TIMESTAMP '{TODAY}'""")
def look_back(spark, sf_dir):
    days = screen.look_back_days(900)
    end = F.lit(TODAY).cast("timestamp")
    items = order_times(spark, sf_dir).filter((F.col("ts") >= end - F.expr(f"INTERVAL {days} DAY")) & (F.col("ts") < end))
    return items.select("k", F.datediff(F.to_date(F.lit(TODAY)), F.to_date("ts")).cast("long").alias("days_left"))


# ---- projections ------------------------------------------------------------------------------------------------

@query("prj01_change_percent", f"{SCREEN} SELECT symbol, {r('changePct', 6)} FROM screen")
def change_percent(spark, sf_dir):
    q = quotes(bars_daily(spark, sf_dir))
    return q.select("symbol", screen.change_percent(F.col("given_pct"), F.col("net_change"), F.col("ltp"), F.col("prev_close")).alias(
        "changePct")).select("symbol", *rounded("changePct"))


@query("prj02_price_source", f"""{PARTS}, live AS (SELECT part_id, CASE WHEN part_id % 3 = 0 THEN last_price WHEN part_id % 3 = 1 THEN 0 END AS live, CASE WHEN part_id % 2 = 0 THEN low END AS close_, mcap FROM (SELECT *, (pe + 5) * 100 AS low FROM facts))
SELECT part_id, {r('coalesce(nullif(live, 0), nullif(close_, 0), mcap)', 8, 'price')}, CASE WHEN nullif(live, 0) IS NOT NULL THEN 'live' WHEN nullif(close_, 0) IS NOT NULL THEN 'last_close' ELSE 'fundamentals' END AS source FROM live""")
def price_source(spark, sf_dir):
    k = F.col("part_id")
    price, label = screen.price_with_source(
        F.when(k % 3 == 0, F.col("Current Price")).when(k % 3 == 1, 0.0),
        F.when(k % 2 == 0, (F.col("Price to Earning") + 5) * 100), F.col("Market Capitalization"))
    return part_master(trade_ticks(spark, sf_dir)).select("part_id", (F.round(price, 8) + 0.0).alias("price"), label.alias("source"))


@query("prj03_relative_volume", f"""WITH {BARS}, x AS (SELECT symbol, date, v, count(*) OVER w AS n, avg(v) OVER w AS a FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN n = 20 THEN a END', 6, 'avg_volume')}, {r('CASE WHEN n = 20 THEN v / nullif(a, 0) END', 6, 'rel_vol')} FROM x""")
def relative_volume(spark, sf_dir):
    rows = bars_daily(spark, sf_dir).select("symbol", "date", "v", b.full_average("v", 20).alias("avg_volume"))
    return rows.select("symbol", day(), "avg_volume", screen.relative_volume(F.col("v"), F.col("avg_volume")).alias("rel_vol")) \
        .select("symbol", "date", *rounded("avg_volume", "rel_vol"))


@query("prj05_range_position", f"{SCREEN} SELECT symbol, {r('greatest(0, least(100, (ltp - lo52) / nullif(hi52 - lo52, 0) * 100))', 5, 'position')} FROM screen")
def range_position(spark, sf_dir):
    return screener(spark, sf_dir).select(
        "symbol", screen.range_position(F.col("week52Low"), F.col("week52High"), F.col("ltp")).alias("position")).select(
        "symbol", *rounded("position", digits=5))


@query("prj06_position_pnl", f"""WITH {BARS}, last_c AS (SELECT symbol, arg_max(c, date) AS ltp FROM bars GROUP BY symbol),
held AS (SELECT 'Brand#' || (1 + c_custkey % 30) AS symbol, c_custkey % 9 + 1 AS qty, abs(c_acctbal) AS buy, c_custkey AS k FROM customer)
SELECT k, {r('(coalesce(ltp, 0) - buy) * qty', 4, 'pnl')}, {r('(coalesce(ltp, 0) - buy) / nullif(buy, 0) * 100', 4, 'pnl_pct')} FROM held LEFT JOIN last_c USING (symbol)""")
def position_pnl(spark, sf_dir):
    """Each customer holds one brand; five brands do not exist and have no quote."""
    k = F.col("c_custkey")
    held = table(spark, sf_dir, "customer").select(
        k.alias("k"), F.concat(F.lit("Brand#"), 1 + k % 30).alias("symbol"), (k % 9 + 1).alias("qty"), F.abs("c_acctbal").alias("buy_price"))
    last = bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by("c", "date").alias("ltp"))
    out = screen.positions(held, last)
    return held.select("k", "symbol", "qty", "buy_price").join(
        out.distinct(), ["symbol", "qty", "buy_price"]).select("k", *rounded("pnl", "pnl_pct", digits=4))


@query("prj07_buy_checklist", f"""{SCREEN} SELECT symbol, ltp > coalesce(ema50, 0) AS price_above_ema50, coalesce(ema21, 0) > coalesce(ema50, 0) AS trend_up, coalesce(rsi, 0) > 50 AS momentum_positive,
  coalesce(macd_hist, 0) > 0 AS macd_bullish FROM screen""")
def buy_checklist(spark, sf_dir):
    rows = screener(spark, sf_dir).withColumn("momentum_score", F.lit(None).cast("double"))
    return rows.select("symbol", *screen.buy_checklist())


@query("prj08_name_cleanup", """SELECT c_custkey AS k, trim(regexp_replace(c_name || ' Ltd-$', '[\\s-]*\\$+\\s*$', '')) AS company,
  CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Works' ELSE lower(c_mktsegment) || ' works' END AS shown FROM customer""")
def name_cleanup(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 2 == 0, F.concat("c_mktsegment", F.lit(" WORKS."))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" works")))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), joins.strip_marks(F.concat("c_name", F.lit(" Ltd-$"))).alias("company"), joins.display_name(raw).alias("shown"))


# ---- aggregates, sorts, top lists --------------------------------------------------------------------------------

@query("agg01_breadth", f"""{SCREEN} SELECT count(*) AS total, count(*) FILTER (changePct > 0) AS advancing, count(*) FILTER (changePct < 0) AS declining,
  count(*) FILTER (NOT coalesce(changePct <> 0, false)) AS unchanged FROM screen""")
def breadth(spark, sf_dir):
    return sectors.breadth(screener(spark, sf_dir))


@query("agg02_sector_rollup", f"""{SCREEN} SELECT sector, count(*) AS n, count(*) FILTER (changePct > 0) AS adv, count(*) FILTER (changePct < 0) AS dec,
  count(*) FILTER (NOT coalesce(changePct <> 0, false)) AS flat, {r('median(changePct)', 5, 'today')}, {r('median(signal_score)', 5, 'score')},
  arg_max(symbol, (changePct, symbol)) FILTER (changePct IS NOT NULL) AS best, arg_min(symbol, (changePct, symbol)) FILTER (changePct IS NOT NULL) AS worst FROM screen GROUP BY sector""")
def sector_rollup(spark, sf_dir):
    rows = screener(spark, sf_dir).withColumn("signal_score", F.col("signalScore"))
    return sectors.sector_rollup(rows).select("sector", "n", "adv", "dec", "flat", *rounded("today", "score", digits=5), "best", "worst")


INDEX_PERF = """mret AS (SELECT date, n, c / lag(c, 1) OVER w - 1 AS m1, c / lag(c, 5) OVER w - 1 AS m5, c / lag(c, 20) OVER w - 1 AS m20, c / lag(c, 60) OVER w - 1 AS m60
  FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM market) WINDOW w AS (ORDER BY date) QUALIFY row_number() OVER (ORDER BY date DESC) = 1),
iret AS (SELECT sector, date, n, c / lag(c, 1) OVER w - 1 AS ret_1d, c / lag(c, 5) OVER w - 1 AS ret_5d, c / lag(c, 20) OVER w - 1 AS ret_20d, c / lag(c, 60) OVER w - 1 AS ret_60d,
  c > avg(c) OVER (PARTITION BY sector ORDER BY date ROWS 49 PRECEDING) AS above
  FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY date) AS n FROM sectors) WINDOW w AS (PARTITION BY sector ORDER BY date) QUALIFY row_number() OVER (PARTITION BY sector ORDER BY date DESC) = 1),
perf AS (SELECT sector AS index_name, iret.date AS as_of, ret_1d, ret_5d, ret_20d, ret_60d, above, ret_1d - m1 AS rel_1d, ret_5d - m5 AS rel_5d, ret_20d - m20 AS rel_20d, ret_60d - m60 AS rel_60d
  FROM iret LEFT JOIN mret ON mret.n >= 61 WHERE iret.n >= 61)"""


@query("agg04_index_performance", f"""WITH {BARS}, {UNIVERSE}, {MARKET}, {SECTORS}, {INDEX_PERF} SELECT index_name, CAST(as_of AS VARCHAR) AS as_of,
  {rs('ret_1d', 'ret_5d', 'ret_20d', 'ret_60d', 'rel_1d', 'rel_5d', 'rel_20d', 'rel_60d')}, above AS above_50dma FROM perf""")
def index_performance(spark, sf_dir):
    return index_rows(spark, sf_dir).select(
        "index_name", day("as_of"), *rounded(*[f"{p}_{k}d" for p in ("ret", "rel") for k in (1, 5, 20, 60)]), "above_50dma")


def index_rows(spark, sf_dir) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    index = sector_index(bars, universe(bars)).withColumnRenamed("sector", "symbol")
    return sectors.index_performance(index, market_index(bars))


@query("agg03_sector_trend", f"""WITH {BARS}, {UNIVERSE}, {MARKET}, {SECTORS}, {INDEX_PERF},
own AS (SELECT u.sector, count(*) AS n, count(*) FILTER (bars > 61) AS h, median(o5) FILTER (bars > 61) AS o5, median(o20) FILTER (bars > 61) AS o20, median(o60) FILTER (bars > 61) AS o60 FROM (
  SELECT symbol, count(*) OVER (PARTITION BY symbol) AS bars, (c / lag(c, 5) OVER w - 1) * 100 AS o5, (c / lag(c, 20) OVER w - 1) * 100 AS o20, (c / lag(c, 60) OVER w - 1) * 100 AS o60 FROM (
    SELECT * FROM bars JOIN universe USING (symbol) WHERE sector <> 'Realty' OR CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0 OR date >= DATE '2001-10-20')
  WINDOW w AS (PARTITION BY symbol ORDER BY date) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) x JOIN universe u USING (symbol) GROUP BY u.sector)
SELECT own.sector, own.n, h AS with_history, {r('CASE WHEN h >= greatest(3, own.n * 0.5) THEN o5 - m5 * 100 ELSE rel_5d * 100 END', 5, 'rel5')}, {r('CASE WHEN h >= greatest(3, own.n * 0.5) THEN o20 - m20 * 100 ELSE rel_20d * 100 END', 5, 'rel20')},
 {r('CASE WHEN h >= greatest(3, own.n * 0.5) THEN o60 - m60 * 100 ELSE rel_60d * 100 END', 5, 'rel60')},
 CASE WHEN h >= greatest(3, own.n * 0.5) THEN 'median of ' || h || ' stocks' WHEN index_name IS NOT NULL THEN index_name || ' index (proxy)' END AS trend_source, h < greatest(3, own.n * 0.5) AND rel_5d IS NOT NULL AS proxy
FROM own CROSS JOIN mret LEFT JOIN perf ON perf.index_name = own.sector""")
def sector_trend(spark, sf_dir):
    """Odd brands of one sector keep only their newest weeks, so that sector falls back to its index."""
    bars = stored_bars(spark, sf_dir)
    members = universe(bars)
    own_bars = bars.join(members.select("symbol", "sector"), "symbol").filter(
        (F.col("sector") != "Realty") | (brand_number(F.col("symbol")) % 2 == 0) | (F.col("date") >= "2001-10-20"))
    market = sectors.stock_returns(market_index(bars).withColumn("symbol", F.lit("market")))
    m = market.agg(F.first(F.struct("own_5", "own_20", "own_60"))).scalar()
    stocks = sectors.stock_returns(own_bars).join(members.select("symbol", "sector"), "symbol").withColumn("_m", m)
    for k in (5, 20, 60):
        stocks = stocks.withColumn(f"m_{k}", F.col("_m")[f"own_{k}"] / 100)
    index = index_rows(spark, sf_dir).withColumn("sector", F.col("index_name"))
    return sectors.sector_trend(stocks, index).select("sector", "n", "with_history", *rounded("rel5", "rel20", "rel60", digits=5), "trend_source", "proxy")


@query("win16_rank", f"""{PARTS}, {score_sql('part_id', 'facts')} SELECT part_id, CAST(CASE WHEN fund_score IS NOT NULL THEN row_number() OVER (ORDER BY round(fund_score, 1) DESC NULLS LAST, part_id) END AS DOUBLE) AS rank FROM scored""")
def rank(spark, sf_dir):
    m = part_master(trade_ticks(spark, sf_dir))
    scored = scoring.add_fundamental_score(m, include_liquidity=False).select("part_id", F.round("fund_score", 1).alias("score"))
    return screen.global_rank(scored, "score", "part_id").select("part_id", F.col("rank").cast("double").alias("rank"))


@query("srt01_top_k_then_enrich", f"""{PARTS}, {score_sql('part_id, sales, opm', 'facts')} SELECT part_id, {r('fund_score', 4, 'score')}, {r('opm', 4)} FROM scored WHERE fund_score IS NOT NULL ORDER BY fund_score DESC, part_id LIMIT 60""")
def top_k(spark, sf_dir):
    """The best 60 by score first, and only those joined with more facts."""
    m = part_master(trade_ticks(spark, sf_dir))
    scored = scoring.add_fundamental_score(m, False, "score").select("part_id", "score")
    best = screen.best_first(scored, 60, F.desc_nulls_last("score"), F.asc("part_id")).filter("score is not null")
    return m.select("part_id", F.col("OPM").alias("opm")).join(best, "part_id").select("part_id", *rounded("score", "opm", digits=4))


@query("srt02_nulls_lowest", f"""{PARTS} SELECT part_id, {r('pg', 4)}, row_number() OVER (ORDER BY pg ASC NULLS FIRST, part_id) AS up,
row_number() OVER (ORDER BY pg DESC NULLS LAST, part_id) AS down FROM facts""")
def nulls_lowest(spark, sf_dir):
    m = part_master(trade_ticks(spark, sf_dir)).select("part_id", F.col("YOY Quarterly profit growth").alias("pg"))
    for name, descending in (("up", False), ("down", True)):
        m = screen.row_positions(m, [screen.nulls_as_lowest("pg", descending), F.asc("part_id")], name)
    return m.select("part_id", *rounded("pg", digits=4), "up", "down")


@query("srt03_nulls_last", f"""{PARTS} SELECT part_id, {r('coalesce(pg, sg)', 4, 'v')}, row_number() OVER (ORDER BY coalesce(pg, sg) ASC NULLS LAST, part_id) AS up,
row_number() OVER (ORDER BY coalesce(pg, sg) DESC NULLS LAST, part_id) AS down FROM facts""")
def nulls_last(spark, sf_dir):
    m = part_master(trade_ticks(spark, sf_dir)).select(
        "part_id", F.coalesce("YOY Quarterly profit growth", "YOY Quarterly sales growth").alias("v"))
    for name, descending in (("up", False), ("down", True)):
        m = screen.row_positions(m, [screen.nulls_always_last(F.col("v"), descending), F.asc("part_id")], name)
    return m.select("part_id", *rounded("v", digits=4), "up", "down")


@query("srt04_sector_order", f"""{SCREEN}, g AS (SELECT sector || '/' || cap AS sector, count(*) AS n, count(*) FILTER (changePct > 0) AS adv, median(changePct) AS today,
  median(lr5) AS rel5, median(lr20) AS rel20 FROM screen JOIN (SELECT symbol, (c / lag(c, 5) OVER w - 1) * 100 AS lr5, (c / lag(c, 20) OVER w - 1) * 100 AS lr20, lead(date) OVER w IS NULL AS newest FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) USING (symbol)
  WHERE newest GROUP BY ALL)
SELECT sector, row_number() OVER (ORDER BY n < 3, today DESC NULLS LAST, sector) AS by_today, row_number() OVER (ORDER BY n < 3, rel5 DESC NULLS LAST, sector) AS by_rel5,
  row_number() OVER (ORDER BY n < 3, rel20 DESC NULLS LAST, sector) AS by_rel20, row_number() OVER (ORDER BY n < 3, adv / n DESC, sector) AS by_breadth FROM g""")
def sector_order(spark, sf_dir):
    """Sectors by size bucket in each of the four orders; groups under three stocks stand last."""
    rows = screener(spark, sf_dir).withColumns({"sector": F.concat_ws("/", "sector", "cap"), "signal_score": F.col("signalScore")})
    rows = stage(rows.select("symbol", "sector", "changePct", "signal_score"))
    moves = sectors.stock_returns(bars_daily(spark, sf_dir)).select("symbol", "own_5", "own_20").join(rows.select("symbol", "sector"), "symbol")
    trend = moves.groupBy("sector").agg(F.median("own_5").alias("rel5"), F.median("own_20").alias("rel20"))
    out = sectors.sector_rollup(rows).join(trend, "sector", "left")
    for metric in ("today", "rel5", "rel20", "breadth"):
        out = screen.row_positions(out, [*sectors.sector_order(metric), F.asc("sector")], f"by_{metric}")
    return out.select("sector", *[F.col(f"by_{m}").cast("long").alias(f"by_{m}") for m in ("today", "rel5", "rel20", "breadth")])


@query("srt05_top_per_group", f"""WITH {TICKS} SELECT symbol, k1, k2, k3, k4, price FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY price DESC, k1, k2, k3, k4) <= 24""")
def top_per_group(spark, sf_dir):
    ticks = trade_ticks(spark, sf_dir)
    top = screen.top_per_group(ticks, ["symbol"], [F.desc("price"), F.asc("seq")], 24, salt_on="seq")
    return top.select("symbol", F.col("line.l_orderkey").alias("k1"), F.col("line.l_linenumber").alias("k2"), F.col("line.l_partkey").alias("k3"),
                      F.col("line.l_suppkey").alias("k4"), "price")


@query("set03_symbol_union", """SELECT DISTINCT 'C' || o_custkey AS symbol FROM orders UNION SELECT DISTINCT 'C' || c_custkey FROM customer WHERE c_acctbal < 0""")
def symbol_union(spark, sf_dir):
    traded = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("symbol"))
    owing = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return screen.symbol_union(traded, owing)


@query("snk03_strict_clean", """SELECT l_orderkey AS k, l_linenumber AS n, round(sum(CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END), 4) AS v,
  CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS shipped, count(CASE WHEN l_discount <> 0 THEN 1 END) AS kept FROM lineitem GROUP BY ALL""")
def strict_clean(spark, sf_dir):
    """Rates with NaN and infinity where the discount is zero, also inside an array and a struct."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    rate = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, nan).otherwise(inf)).otherwise(F.col("l_tax") / F.col("l_discount"))
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rate.alias("v"), F.array(rate).alias("a"), F.struct(rate.alias("x")).alias("s"), "l_shipdate")
    c = sinks.strict_clean(raw)
    return c.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.round(F.sum("v"), 4).alias("v"), F.min("l_shipdate").alias("shipped"), F.count(F.coalesce(F.get("a", F.lit(0)), F.col("s.x"))).alias("kept"))
