"""Verified queries on whole plans and on the scores that need their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import clock, fixed_values as fv
from barloom.operators import features, joins, scoring, screen
from barloom.plans import company_events as ce, pre_result_scan, result_screen as rscreen
from barloom.registry.companies import (
    AROUND, BRAND_MASTER, CAL_DAYS, CALENDAR, HOL, LISTINGS, MEETINGS, REACTION, merged_calendar, quarter_starts, score_sql,
)
from barloom.registry.core import query
from barloom.registry.events import ITEMS, NOW, STORY, SUMMARY, brand_aliases, stop_list
from barloom.registry.market import DELIVERY_TREND, RESULT_FEATURES, day, delivery_days, rounded, scanner_rows
from barloom.registry.snippets import ALL_FEATURES, BARS, FEATURES, MARKET, RSI_EXP, TICKS, UNIVERSE, r, rs
from barloom.session import fresh_dir, stage
from barloom.sources import feeds, sinks
from barloom.sources.bars import roll_up_ticks
from barloom.sources.bindings import (
    HOLIDAYS, INDEXES, TODAY, bars_daily, brand_master, brand_number, filings, index_bars, listings, market_index, meeting_rows, monthly_bars,
    stored_bars, table,
    trade_ticks, universe,
)

TREND = DELIVERY_TREND.replace(TICKS + ", ", "").replace(TICKS + ",\n", "")



def bars_since(days: int, today: str) -> str:
    """The bars of the last ``days`` days."""
    return BARS.replace("FROM ticks GROUP BY", f"FROM ticks WHERE date BETWEEN DATE '{today}' - {days} AND DATE '{today}' GROUP BY")


HISTORY = AROUND.replace(f"{BARS}, {MARKET}, ", "").replace("WHERE date < DATE '2001-06-30' GROUP", f"WHERE date < DATE '{TODAY}' AND date >= DATE '{TODAY}' - 1095 GROUP") + """, hist AS (SELECT symbol, count(*) AS hist_events, avg(pre_excess) AS hist_mean, avg(CASE WHEN pre_excess > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS hit FROM re GROUP BY symbol)"""
EVENTS = SUMMARY.replace(REACTION, REACTION.replace(BARS + ", ", "")).replace(NOW, f"{TODAY} 00:00:00").replace(
    "AS src FROM orders)", f"AS src FROM orders WHERE o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE >= TIMESTAMP '{TODAY}' - INTERVAL 30 DAY AND o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE < TIMESTAMP '{TODAY}')")


def days_sql(start: str, end: str) -> str:
    return f"""CASE WHEN {end} <= {start} THEN 0 ELSE len(list_filter(range({start}, {end}, INTERVAL 1 DAY), lambda d: isodow(d) < 6 AND NOT list_contains({HOL}, CAST(d AS DATE)))) END"""


def c01(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0, least(1, {x})) END"


def pre_score_sql(source: str) -> str:
    """rs_z, score and stage over rows with td and the feature columns."""
    return f"""p1 AS (SELECT *, CASE WHEN rel_sec_5d IS NOT NULL THEN rel_sec_5d ELSE rel_mkt_5d END AS r5, CASE WHEN rel_sec_5d IS NOT NULL THEN rel_sec_10d ELSE rel_mkt_10d END AS r10,
  CASE WHEN rel_sec_5d IS NOT NULL THEN rel_sec_20d ELSE rel_mkt_20d END AS r20 FROM {source}),
p2 AS (SELECT *, (0.5::DOUBLE * r5 + 0.3::DOUBLE * r10 + 0.2::DOUBLE * coalesce(r20, r10)) / (sigma_daily * sqrt(10)) AS rs_z, accel / (sigma_daily * sqrt(10)) AS accel_z FROM p1),
p3 AS (SELECT *, CAST(CASE WHEN td < 2 THEN 0.1 WHEN td < 5 THEN 0.5 WHEN td <= 15 THEN 1.0 WHEN td <= 25 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS k1, {c01('(rs_z + 0.25::DOUBLE) / 1.5')} AS k2, {c01('(accel_z + 0.5::DOUBLE) / 2')} AS k3,
  CASE WHEN rvol_5d IS NOT NULL THEN CASE WHEN updown_vol_ratio IS NULL THEN CASE WHEN rvol_5d > 4 THEN 0.5 ELSE {c01('(rvol_5d - 0.9::DOUBLE) / 0.8::DOUBLE')} END
    ELSE 0.75::DOUBLE * CASE WHEN rvol_5d > 4 THEN 0.5 ELSE {c01('(rvol_5d - 0.9::DOUBLE) / 0.8::DOUBLE')} END + 0.25::DOUBLE * {c01('(updown_vol_ratio - 0.8::DOUBLE) / 1.2::DOUBLE')} END END AS vs,
  CASE WHEN deliv_qty_ratio IS NOT NULL THEN 0.7::DOUBLE * {c01('(deliv_qty_ratio - 0.9::DOUBLE) / 0.8::DOUBLE')} + CASE WHEN deliv_pct_change IS NULL THEN 0.15::DOUBLE ELSE 0.3::DOUBLE * {c01('0.5::DOUBLE + deliv_pct_change / 20')} END END AS ds,
  CASE WHEN hist_events >= 2 THEN 0.5::DOUBLE * {c01('0.5::DOUBLE + (hist_events / (hist_events + 4)) * hist_mean / 0.06::DOUBLE')} + 0.5::DOUBLE * (hit * hist_events + 2) / (hist_events + 4) END AS k5,
  fund_score / 100 AS k6, {c01('0.5::DOUBLE + 0.5::DOUBLE * catalyst_score')} AS k7,
  CASE WHEN adv20_cr IS NOT NULL THEN {c01('(log10(greatest(adv20_cr, 0.1::DOUBLE)) - 0.3::DOUBLE) / 1.7::DOUBLE')} * CASE WHEN vol_ann > 0.6::DOUBLE THEN greatest(0.4::DOUBLE, 1 - (vol_ann - 0.6::DOUBLE)) ELSE 1 END END AS k8,
  greatest(0, coalesce({c01('(z_20d - 1.5::DOUBLE) / 1.5::DOUBLE')}, 0), coalesce({c01('(rsi14 - 70) / 15')}, 0)) AS ext,
  CASE WHEN adv20_cr < 2 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN td < 2 THEN 0.5::DOUBLE WHEN td < 4 THEN 0.85::DOUBLE ELSE 1 END AS gate FROM p2),
p4 AS (SELECT *, CASE WHEN vs IS NULL THEN ds WHEN ds IS NULL THEN vs ELSE (0.6::DOUBLE * vs + 0.4::DOUBLE * ds) / 1.0 END AS k4 FROM p3),
p5 AS (SELECT *, (coalesce(0.10::DOUBLE * k1, 0) + coalesce(0.22::DOUBLE * k2, 0) + coalesce(0.12::DOUBLE * k3, 0) + coalesce(0.16::DOUBLE * k4, 0) + coalesce(0.12::DOUBLE * k5, 0) + coalesce(0.14::DOUBLE * k6, 0) + coalesce(0.08::DOUBLE * k7, 0) + coalesce(0.06::DOUBLE * k8, 0))
  / (CASE WHEN k1 IS NULL THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN k2 IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN k3 IS NULL THEN 0 ELSE 0.12::DOUBLE END + CASE WHEN k4 IS NULL THEN 0 ELSE 0.16::DOUBLE END + CASE WHEN k5 IS NULL THEN 0 ELSE 0.12::DOUBLE END
   + CASE WHEN k6 IS NULL THEN 0 ELSE 0.14::DOUBLE END + CASE WHEN k7 IS NULL THEN 0 ELSE 0.08::DOUBLE END + CASE WHEN k8 IS NULL THEN 0 ELSE 0.06::DOUBLE END) AS base_score FROM p4),
pre AS (SELECT *, CASE WHEN k2 IS NOT NULL THEN round(100 * base_score * (1 - 0.45::DOUBLE * ext) * gate, 1) END AS score, CASE WHEN k2 IS NOT NULL THEN round(ext, 2) END AS extension,
  CASE WHEN k2 IS NULL THEN 'No data' WHEN td < 2 THEN 'Too close' WHEN ext >= 0.5 THEN 'Extended' WHEN rs_z < 0 THEN 'Weak' WHEN rs_z > 1 THEN 'Building' WHEN coalesce(accel_z > 0, false) OR coalesce(rvol_5d >= 1.2::DOUBLE, false) OR coalesce(deliv_qty_ratio >= 1.2::DOUBLE, false) THEN 'Early' ELSE 'Neutral' END AS stage FROM p5)"""


# ---- scores -------------------------------------------------------------------------------------------------

@query("sco02_03_pre_result_score", f"""WITH {ALL_FEATURES}, {RSI_EXP}, {TREND}, rows AS (SELECT f3.*, rsi14, deliv_qty_ratio, deliv_pct_change, CAST(split_part(symbol, '#', 2) AS INT) % 28 AS td,
  CAST(NULL AS BIGINT) AS hist_events, CAST(NULL AS DOUBLE) AS hist_mean, CAST(NULL AS DOUBLE) AS hit, CAST(NULL AS DOUBLE) AS fund_score, CAST(NULL AS DOUBLE) AS catalyst_score
  FROM f3 JOIN rsi_exp USING (symbol) LEFT JOIN trend USING (symbol) WHERE is_last AND bar_no >= 60), {pre_score_sql('rows')}
SELECT symbol, {rs('rs_z', 'accel_z', digits=5)}, score, extension, stage FROM pre""")
def pre_result_score(spark, sf_dir):
    return price_rows(spark, sf_dir).select("symbol", *rounded("rs_z", "accel_z", digits=5), "score", "extension", "stage")


def price_rows(spark, sf_dir) -> DataFrame:
    """Features and delivery trend of all brands; the sessions left depend on the brand's number."""
    trend = features.delivery_trend(features.recent_sessions(delivery_days(spark, sf_dir)))
    rows = scanner_rows(spark, sf_dir).join(trend, "symbol", "left").withColumn("trading_days_left", brand_number(F.col("symbol")) % 28)
    return scoring.pre_result_score(rows)


def signed_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '–' ELSE printf('%+.1f%%', {x} * 100) END"


WHEN_TEXT = "printf('Results on {} (%d trading day%s away)', td, CASE WHEN td <> 1 THEN 's' ELSE '' END)".replace("{}", TODAY)
PACE = f"printf('last 5 sessions %s vs %s the 5 before', {signed_sql('ret_5d')}, {signed_sql('ret_prev5d')})"
VOLUME = "printf('Volume %.1f× its 50-day average', rvol_5d) || CASE WHEN updown_vol_ratio > 1.2::DOUBLE THEN printf(', heavier on up days (%.1f×)', updown_vol_ratio) ELSE '' END"
SHARE = "CASE WHEN deliv_pct_5d IS NOT NULL AND deliv_pct_base IS NOT NULL THEN printf('; %.0f%% of volume delivered vs %.0f%% before', deliv_pct_5d, deliv_pct_base) ELSE '' END"
MARKET_NAME = fv.MARKET_INDEX
SENTENCES = f"""said AS (SELECT *, CASE WHEN rel_sec_5d IS NOT NULL THEN 'Sector' ELSE '{MARKET_NAME}' END AS bench, {signed_sql('r5')} AS text5, {signed_sql('r10')} AS text10, r5 IS NOT NULL AND r10 IS NOT NULL AS both_ FROM pre),
lines AS (SELECT symbol, stage,
  concat_ws(' | ', CASE WHEN td BETWEEN 5 AND 15 THEN {WHEN_TEXT} || ' — inside the 5–15 session pre-results window' WHEN td > 15 THEN {WHEN_TEXT} END,
    CASE WHEN both_ AND r5 > 0 AND r10 > 0 THEN printf('Outperforming %s: %s over 5 sessions, %s over 10', bench, text5, text10)
      WHEN both_ AND r5 > 0 THEN printf('Turning up vs %s: %s over 5 sessions after lagging over 10 (%s)', bench, text5, text10) END,
    CASE WHEN accel > 0.01::DOUBLE THEN 'Momentum accelerating: ' || {PACE} END,
    CASE WHEN rvol_5d >= 1.2::DOUBLE AND rvol_5d <= 4 THEN {VOLUME} END,
    CASE WHEN deliv_qty_ratio >= 1.2::DOUBLE THEN printf('Delivered shares %.1f× the prior 20 sessions', deliv_qty_ratio) || {SHARE} END) AS reasons,
  concat_ws(' | ', CASE WHEN td < 5 THEN {WHEN_TEXT} || ' — little time left for a pre-results move' END,
    CASE WHEN both_ AND r5 <= 0 AND r10 <= 0 THEN printf('Lagging %s: %s over 5 sessions, %s over 10', bench, text5, text10) END,
    CASE WHEN rel_sec_5d IS NULL AND rel_mkt_5d IS NOT NULL THEN 'No sector index mapped — relative strength is vs {MARKET_NAME} only' END,
    CASE WHEN accel < -0.03::DOUBLE THEN 'Momentum fading: ' || {PACE} END,
    CASE WHEN rvol_5d > 4 THEN {VOLUME} || ' — climactic, could be exhaustion' END,
    CASE WHEN deliv_qty_ratio < 0.85::DOUBLE AND deliv_pct_5d < deliv_pct_base - 3 THEN printf('Delivery drying up: delivered shares %.1f× usual', deliv_qty_ratio) || {SHARE} END,
    'No fundamentals on file — add a fundamentals CSV',
    CASE WHEN z_20d > 1.5::DOUBLE THEN printf('Already up %s in 20 sessions (%.1fσ) — may be priced in', {signed_sql('ret_20d')}, z_20d) END,
    CASE WHEN rsi14 >= 72 THEN printf('RSI %.0f: overbought', rsi14) END,
    CASE WHEN adv20_cr < 5 THEN printf('Thin liquidity: ₹%.1f cr/day traded', adv20_cr) END,
    CASE WHEN vol_ann > 0.6::DOUBLE THEN printf('High volatility: %.0f%% annualised', vol_ann * 100) END) AS risks FROM said)"""


@query("sco04_reasons_and_risks", f"""WITH {ALL_FEATURES}, {RSI_EXP}, {TREND}, rows AS (SELECT f3.*, rsi14, deliv_qty_ratio, deliv_pct_change, deliv_pct_5d, deliv_pct_base, CAST(split_part(symbol, '#', 2) AS INT) % 28 AS td,
  CAST(NULL AS BIGINT) AS hist_events, CAST(NULL AS DOUBLE) AS hist_mean, CAST(NULL AS DOUBLE) AS hit, CAST(NULL AS DOUBLE) AS fund_score, CAST(NULL AS DOUBLE) AS catalyst_score
  FROM f3 JOIN rsi_exp USING (symbol) LEFT JOIN trend USING (symbol) WHERE is_last AND bar_no >= 60), {pre_score_sql('rows')}, {SENTENCES}
SELECT symbol, stage, CASE WHEN stage <> 'No data' THEN reasons ELSE '' END AS reasons, CASE WHEN stage <> 'No data' THEN risks ELSE 'not enough price history to score' END AS risks FROM lines""")
def reasons_and_risks(spark, sf_dir):
    """The sentences behind each score; those on past results, fundamentals and filings are checked in the tests."""
    rows = price_rows(spark, sf_dir).withColumns({"result_date": F.lit(TODAY), "sector_index": F.lit("Sector"), "fund_source": F.lit("none")})
    return scoring.explain_pre_result(rows).select(
        "symbol", "stage", F.concat_ws(" | ", "reasons").alias("reasons"), F.concat_ws(" | ", "risks").alias("risks"))


@query("srt03_relative_strength", f"""WITH {ALL_FEATURES}, x AS (SELECT symbol, CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 5 <> 0 THEN coalesce(CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 3 <> 0 THEN rel_sec_5d END, rel_mkt_5d) END AS v
  FROM f3 WHERE is_last AND bar_no >= 60)
SELECT symbol, {r('v', 5)}, row_number() OVER (ORDER BY v ASC NULLS LAST, symbol) AS up, row_number() OVER (ORDER BY v DESC NULLS LAST, symbol) AS down FROM x""")
def relative_strength(spark, sf_dir):
    """Strength against the sector, where that is unknown against the market; rows without either stand last in both directions."""
    n = brand_number(F.col("symbol"))
    rows = scanner_rows(spark, sf_dir).withColumns({"rel_sec_5d": F.when((n % 3 != 0) & (n % 5 != 0), F.col("rel_sec_5d")), "rel_mkt_5d": F.when(n % 5 != 0, F.col("rel_mkt_5d"))})
    rows = rows.select("symbol", screen.relative_sort_value(5).alias("v"))
    for name, descending in (("up", False), ("down", True)):
        rows = screen.row_positions(rows, [screen.nulls_always_last(F.col("v"), descending), F.asc("symbol")], name)
    return rows.select("symbol", *rounded("v", digits=5), F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))


# ---- result screen --------------------------------------------------------------------------------------------

def result_rows(spark, sf_dir) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    members = universe(bars)
    by_isin = bars.join(members.select("symbol", "isin"), "symbol").drop("symbol").withColumnRenamed("isin", "symbol")
    live = members.filter(brand_number(F.col("symbol")) % 2 == 0).select("isin", F.lit(100.0).alias("live"))
    provider = members.select("symbol", F.lit(50.0).alias("Current Price"), F.lit(20.0).alias("Price to Earning"), F.lit(0.4).alias("Debt to equity"))
    return rscreen.result_screen(
        feeds.parse_board_meetings(meeting_rows(spark, sf_dir)), listings(members), brand_master(trade_ticks(spark, sf_dir)), provider,
        by_isin, live, TODAY, clock.holiday_literal(*HOLIDAYS))


RESULT = f"""WITH {bars_since(600, TODAY)}, {UNIVERSE}, {BRAND_MASTER}, {LISTINGS}, {MEETINGS}, {RESULT_FEATURES},
m1 AS (SELECT m.bse_code, m.result_date, coalesce(l.nse_symbol, f.symbol) AS nse_symbol, coalesce(l.isin, f.isin) AS isin, f.code IS NOT NULL AS has_master, f.pg, f.sg, f.roce, f.opm, f.cfo, f.de, f.pe, f.peg, f.fii
  FROM meetings m LEFT JOIN listings l USING (bse_code) LEFT JOIN master f ON f.isin = l.isin OR (f.code = m.bse_code AND NOT EXISTS (SELECT 1 FROM master g WHERE g.isin = l.isin)) WHERE m.result_date >= DATE '{TODAY}'),
m2 AS (SELECT m1.* EXCLUDE (pe, de), CASE WHEN has_master THEN 'master' WHEN nse_symbol IS NOT NULL THEN 'provider' ELSE 'none' END AS src, CASE WHEN has_master THEN pe WHEN nse_symbol IS NOT NULL THEN 20.0 END AS pe,
  CASE WHEN has_master THEN de WHEN nse_symbol IS NOT NULL THEN 0.4::DOUBLE END AS de, {days_sql(f"DATE '{TODAY}'", 'result_date')} AS td FROM m1),
m3 AS (SELECT m2.*, x.last_close, x.ret_60d, x.pct_of_52w_high, x.adv20_cr, x.above_50dma, x.n AS hd FROM m2 LEFT JOIN universe u ON u.isin = m2.isin LEFT JOIN rf x ON x.symbol = u.symbol AND x.is_last AND x.n > 20),
{score_sql('bse_code, result_date, src, td, isin, nse_symbol, last_close, ret_60d, pct_of_52w_high, adv20_cr, above_50dma, hd, pg', 'm3', 'adv20_cr')},
m4 AS (SELECT *, CASE WHEN ret_60d IS NOT NULL THEN 100 * (CASE WHEN above_50dma IS NULL THEN 0 WHEN above_50dma THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE * greatest(0, least(1, (ret_60d + 0.1::DOUBLE) / 0.4::DOUBLE)) + 0.3::DOUBLE * (1 - greatest(0, least(1, (ret_60d - 0.4::DOUBLE) / 0.4::DOUBLE))))
  / CASE WHEN above_50dma IS NULL THEN 0.6::DOUBLE ELSE 1 END END AS tech FROM scored),
m5 AS (SELECT *, CASE WHEN tech IS NOT NULL THEN 0.7::DOUBLE * fund_score + 0.3::DOUBLE * tech ELSE 0.85::DOUBLE * fund_score END - CASE WHEN td < 5 THEN 15 ELSE 0 END - CASE WHEN adv20_cr < 10 THEN 10 ELSE 0 END AS composite FROM m4)"""


@query("pip02_result_screen", f"""{RESULT} SELECT bse_code, CAST(result_date AS VARCHAR) AS result_date, src AS fundamentals_source, td AS trading_days_left, {r('fund_score', 4)}, {r('tech', 4, 'tech_score')}, {r('composite', 4)},
  CAST(CASE WHEN composite IS NOT NULL THEN row_number() OVER (ORDER BY composite DESC NULLS LAST, printf('%020d', bse_code) || ':' || CAST(result_date AS VARCHAR)) END AS DOUBLE) AS rank FROM m5""")
def result_screen(spark, sf_dir):
    return result_rows(spark, sf_dir).select(
        "bse_code", day("result_date"), "fundamentals_source", F.col("trading_days_left").cast("long").alias("trading_days_left"),
        *rounded("fund_score", "tech_score", "composite", digits=4), F.col("rank").cast("double").alias("rank"))


@query("sco06_07_flags", f"""{RESULT} SELECT bse_code, CAST(result_date AS VARCHAR) AS result_date, {r('composite', 4)}, concat_ws('; ', CASE WHEN src = 'none' THEN 'no fundamentals' END, CASE WHEN src = 'provider' THEN 'partial fundamentals (no ROCE/FII/CFO)' END,
  CASE WHEN pg > 500 THEN 'profit growth >500%: low base / one-off likely' END, CASE WHEN td < 5 THEN '<5 trading days to result' END, CASE WHEN adv20_cr < 10 THEN 'illiquid (<₹10cr/day)' END,
  CASE WHEN pct_of_52w_high > 0.97::DOUBLE AND coalesce(ret_60d, 0) > 0.4::DOUBLE THEN 'extended: near 52w high after >40% run' END, CASE WHEN hd > 0 AND hd < 120 THEN 'short price history' END) AS flags FROM m5""")
def result_flags(spark, sf_dir):
    return result_rows(spark, sf_dir).select("bse_code", day("result_date"), *rounded("composite", digits=4), "flags")


@query("flt07_result_filter", f"{RESULT} SELECT bse_code, CAST(result_date AS VARCHAR) AS result_date FROM m5 WHERE date_diff('day', DATE '{TODAY}', result_date) <= 20 AND composite IS NOT NULL AND coalesce(fund_score, 0) >= 30 AND contains(lower(coalesce(nse_symbol, '')), 'brand#1')")
def result_filter(spark, sf_dir):
    kept = screen.result_screen_filter(search=" Brand#1", max_days=20, scored_only=True, min_fund=30.0)
    return result_rows(spark, sf_dir).filter(kept).select("bse_code", day("result_date"))


@query("agg05_result_summary", f"""{RESULT} SELECT count(*) AS meetings_upcoming, count(*) FILTER (src <> 'none') AS with_fundamentals, count(*) FILTER (src = 'master') AS from_master, count(*) FILTER (src = 'provider') AS from_provider,
  count(last_close) AS with_prices, count(composite) AS scored, (SELECT count(*) FROM universe WHERE CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0) > 0 AS live_prices,
  (SELECT count(*) FROM orders) AS rows_read, (SELECT count(*) FROM orders WHERE o_orderkey % 8 = 6 OR o_orderkey % 50 = 0) AS rows_unparseable,
  (SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderkey % 8 = 6 OR o_orderkey % 50 = 0) - (SELECT count(*) FROM meetings) AS duplicates_removed,
  (SELECT count(*) FROM meetings WHERE result_date < DATE '{TODAY}') AS past_dates_dropped FROM m5""")
def result_summary(spark, sf_dir):
    """Counts of the screen's rows, of the landed meeting file, and whether any live price was known."""
    raw = meeting_rows(spark, sf_dir)
    live = universe(stored_bars(spark, sf_dir)).filter(brand_number(F.col("symbol")) % 2 == 0)
    return rscreen.summary(result_rows(spark, sf_dir), feeds.board_meeting_counts(raw), feeds.parse_board_meetings(raw), live, TODAY)


# ---- pre-result scan ---------------------------------------------------------------------------------------------

def scan_rows(spark, sf_dir) -> DataFrame:
    path = monthly_bars(spark, sf_dir)
    end = F.lit(TODAY).cast("date")
    bars = sinks.between(sinks.read_bars(spark, path), F.date_sub(end, pre_result_scan.HISTORY_DAYS), end)
    members = universe(bars)
    calendar = merged_calendar(spark, sf_dir).drop("symbol").join(members.select("isin", "symbol"), "isin")
    return pre_result_scan.scan(
        calendar, bars, market_index(bars), index_bars(bars), delivery_days(spark, sf_dir), brand_master(trade_ticks(spark, sf_dir)),
        quarter_starts(bars), filings(spark, sf_dir), TODAY, clock.holiday_literal(*HOLIDAYS))


NAMED_INDEX = f"""named AS (SELECT u.symbol, coalesce(
    CASE c.industry WHEN 'Healthcare' THEN 'Nifty Pharma' WHEN 'Realty' THEN 'Nifty Realty' END,
    CASE m.industry WHEN 'Pharmaceuticals' THEN 'Nifty Pharma' WHEN 'Software Products' THEN 'Nifty IT' WHEN 'Steel' THEN 'Nifty Metal' WHEN 'Cement' THEN 'Nifty Infra' END) AS sector
  FROM calendar c JOIN (SELECT symbol, isin FROM universe) u USING (isin) LEFT JOIN (SELECT isin, industry FROM master) m USING (isin)),
sectors AS (SELECT {INDEXES}[CAST(split_part(symbol, '#', 2) AS INT) % 5 + 1] AS sector, date, avg(c) AS c FROM bars GROUP BY 1, 2)"""
SCAN = f"""WITH RECURSIVE {bars_since(1100, TODAY)}, {UNIVERSE}, {CALENDAR}, {BRAND_MASTER}, {NAMED_INDEX}, {MARKET}, {FEATURES.replace("JOIN universe u", "JOIN named u")},
{RSI_EXP}, {TREND}, {score_sql('symbol', 'facts')}, {HISTORY}, {EVENTS},
dated AS (SELECT c.isin, u.symbol, named.sector, c.result_date, {days_sql(f"DATE '{TODAY}'", 'c.result_date')} AS td FROM calendar c JOIN universe u USING (isin) JOIN named ON named.symbol = u.symbol),
rows AS (SELECT d.isin, d.td, d.result_date, d.sector, f3.* EXCLUDE (h, l, sector), rsi14, deliv_qty_ratio, deliv_pct_change, deliv_pct_5d, hist_events, hist_mean, hit, CASE WHEN m.isin IS NOT NULL THEN s.fund_score END AS fund_score, m.isin IS NOT NULL AS has_master, coalesce(round(net, 3), 0) AS catalyst_score
  FROM dated d LEFT JOIN f3 ON f3.symbol = d.symbol AND is_last AND bar_no >= 60 LEFT JOIN rsi_exp ON rsi_exp.symbol = d.symbol LEFT JOIN trend ON trend.symbol = d.symbol AND (SELECT count(DISTINCT date) FROM recent) >= 10 LEFT JOIN hist ON hist.symbol = d.symbol
  LEFT JOIN master m ON m.isin = d.isin LEFT JOIN scored s ON s.symbol = m.symbol LEFT JOIN net ON net.company_id = d.symbol WHERE d.td >= 1), {pre_score_sql('rows')}"""


@query("pip01_pre_result_scan", f"""{SCAN} SELECT isin, symbol, CAST(result_date AS VARCHAR) AS result_date, td AS trading_days_left, {rs('rs_z', 'accel_z', 'fund_score', digits=4)}, catalyst_score + CAST(0 AS DOUBLE) AS catalyst_score, hist_events, score, stage,
  row_number() OVER (ORDER BY score DESC NULLS LAST, isin) AS rank FROM pre""")
def pre_scan(spark, sf_dir):
    return scan_rows(spark, sf_dir).select(
        "isin", "symbol", day("result_date"), F.col("trading_days_left").cast("long").alias("trading_days_left"),
        *rounded("rs_z", "accel_z", "fund_score", digits=4), *rounded("catalyst_score", digits=3), "hist_events", "score", "stage",
        F.col("rank").cast("long").alias("rank"))


@query("pip01_listing_fallback", f"""WITH {TICKS}, entries AS (SELECT p_partkey AS id, 'PRT' || p_partkey AS isin, CASE WHEN p_partkey % 4 = 0 THEN 'S' || p_partkey END AS symbol, 700000 + p_partkey AS code FROM part WHERE p_partkey % 3 <> 0),
named AS (SELECT isin, id, coalesce(symbol, CASE WHEN id % 5 <> 0 THEN 'N' || id END, 'code:' || code) AS symbol FROM entries),
seg AS (SELECT part_id AS id, flag AS segment, date, last(price ORDER BY k1, k2, k3, k4) AS c FROM ticks WHERE flag IN ('R', 'A') GROUP BY 1, 2, 3),
best AS (SELECT * FROM seg QUALIFY segment = first_value(segment) OVER (PARTITION BY id ORDER BY CASE segment WHEN 'R' THEN 1 ELSE 2 END))
SELECT isin, symbol, max(segment) AS price_segment, count(c) AS bars, arg_max(c, date) AS last_close FROM named LEFT JOIN best USING (id) GROUP BY isin, symbol""")
def listing_fallback(spark, sf_dir):
    """A company per part: symbols from the entry, else by ISIN, else the exchange code; prices from return flag R, else A."""
    k = F.col("p_partkey")
    isin = lambda c: F.concat(F.lit("PRT"), c)
    parts = table(spark, sf_dir, "part")
    entries = parts.filter(k % 3 != 0).select(isin(k).alias("isin"), F.when(k % 4 == 0, F.concat(F.lit("S"), k)).alias("symbol"), (700000 + k).alias("bse_code"))
    instruments = parts.filter(k % 5 != 0).select(isin(k).alias("isin"), F.lit("R").alias("segment"), F.concat(F.lit("N"), k).alias("symbol")).unionByName(
        parts.select(isin(k).alias("isin"), F.lit("A").alias("segment"), F.concat(F.lit("B"), k).alias("symbol")))
    ticks = trade_ticks(spark, sf_dir).withColumns({"isin": isin(F.col("part_id")), "segment": F.col("flag")})
    calendar, bars = pre_result_scan.with_listings(entries, instruments, roll_up_ticks(ticks, ["isin", "segment", "date"]), ["R", "A"])
    last = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.max_by("c", "date").alias("last_close"))
    return calendar.join(last, "symbol", "left").select(
        "isin", "symbol", "price_segment", F.coalesce("bars", F.lit(0)).alias("bars"), "last_close")


@query("agg05_scan_summary", f"""{SCAN}, mk AS (SELECT c / lag(c, 5) OVER w - 1 AS a, c / lag(c, 20) OVER w - 1 AS z, c > avg(c) OVER (ORDER BY date ROWS 49 PRECEDING) AS above, date FROM market
  WINDOW w AS (ORDER BY date) QUALIFY row_number() OVER (ORDER BY date DESC) = 1) SELECT (SELECT count(*) FROM pre) AS upcoming, count(score) AS scored, count(score) AS enriched, count(*) FILTER (has_master) AS with_fundamentals, count(deliv_pct_5d) AS with_delivery, count(*) FILTER (sector IS NOT NULL) AS with_sector_index,
  (SELECT CASE WHEN bool_or(has_feed) AND bool_or(has_up) THEN 'nse,upload' WHEN bool_or(has_feed) THEN 'nse' ELSE 'upload' END FROM calendar c WHERE c.isin IN (SELECT isin FROM pre)) AS calendar_sources, (SELECT {r('a', 5, 'market_5d')} FROM mk) AS market_5d, (SELECT {r('z', 5, 'market_20d')} FROM mk) AS market_20d, (SELECT above FROM mk) AS market_above_50dma,
  (SELECT string_agg(stage || '=' || n, ',' ORDER BY stage) FROM (SELECT stage, count(*) AS n FROM pre GROUP BY stage)) AS stages FROM pre""")
def scan_summary(spark, sf_dir):
    market = pre_result_scan.market_state(market_index(bars_daily(spark, sf_dir)), TODAY)
    s = pre_result_scan.summary(scan_rows(spark, sf_dir), market)
    stages = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return s.select("upcoming", "scored", "enriched", "with_fundamentals", "with_delivery", "with_sector_index",
                    F.concat_ws(",", "calendar_sources").alias("calendar_sources"), (F.round("market.ret_5d", 5) + 0.0).alias("market_5d"),
                    (F.round("market.ret_20d", 5) + 0.0).alias("market_20d"), F.col("market.above_50dma").alias("market_above_50dma"),
                    stages.alias("stages"))


@query("flt08_flt10_scan_filter", f"""{SCAN} SELECT isin, score FROM pre WHERE stage IN ('Early', 'Building', 'Weak', 'Extended') AND (adv20_cr IS NULL OR adv20_cr >= 0.01::DOUBLE) AND score IS NOT NULL AND result_date <= DATE '{TODAY}' + 25 AND td >= 2""")
def scan_filter(spark, sf_dir):
    kept = screen.pre_result_filter(stages=["Early", "Building", "Weak", "Extended"], min_adv=0.01, enriched_only=True)
    return screen.upcoming_window(scan_rows(spark, sf_dir).filter(kept), TODAY, 25, 2).select("isin", "score")


# ---- events, news, runs ----------------------------------------------------------------------------------------------

COMPANY = SUMMARY.replace(BARS, bars_since(400, NOW[:10])).replace(
    "AS src FROM orders)", f"AS src FROM orders WHERE o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY AND o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE <= TIMESTAMP '{NOW}')").replace(
    "FROM scored_events GROUP BY 1)", "FROM scored_events WHERE event_type <> 'routine' GROUP BY 1)")


@query("pip03_company_events", f"WITH RECURSIVE {COMPANY} SELECT company_id, round(net, 3) + CAST(0 AS DOUBLE) AS net_score, counts, (SELECT count(*) FROM scored_events s WHERE s.company_id = net.company_id AND event_type <> 'routine') AS items FROM net LEFT JOIN cnt USING (company_id)")
def company_events(spark, sf_dir):
    """A year of filings and news for all companies at once."""
    f = filings(spark, sf_dir)
    items, summary = ce.company_events(f.filter("source_type = 'exchange'"), f.filter("source_type <> 'exchange'"), bars_daily(spark, sf_dir),
                                       F.lit(NOW).cast("timestamp"), days=400)
    counts = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("event_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    n = items.groupBy("company_id").agg(F.count("*").alias("items"))
    return summary.join(n, "company_id").select("company_id", *rounded("net_score", digits=3), counts.alias("counts"), "items")


FEED_ART = """, art AS (SELECT item_id, source, h AS hours_ago, trim(CASE WHEN title LIKE '% - ' || source THEN left(title, len(title) - len(source) - 3) ELSE regexp_replace(title, '\\s*[-|–—]\\s*[^-|–—]+$', '') END) AS key FROM (
  SELECT item_id, source, title, greatest(h, 0) AS h FROM (SELECT *, (epoch(TIMESTAMP '2001-07-30') - epoch(ts)) / 3600 AS h FROM items) QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY item_id) = 1) WHERE h <= 720)"""
NEWS = ITEMS + FEED_ART + STORY[STORY.index(", tf AS MATERIALIZED"):]


@query("pip04_news_feed", f"WITH RECURSIVE {NEWS} SELECT story, count(*) AS copies, count(DISTINCT source) AS sources FROM story JOIN art USING (item_id) GROUP BY story")
def news_feed(spark, sf_dir):
    now = F.lit("2001-07-30 00:00:00").cast("timestamp")
    heads = filings(spark, sf_dir).select("item_id", "title", "source", feeds.hours_between(F.col("ts"), now).alias("hours_ago"))
    feed = ce.news_feed(heads, brand_aliases(spark, sf_dir), stop=stop_list())
    return feed.select("story", "copies", (F.size("related_sources") + 1).cast("long").alias("sources"))


@query("snk01_snk02_saved_runs", f"""WITH {BARS}, runs AS (SELECT CAST(year(date) AS VARCHAR) || '0101_000000' AS run_id, count(*) AS rows, CAST(year(date) AS VARCHAR) || '-01-01' AS generated_at,
  round(sum(round(c, 4)), 1) AS closes FROM bars GROUP BY year(date)), numbered AS (SELECT *, row_number() OVER (ORDER BY run_id DESC) AS k FROM runs)
SELECT 'kept 20' AS part, run_id, rows, generated_at, CAST(NULL AS DOUBLE) AS closes FROM numbered WHERE k <= 20
UNION ALL SELECT 'latest', run_id, rows, generated_at, closes FROM numbered WHERE k = 1
UNION ALL SELECT 'by id', run_id, rows, generated_at, closes FROM numbered WHERE run_id = '19960101_000000'
UNION ALL SELECT 'kept 3', run_id, rows, generated_at, NULL FROM numbered WHERE k <= 3""")
def saved_runs(spark, sf_dir):
    """A run per calendar year of bars, one of them saved twice: listed with 20 kept, the latest and one by id read, and listed with 3 kept."""
    bars = stored_bars(spark, sf_dir).withColumns({"y": F.year("date"), "extra": F.array("o", "c")})
    root = fresh_dir(spark, "runs")
    years = table(spark, sf_dir, "lineitem").agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    sinks.save_run(bars.limit(7).drop("y"), root, "19960101_000000", "1996-01-01")
    for y in range(years[0], years[1] + 1):
        sinks.save_run(bars.filter(F.col("y") == y).drop("y"), root, f"{y}0101_000000", f"{y}-01-01")
    listed = lambda part, keep: sinks.list_runs(spark, root, keep).select(
        F.lit(part).alias("part"), "run_id", "rows", "generated_at", F.lit(None).cast("double").alias("closes"))
    read = lambda part, run: sinks.read_run(spark, root, run).groupBy(F.lit(part).alias("part"), "run_id").agg(
        F.count("*").alias("rows"), F.max("generated_at").alias("generated_at"), F.round(F.sum("c"), 1).alias("closes"))
    sinks.drop_old_runs(spark, root)
    before = stage(listed("kept 20", None).unionByName(read("latest", "latest")).unionByName(read("by id", "19960101_000000")), "before")
    sinks.drop_old_runs(spark, root, keep=3)
    return before.unionByName(listed("kept 3", None))


@query("jon14_quotes_joined", f"""WITH {BARS}, {UNIVERSE}, l AS (SELECT symbol, arg_max(c, date) AS ltp FROM bars GROUP BY symbol), alerts AS (SELECT c_custkey AS id, 'Brand#' || (1 + c_custkey % 30) AS symbol, abs(c_acctbal) AS level FROM customer)
SELECT id, a.symbol, u.sector, ltp >= level AS above, CASE WHEN CAST(split_part(a.symbol, '#', 2) AS INT) % 2 = 0 THEN 70.0 END AS fund FROM alerts a JOIN l USING (symbol) JOIN universe u USING (symbol)""")
def quotes_joined(spark, sf_dir):
    """Quotes with listings (unknown tickers dropped) and fundamentals, and each customer's price alert on them."""
    bars = bars_daily(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max_by("c", "date").alias("ltp"))
    unknown = last.limit(0).union(spark.createDataFrame([("Brand#99", 1.0)], "symbol string, ltp double"))
    fund = last.filter(brand_number(F.col("symbol")) % 2 == 0).select("symbol", F.lit(70.0).alias("fund"))
    full = joins.quotes_with_universe(last.unionByName(unknown), universe(bars), fund)
    k = F.col("c_custkey")
    alerts = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("Brand#"), 1 + k % 30).alias("symbol"), F.abs("c_acctbal").alias("level"))
    return alerts.join(full, "symbol").select("id", "symbol", "sector", (F.col("ltp") >= F.col("level")).alias("above"), "fund")
