"""Pre-result scan: which companies show early relative strength ahead of their scheduled results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import bar_windows as b
from barloom.functions.clock import trading_days
from barloom.operators import events, features, history, joins, scoring, screen
from barloom.session import stage
from barloom.sources.bars import pick_segment
from barloom.sources.sinks import between


HISTORY_DAYS = 1100
PAST_RESULT_DAYS = 3 * 365
MIN_DELIVERY_SESSIONS = 10


def with_listings(calendar: DataFrame, instruments: DataFrame, bars: DataFrame, segments: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(calendar, bars) for ``scan`` from entries and prices that are known by ISIN.

    ``instruments`` is (isin, segment, symbol), ``bars`` has isin and segment. An entry without a symbol takes the one of its ISIN in the
    first of ``segments``; one that has none there either is known as "code:" and its exchange code, and filings of such a company carry
    that as company_id. Prices come from the first segment that has any, named in ``price_segment``.
    """
    first = instruments.filter(F.col("segment") == segments[0]).groupBy("isin").agg(F.min("symbol").alias("_listed"))
    code = F.concat(F.lit("code:"), F.col("bse_code").cast("string"))
    named = calendar.join(first, "isin", "left").withColumn("symbol", F.coalesce("symbol", "_listed", code)).drop("_listed")
    priced = pick_segment(bars, segments)
    chosen = priced.select("isin", F.col("segment").alias("price_segment")).distinct()
    keys = named.select("isin", "symbol").dropDuplicates(["isin"])
    fields = [c for c in bars.columns if c not in ("isin", "segment", "symbol")]
    return named.join(chosen, "isin", "left"), priced.select("isin", *fields).join(keys, "isin").drop("isin")


def scan(calendar: DataFrame, bars: DataFrame, market: DataFrame, index_bars: DataFrame, delivery: DataFrame,
         master: DataFrame, past_dates: DataFrame, filings: DataFrame, today: str, holidays: Column,
         top_k: int = 60, min_sessions: int = 1, filing_days: int = 30, history_days: int = HISTORY_DAYS,
         past_days: int = PAST_RESULT_DAYS) -> DataFrame:
    """Ranked company rows with score, stage, reasons and risks.

    ``calendar``: one row per ISIN with result_date, symbol, company, industry (from ``joins.merge_calendars`` and the
    listing table). ``index_bars``: (index_name, date, c); a company is compared with the index its labels map to, and
    with the market alone when they map to none or to one without bars. ``past_dates``: (symbol, date), used up to
    ``past_days`` back. ``filings``: event items whose company_id is the symbol. Prices are read up to ``history_days``
    back, a date range that reaches the scan. Delivery trends need ten sessions in all. Everyone gets price features
    and a first score; only the best ``top_k`` are joined with their result history and filings, and scored again.
    """
    k = min(max(int(top_k), 5), 200)
    now = F.to_date(F.lit(today))
    dated = calendar.withColumnRenamed("industry", "calendar_industry").withColumns({
        "trading_days_left": trading_days(now, F.col("result_date"), holidays),
        "days_left": F.datediff("result_date", now)}).filter(F.col("trading_days_left") >= min_sessions)
    in_range = lambda df, days: between(df, F.date_sub(now, days), now)
    bars, market, index_bars = (in_range(df, history_days) for df in (bars, market, index_bars))
    past_dates = in_range(past_dates, past_days).filter(F.col("date") < now)
    known = joins.with_fundamentals(dated, master)
    industry = [F.col(f"`{c}`") if c in known.columns else F.lit(None).cast("string") for c in ("calendar_industry", "Industry Group", "Industry")]
    named = known.withColumn("sector_index", joins.sector_index_for(*industry))

    compared = named.groupBy("symbol").agg(F.min("sector_index").alias("sector"))
    priced = features.scanner_features(
        bars.join(compared, "symbol"), market, index_bars.withColumnRenamed("index_name", "sector"))
    trend = features.delivery_trend(features.recent_sessions(delivery, at_least=MIN_DELIVERY_SESSIONS))
    rows = named.join(priced, "symbol", "left").join(trend, "symbol", "left")
    rows = scoring.add_fundamental_score(rows, include_liquidity=False)
    rows = rows.withColumn("fund_score", F.when(F.col("fund_source") != "none", F.col("fund_score")))
    first = stage(rows)
    scored = scoring.pre_result_score(first)

    best = screen.best_first(scored.select("isin", "symbol", "score"), k, F.desc_nulls_last("score"), F.asc("isin")).filter("score is not null")
    best = stage(best.select("isin", "symbol"))
    chosen = best.select("symbol").distinct()
    past = history.results_history(
        bars.join(chosen, "symbol", "left_semi"), past_dates.join(chosen, "symbol", "left_semi"), market)
    end = F.lit(today).cast("timestamp")
    recent = filings.join(chosen.withColumnRenamed("symbol", "company_id"), "company_id", "left_semi").filter(
        (F.col("ts") >= end - F.expr(f"INTERVAL {int(filing_days)} DAYS")) & (F.col("ts") < end))
    typed = stage(events.analyse(recent, bars.join(chosen, "symbol", "left_semi")))
    news = events.summarise(typed, end).select(
        F.col("company_id").alias("symbol"), F.col("net_score").alias("catalyst_score"),
        F.col("event_counts").alias("catalyst_counts"), F.col("top_events").alias("catalyst_top"),
        F.col("events").alias("filings_30d"))
    enriched = first.join(best.select("isin", F.lit(True).alias("enriched")), "isin", "left").join(
        past, "symbol", "left").join(news, "symbol", "left")
    # only the chosen rows have the extra facts, so one scoring pass serves both stages
    no_news = F.col("enriched") & F.col("catalyst_score").isNull()
    final = scoring.pre_result_score(enriched.withColumn(
        "catalyst_score", F.when(no_news, F.lit(0.0)).otherwise(F.col("catalyst_score"))))
    return screen.global_rank(scoring.explain_pre_result(final), "score", "isin")


def market_state(market: DataFrame, today: str, name: str = "Nifty 500", history_days: int = HISTORY_DAYS) -> DataFrame:
    """One row on the market index: returns over 5 and 20 sessions and whether it is above its 50-session mean."""
    now = F.to_date(F.lit(today))
    known = market.filter(F.col("date").between(F.date_sub(now, history_days), now)).select(F.lit(name).alias("symbol"), "date", "c")
    facts = known.select(
        F.col("symbol").alias("index"), b.session_return(5).alias("ret_5d"), b.session_return(20).alias("ret_20d"),
        b.above_average(50).alias("above_50dma"), b.is_last_bar().alias("is_last"), b.bar_number().alias("n"))
    return facts.filter(F.col("is_last") & (F.col("n") >= features.MIN_BARS)).select("index", "ret_5d", "ret_20d", "above_50dma")


def summary(rows: DataFrame, market: DataFrame) -> DataFrame:
    """One row of counts over a scan, how many rows are in each stage, and the state of the market (``market_state``)."""
    stages = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stages"))
    return rows.agg(
        F.count(F.lit(1)).alias("upcoming"), F.count("score").alias("scored"), F.count_if(F.coalesce("enriched", F.lit(False))).alias("enriched"),
        F.count_if(F.col("fund_source") != "none").alias("with_fundamentals"), F.count("deliv_pct_5d").alias("with_delivery"),
        F.count_if(F.coalesce("sector_index", F.lit("")) != "").alias("with_sector_index"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("calendar_sources")))).alias("calendar_sources"),
    ).withColumns({"stages": stages.scalar(), "market": market.select(F.struct("*")).scalar()})
