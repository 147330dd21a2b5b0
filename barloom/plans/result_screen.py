"""Board-meeting result screen: meetings, identities, fundamentals, prices, composite score and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.clock import trading_days
from barloom.operators import features, joins, scoring, screen
from barloom.session import stage
from barloom.sources import feeds
from barloom.sources.sinks import between


def result_screen(meetings: DataFrame, listings: DataFrame, master: DataFrame, provider: DataFrame | None, bars: DataFrame,
                  last_prices: DataFrame, today: str, holidays: Column, history_days: int = 600) -> DataFrame:
    """Ranked rows for upcoming meetings.

    ``meetings`` from ``feeds.parse_board_meetings``; ``bars`` has a symbol column that holds the ISIN;
    ``last_prices`` is (isin, live). A symbol needs more than 20 bars for price features.
    Bars are read up to ``history_days`` back.
    """
    now = F.to_date(F.lit(today))
    upcoming = meetings.filter(F.col("result_date") >= now)
    rows = joins.resolve_meetings(upcoming, listings, master).withColumns({
        "trading_days_left": trading_days(now, F.col("result_date"), holidays),
        "days_left": F.datediff("result_date", now)})
    if provider is not None:
        rows = feeds.fill_from_provider(rows, provider)
    bars = between(bars, F.date_sub(now, history_days), now)
    priced = features.result_screen_features(bars).filter("history_days > 20").withColumnRenamed("symbol", "isin")
    rates = features.base_rate_stats(bars).withColumnRenamed("symbol", "isin")
    stats = [c for c in rates.columns if c != "isin"]
    joined = rows.join(priced, "isin", "left").join(rates, "isin", "left").join(last_prices, "isin", "left")
    price, source = screen.price_with_source(F.col("live"), F.col("last_close"), F.col("Current Price"))
    facts = joined.withColumns({**features.base_rate_columns(), "ltp": price, "ltp_source": source}).drop(*stats, "live")
    scored = stage(scoring.result_screen_scores(facts))
    flagged = scored.withColumn("flags", scoring.result_screen_flags(scored))
    tie = F.concat_ws(":", F.format_string("%020d", F.col("bse_code")), F.col("result_date").cast("string"))
    return screen.global_rank(flagged.withColumn("row_key", tie), "composite", "row_key")


def summary(rows: DataFrame, counts: DataFrame, meetings: DataFrame, last_prices: DataFrame, today: str) -> DataFrame:
    """One row about a screen: its rows, the landed file (``feeds.board_meeting_counts``), meetings that are past, and live prices."""
    source = F.col("fundamentals_source")
    past = meetings.filter(F.col("result_date") < F.to_date(F.lit(today))).agg(F.count(F.lit(1)))
    known = counts.select(F.struct("rows_read", "rows_unparseable", "duplicates_removed")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("meetings_upcoming"), F.count_if(source != "none").alias("with_fundamentals"),
        F.count_if(source == "master").alias("from_master"), F.count_if(source == "provider").alias("from_provider"),
        F.count("last_close").alias("with_prices"), F.count("composite").alias("scored"),
    ).withColumns({"live_prices": last_prices.agg(F.count(F.lit(1)) > 0).scalar(), "_counts": known, "past_dates_dropped": past.scalar()}).select(
        "*", "_counts.*").drop("_counts")
