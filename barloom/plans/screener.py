"""The live screener table as one DataFrame: quotes, listings, signals, fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators import joins, scoring, screen


def screener_signals(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Signal columns per symbol from its daily bars; the score is null under 50 bars. ``fundamentals`` is (symbol, fundamentalScore)."""
    inputs = scoring.signal_inputs(bars).join(fundamentals, "symbol", "left").withColumn(
        "fundamental_score", F.col("fundamentalScore"))
    return scoring.composite_signal(inputs).select(
        "symbol", F.col("signal_score").alias("signalScore"), "signal", "breakdown", "signal_warning", "rsi", "adx",
        *[f"ema{p}" for p in (14, 21, 50, 100, 200)], *[f"sma{p}" for p in (14, 50, 100, 200)],
        "macd_line", "macd_signal", "supertrend", "bb_up", "bb_mid", "bb_low", "week52High", "week52Low",
        F.when(F.col("bars") >= 20, F.col("avg20")).alias("avgVolume"))


def screener_table(quotes: DataFrame, bars: DataFrame, universe: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """One row per quoted and listed symbol.

    ``fundamentals`` is (symbol, fundamentalScore). A symbol with under 50 bars has no signal; unknown
    tickers are dropped.
    """
    signals = screener_signals(bars, fundamentals)
    live = joins.quotes_with_universe(quotes, universe, fundamentals).join(signals, "symbol", "left")
    return live.withColumns({
        "changePct": screen.change_percent(F.col("given_pct"), F.col("net_change"), F.col("ltp"), F.col("prev_close")),
        "relVol": screen.relative_volume(F.col("volume"), F.col("avgVolume")),
    }).drop("given_pct", "net_change", "prev_close")
