"""Per-symbol price and volume features from daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import bar_windows as b
from barloom.functions.folds import rsi_exponential
from barloom.functions.scalars import ratio

MIN_BARS = 60
MIN_BENCHMARK_BARS = 30


def align_benchmark(bars: DataFrame, benchmark: DataFrame, on: list[str], name: str) -> DataFrame:
    """Benchmark close on the stock's own dates, the last one carried forward."""
    side = benchmark.select(*on, F.col("c").alias(f"{name}_raw"))
    joined = bars.join(side, on, "left")
    filled = F.last(f"{name}_raw", ignorenulls=True).over(b.running())
    return joined.withColumn(name, filled).drop(f"{name}_raw")


def long_enough(benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmarks with at least 30 bars; shorter ones give no relative return.

    A benchmark has one row per session, so even the unkeyed window holds only the calendar.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return benchmark.withColumn("bench_bars", F.count(F.lit(1)).over(w)).filter(
        F.col("bench_bars") >= MIN_BENCHMARK_BARS).drop("bench_bars")


def all_bar_features(bars: DataFrame, market: DataFrame | None = None, sector: DataFrame | None = None) -> DataFrame:
    """Scanner features on every bar, from one sorted pass per symbol.

    ``market`` is (date, c); ``sector`` is (sector, date, c) and needs a ``sector`` column on the bars.
    """
    benches = []
    if market is not None:
        bars = align_benchmark(bars, long_enough(market, []), ["date"], "mkt")
        benches.append("mkt")
    if sector is not None:
        bars = align_benchmark(bars, long_enough(sector, ["sector"]), ["sector", "date"], "sec")
        benches.append("sec")

    basic = bars.select(
        "*",
        b.bar_number().alias("bar_no"),
        b.is_last_bar().alias("is_last"),
        b.log_return().alias("log_ret"),
        (F.col("c") - F.lag("c").over(b.series())).alias("change"),
        *[b.session_return(k).alias(f"ret_{k}d") for k in (5, 10, 20, 60)],
        *[b.session_return(k, name).alias(f"{name}_ret_{k}d") for name in benches for k in (5, 10, 20)],
    )
    wide = basic.select(
        "*",
        F.lag("ret_5d", 5).over(b.series()).alias("ret_prev5d"),
        b.daily_sigma().alias("sigma_daily"),
        b.relative_volume_5d().alias("rvol_5d"),
        b.relative_volume_1d().alias("rvol_1d"),
        b.up_down_volume().alias("updown_vol_ratio"),
        b.traded_value().alias("adv20_cr"),
        b.range_percent().alias("atr_pct"),
        b.fraction_of_high("h").alias("pct_of_52w_high"),
        b.above_average(20).alias("above_20dma"),
        b.above_average(50).alias("above_50dma"),
    )
    return wide.select(
        "*",
        (F.col("ret_5d") - F.col("ret_prev5d")).alias("accel"),
        b.annualised(F.col("sigma_daily")).alias("vol_ann"),
        b.return_in_sigmas("ret_20d", "sigma_daily", 20).alias("z_20d"),
        b.return_in_sigmas("ret_5d", "sigma_daily", 5).alias("z_5d"),
        *[(F.col(f"ret_{k}d") - F.col(f"{name}_ret_{k}d")).alias(f"rel_{name}_{k}d")
          for name in benches for k in (5, 10, 20)],
    )


FEATURES = [
    "sigma_daily", "vol_ann", "ret_5d", "ret_10d", "ret_20d", "ret_60d", "ret_prev5d", "accel", "rvol_5d", "rvol_1d",
    "updown_vol_ratio", "adv20_cr", "atr_pct", "pct_of_52w_high", "above_20dma", "above_50dma", "z_20d", "z_5d",
]


def scanner_features(bars: DataFrame, market: DataFrame | None = None, sector: DataFrame | None = None) -> DataFrame:
    """One row per symbol: the features on its newest bar, with the exponential RSI of its whole history.

    Under 60 bars only the number of bars is given. The aggregate keeps the windows' partitioning,
    so it adds no shuffle.
    """
    wide = all_bar_features(bars, market, sector)
    rel = [c for c in wide.columns if c.startswith("rel_")]
    names = FEATURES + rel
    picked = wide.groupBy("symbol").agg(
        F.max("bar_no").cast("long").alias("history_days"),
        F.max_by(F.struct("date", "c", *names), F.col("date")).alias("f"),
        F.collect_list(F.struct("date", "c")).alias("history"),
    )
    enough = F.col("history_days") >= MIN_BARS
    closes = F.transform(F.array_sort("history"), lambda x: x["c"])
    return picked.select(
        "symbol", "history_days",
        F.when(enough, F.col("f.c")).alias("last_close"),
        F.when(enough, F.col("f.date")).alias("last_candle_date"),
        *[F.when(enough, F.col(f"f.{n}")).alias(n) for n in names],
        F.when(enough, rsi_exponential(closes)).alias("rsi14"),
    )


def result_screen_features(bars: DataFrame) -> DataFrame:
    """The result screen's own feature set on the newest bar; its 52-week high is of closes."""
    basic = bars.select(
        "*", b.bar_number().alias("bar_no"), b.is_last_bar().alias("is_last"), b.log_return().alias("log_ret"),
        *[b.session_return(k).alias(f"ret_{k}d") for k in (5, 20, 60)],
    )
    n = F.col("bar_no")
    return basic.select(
        "symbol", "is_last", F.col("c").alias("last_close"), F.col("date").alias("last_candle_date"),
        "ret_5d", "ret_20d", "ret_60d",
        b.fraction_of_high("c").alias("pct_of_52w_high"),
        F.when(n > 20, b.annualised(F.stddev_samp("log_ret").over(b.trailing(60)))).alias("vol_ann"),
        b.volume_5_over_60().alias("vol_ratio_5v60"),
        b.traded_value().alias("adv20_cr"),
        F.when(n >= 50, b.above_average(50)).alias("above_50dma"),
        n.cast("long").alias("history_days"),
    ).filter("is_last").drop("is_last")


def base_rate_stats(bars: DataFrame) -> DataFrame:
    """Per symbol, for 7 and for 15 bars ahead: share of bars that touched +10 % and share that closed 10 % lower.

    Only bars with a full horizon ahead count. ``base_rate_columns`` picks the horizon.
    """
    ahead = {}
    for h in (7, 15):
        ahead[h] = (
            ratio(F.max("c").over(b.series().rowsBetween(1, h)), F.col("c")) - 1,
            ratio(F.lead("c", h).over(b.series()), F.col("c")) - 1,
        )
    looked = bars.select("symbol", "date", "c", *[
        x.alias(f"{name}_{h}") for h, pair in ahead.items() for name, x in zip(("top", "end"), pair)])
    return looked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        *[F.avg(F.when(F.col(f"end_{h}").isNotNull(), (F.col(f"top_{h}") >= 0.10).cast("double"))).alias(f"touch_{h}")
          for h in ahead],
        *[F.avg((F.col(f"end_{h}") <= -0.10).cast("double")).alias(f"below_{h}") for h in ahead],
    )


def base_rate_columns() -> dict[str, Column]:
    """Columns over rows with trading_days_left and the stats: up to 9 sessions left look 7 bars ahead, else 15.

    Symbols need more than horizon + 30 bars.
    """
    h = F.when(F.col("trading_days_left") <= 9, 7).otherwise(15)
    ok = F.col("n_bars") > h + 30
    pick = lambda name: F.when(ok, F.when(h == 7, F.col(f"{name}_7")).otherwise(F.col(f"{name}_15")))
    return {"base_window_days": F.when(ok, h), "base_touch_10pct": pick("touch"), "base_close_below_m10pct": pick("below")}


def base_rate(bars: DataFrame, horizon_by_symbol: DataFrame) -> DataFrame:
    """How often a symbol touched +10 % or closed 10 % lower within its horizon; takes (symbol, trading_days_left)."""
    return horizon_by_symbol.join(base_rate_stats(bars), "symbol").select(
        "symbol", *[c.alias(name) for name, c in base_rate_columns().items()])


def streak_vs_sma(bars: DataFrame, k: int = 200) -> DataFrame:
    """Signed number of latest bars in a row above (+) or below (-) the k-bar mean; on the mean: 0."""
    side = bars.select(
        "symbol", "date", b.bar_number().alias("bar_no"),
        F.signum(F.col("c") - b.full_average("c", k)).alias("side"),
    )
    latest = side.groupBy("symbol").agg(
        F.max("bar_no").alias("n"), F.max_by("side", "bar_no").alias("side_now"),
        F.max(F.when(~F.coalesce(F.col("side") > 0, F.lit(False)), F.col("bar_no"))).alias("last_not_above"),
        F.max(F.when(~F.coalesce(F.col("side") < 0, F.lit(False)), F.col("bar_no"))).alias("last_not_below"),
    )
    above = F.col("n") - F.coalesce("last_not_above", F.lit(0))
    below = F.col("n") - F.coalesce("last_not_below", F.lit(0))
    return latest.select(
        "symbol",
        F.when(F.col("side_now") > 0, above).when(F.col("side_now") < 0, -below).otherwise(0).cast("long").alias("streak"),
    )


def delivery_trend(delivery: DataFrame) -> DataFrame:
    """Delivered share and quantity, last 5 sessions against the earlier ones, per symbol.

    Input is at most 25 sessions (``recent_sessions``), so a symbol's window is that small.
    """
    def newest_first(value: str):
        w = Window.partitionBy("symbol").orderBy(F.col(value).isNull(), F.col("date").desc())
        return F.when(F.col(value).isNotNull(), F.row_number().over(w))

    ranked = delivery.select(
        "symbol", "deliv_pct", "deliv_qty",
        newest_first("deliv_pct").alias("p"), newest_first("deliv_qty").alias("q"))
    stats = ranked.groupBy("symbol").agg(
        F.count("deliv_pct").alias("n_pct"), F.count("deliv_qty").alias("n_qty"),
        F.avg(F.when(F.col("p") <= 5, F.col("deliv_pct"))).alias("pct_5d"),
        F.avg(F.when(F.col("p") > 5, F.col("deliv_pct"))).alias("pct_base"),
        F.avg(F.when(F.col("q") <= 5, F.col("deliv_qty"))).alias("qty_5d"),
        F.avg(F.when(F.col("q") > 5, F.col("deliv_qty"))).alias("qty_base"),
    )
    ok = F.col("n_pct") >= 8
    return stats.select(
        "symbol",
        F.when(ok, F.col("pct_5d")).alias("deliv_pct_5d"),
        F.when(ok, F.col("pct_base")).alias("deliv_pct_base"),
        F.when(ok, F.col("pct_5d") - F.col("pct_base")).alias("deliv_pct_change"),
        F.when(ok & (F.col("n_qty") >= 10), ratio(F.col("qty_5d"), F.col("qty_base"))).alias("deliv_qty_ratio"),
    )


def recent_sessions(delivery: DataFrame, sessions: int = 25, at_least: int = 0) -> DataFrame:
    """The rows of the newest ``sessions`` dates, none if there are fewer than ``at_least`` dates in all.

    The dates come from a small aggregate, not a window.
    """
    newest = delivery.select("date").distinct().orderBy(F.col("date").desc()).limit(sessions)
    first = newest.agg(F.when(F.count(F.lit(1)) >= at_least, F.min("date"))).scalar()
    return delivery.filter(F.col("date") >= first)


def recent_stored_sessions(delivery: DataFrame, sessions: int = 25, at_least: int = 0) -> DataFrame:
    """As ``recent_sessions`` for rows stored by ``month``: only the newest months are read, as many as hold ``sessions`` dates.

    Which months there are is known without reading rows. They are asked for newest first, twice as many each time.
    """
    months = [r["month"] for r in delivery.select("month").distinct().orderBy(F.desc("month")).collect()]     # bounded by the calendar
    n = 2
    while True:
        newest = delivery.filter(F.col("month").isin(months[:n]))
        if n >= len(months) or newest.select("date").distinct().count() >= max(sessions, at_least):
            return recent_sessions(newest, sessions, at_least).drop("month")
        n *= 2
