"""Price behaviour around dated events: past results and news items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import bar_windows as b
from barloom.functions.clock import CLOSE, exchange_date, minute_of_day
from barloom.functions.scalars import ratio
from barloom.operators.asof import first_session_on_or_after, last_session_on_or_before
from barloom.operators.features import align_benchmark


def around_each_session(bars: DataFrame, market: DataFrame | None, window: int = 10) -> DataFrame:
    """Per session: drift over ``window`` sessions before it, gap after it, and the two-day reaction."""
    bars = align_benchmark(bars, market, ["date"], "mkt") if market is not None else bars.withColumn(
        "mkt", F.lit(None).cast("double"))
    w = b.series()
    before = lambda name, k: F.lag(name, k).over(w)
    pre = ratio(before("c", 1), before("c", window + 1)) - 1
    mkt_pre = ratio(before("mkt", 1), before("mkt", window + 1)) - 1
    usable = (b.bar_number() > window + 1) & F.lead("c").over(w).isNotNull()
    return bars.select(
        "symbol", "date",
        usable.alias("usable"),
        pre.alias("pre_ret"), (pre - mkt_pre).alias("pre_excess"),
        (ratio(F.lead("o").over(w), F.col("c")) - 1).alias("gap"),
        (ratio(F.lead("c").over(w), before("c", 1)) - 1).alias("reaction_2d"),
    )


def result_events(bars: DataFrame, past_dates: DataFrame, market: DataFrame | None = None, window: int = 10) -> DataFrame:
    """One row per past result date that has enough sessions on both sides.

    A date means the first session on or after it.
    """
    values = F.struct("usable", "pre_ret", "pre_excess", "gap", "reaction_2d")
    around = around_each_session(bars, market, window)
    found = first_session_on_or_after(past_dates, around, values)
    return found.filter("found.usable").select("symbol", "date", "found.*").drop("usable")


def results_history(bars: DataFrame, past_dates: DataFrame, market: DataFrame | None = None, window: int = 10) -> DataFrame:
    """Statistics over a symbol's past results and the eight newest of them."""
    events = result_events(bars, past_dates, market, window)
    excess = F.coalesce("pre_excess", "pre_ret")
    share = lambda cond: F.avg(cond.cast("double"))
    detail = F.struct("date", "pre_ret", "pre_excess", "gap", "reaction_2d")
    return events.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("hist_events"),
        F.avg(excess).alias("hist_pre_excess_mean"),
        F.median(excess).alias("hist_pre_excess_median"),
        share(excess > 0).alias("hist_pre_hit_rate"),
        F.avg("gap").alias("hist_gap_mean"),
        F.avg(F.abs("gap")).alias("hist_gap_abs_mean"),
        F.avg("reaction_2d").alias("hist_reaction_mean"),
        F.avg(F.abs("reaction_2d")).alias("hist_reaction_abs_mean"),
        share(F.col("reaction_2d") > 0).alias("hist_reaction_pos_rate"),
        F.slice(F.sort_array(F.collect_list(detail), asc=False), 1, 8).alias("hist_detail"),
    )


def effective_date(ts: Column) -> Column:
    """The date whose bar is the last one known before an item: an item after the close includes its own day."""
    d = exchange_date(ts)
    return F.when(minute_of_day(ts) >= CLOSE, d).otherwise(F.date_sub(d, 1))


def price_reactions(items: DataFrame, bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Adds the move into each item and since it, plain and in sigmas.

    ``items`` needs ``symbol`` and ``ts``. Sessions needed: lookback + 25 in all, lookback + 20 up to the item.
    """
    w = b.series()
    numbered = bars.select("symbol", "date", "c", b.bar_number().alias("bar_no"), b.log_return().alias("log_ret"),
                           b.session_return(lookback).alias("pre"))
    known = numbered.select("*", b.daily_sigma().alias("sigma"))
    ends = bars.groupBy("symbol").agg(F.max_by("c", "date").alias("last_c"), F.count(F.lit(1)).alias("n_bars"))
    dated = items.withColumn("_eff", effective_date(F.col("ts")))
    refs = last_session_on_or_before(
        dated.select("symbol", F.col("_eff").alias("date")), known, F.struct("c", "bar_no", "pre", "sigma"))
    refs = refs.join(ends, "symbol").withColumnRenamed("date", "_eff")
    usable = (F.col("n_bars") >= lookback + 25) & (F.col("found.bar_no") >= lookback + 20)
    after = F.col("n_bars") - F.col("found.bar_no")
    post = ratio(F.col("last_c"), F.col("found.c")) - 1
    sigma = F.col("found.sigma")
    z = lambda move, k: F.round(move / (sigma * F.sqrt(k)), 2)
    measured = refs.filter(usable).select(
        "symbol", "_eff",
        F.round("found.pre", 4).alias("pre_move"),
        z(F.col("found.pre"), F.lit(float(lookback))).alias("pre_move_z"),
        F.when(after > 0, F.round(post, 4)).alias("post_move"),
        F.when(after > 0, z(post, F.least(after, F.lit(20)))).alias("post_move_z"),
        F.when(after > 0, after.cast("int")).alias("post_sessions"),
    )
    return dated.join(measured, ["symbol", "_eff"], "left").drop("_eff")
