"""Window Columns over one symbol's bars.

All of them share one partitioning and one ordering, so Spark sorts each symbol once.
A partition holds one symbol's daily bars: bars are rolled up per (symbol, date) first, so it
can have no more rows than there were sessions, however many trades lie behind them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec, functions as F

from barloom.functions.scalars import ratio


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def running() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)



def trailing(k: int, end: int = 0) -> WindowSpec:
    """The k bars that end ``end`` bars before the current one."""
    return series().rowsBetween(-(k - 1) - end, -end)


def bar_number() -> Column:
    return F.row_number().over(series())


def is_last_bar() -> Column:
    """True on the newest bar; uses the same ordering as the other windows, so no second sort."""
    return F.lead("date").over(series()).isNull()


def session_return(k: int, close: str = "c") -> Column:
    return ratio(F.col(close), F.lag(close, k).over(series())) - 1


def log_return() -> Column:
    previous = F.lag("c").over(series())
    return F.when((F.col("c") > 0) & (previous > 0), F.ln(F.col("c") / previous))


def daily_sigma(log_ret: str = "log_ret", k: int = 60) -> Column:
    """Sample deviation of the last k log returns; zero counts as unknown."""
    s = F.stddev_samp(log_ret).over(trailing(k))
    return F.when(s != 0, s)


def annualised(sigma: Column) -> Column:
    return sigma * F.lit(math.sqrt(250))


def average(name: str, k: int, end: int = 0) -> Column:
    return F.avg(name).over(trailing(k, end))


def full_average(name: str, k: int) -> Column:
    """Mean of the last k bars, null before there are k of them."""
    w = trailing(k)
    return F.when(F.count(F.lit(1)).over(w) == k, F.avg(name).over(w))


def relative_volume_5d() -> Column:
    return ratio(average("v", 5), average("v", 50, end=5))


def relative_volume_1d() -> Column:
    return ratio(F.col("v"), average("v", 20, end=1))


def up_down_volume(change: str = "change", k: int = 10) -> Column:
    """Volume of rising bars over volume of the rest; a flat bar is not a rising one."""
    rising = F.coalesce(F.col(change) > 0, F.lit(False))
    up = F.sum(F.when(rising, F.col("v")).otherwise(F.lit(0.0))).over(trailing(k))
    rest = F.sum(F.when(~rising, F.col("v")).otherwise(F.lit(0.0))).over(trailing(k))
    return ratio(up, rest)


def traded_value(k: int = 20) -> Column:
    """Average daily traded value in crore."""
    return F.avg(F.col("c") * F.col("v")).over(trailing(k)) / F.lit(1e7)


def range_percent(k: int = 14) -> Column:
    return F.avg(ratio(F.col("h") - F.col("l"), F.col("c"))).over(trailing(k))


def fraction_of_high(field: str = "h", k: int = 250) -> Column:
    return ratio(F.col("c"), F.max(field).over(trailing(k)))


def above_average(k: int) -> Column:
    return F.col("c") > average("c", k)


def return_in_sigmas(ret: str, sigma: str, k: int) -> Column:
    return ratio(F.col(ret), F.col(sigma) * F.lit(math.sqrt(k)))


def volume_5_over_60() -> Column:
    return ratio(average("v", 5), average("v", 60))


def on_balance_volume(change: str = "change") -> Column:
    return F.sum(F.coalesce(F.signum(change) * F.col("v"), F.lit(0.0))).over(running())


def cumulative_vwap() -> Column:
    """Running value over running volume; a bar without volume repeats the previous figure."""
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3
    volume = F.coalesce(F.col("v"), F.lit(0.0))
    return ratio(F.sum(typical * volume).over(running()), F.sum(volume).over(running()))


def bollinger(k: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) with the population deviation."""
    mid = full_average("c", k)
    dev = F.stddev_pop("c").over(trailing(k))
    return mid + width * dev, mid, mid - width * dev


def stochastic_k(k: int = 14) -> Column:
    w = trailing(k)
    low, high = F.min("l").over(w), F.max("h").over(w)
    value = F.when(high == low, F.lit(50.0)).otherwise((F.col("c") - low) / (high - low) * 100)
    return F.when(F.count(F.lit(1)).over(w) == k, value)
