"""Exchange clock and trading calendar as Column expressions. No function reads the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EXCHANGE_ZONE = "Asia/Kolkata"
PRE_OPEN, OPEN, CLOSE = 540, 555, 930          # minutes of the local day


def local_time(ts: Column) -> Column:
    """Exchange-local wall time of an instant (the session zone is UTC)."""
    return F.from_utc_timestamp(ts, EXCHANGE_ZONE)


def exchange_date(ts: Column) -> Column:
    return F.to_date(local_time(ts))


def local_epoch_seconds(ts: Column) -> Column:
    """Seconds whose UTC reading is the exchange-local clock (for intraday axes)."""
    return F.unix_timestamp(local_time(ts))


def minute_of_day(ts: Column) -> Column:
    local = local_time(ts)
    return F.hour(local) * 60 + F.minute(local)


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def market_status(ts: Column) -> Column:
    """before-open, pre-open, open or closed; weekends are closed and holidays are not modelled."""
    m = minute_of_day(ts)
    return (
        F.when(~is_weekday(exchange_date(ts)), "closed")
        .when(m < PRE_OPEN, "before-open").when(m < OPEN, "pre-open").when(m < CLOSE, "open").otherwise("closed"))


def skip_quotes(ts: Column) -> Column:
    return ~market_status(ts).isin("open", "pre-open")


def poll_seconds(ts: Column) -> Column:
    s = market_status(ts)
    return F.when(s == "open", 30).when(s == "pre-open", 60).when(s == "closed", 300).otherwise(600)


def time_until_open(ts: Column) -> Column:
    """'3d', '2h 5m' or '40m' to the next weekday opening; null while open or in pre-open."""
    day, m = F.weekday(exchange_date(ts)), minute_of_day(ts)      # Monday is 0
    left = OPEN - m
    today = F.when(left < 60, F.format_string("%dm", left)).otherwise(
        F.format_string("%dh %dm", F.floor(left / 60).cast("int"), left % 60))
    days = F.when(day == 4, 3).when(day == 5, 2).otherwise(1)
    return (F.when(~skip_quotes(ts), F.lit(None).cast("string"))
            .when((day < 5) & (m < OPEN), today).otherwise(F.format_string("%dd", days)))


def _weekdays_before(d: Column) -> Column:
    n = F.datediff(d, F.to_date(F.lit("1970-01-05")))              # a Monday
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def trading_days(start: Column, end: Column, holidays: Column) -> Column:
    """Sessions in [start, end): weekdays that are no holiday; 0 when the end is not later.

    ``holidays`` is an array of dates, a few dozen at most.
    """
    closed = F.size(F.filter(F.array_distinct(holidays), lambda h: (h >= start) & (h < end) & is_weekday(h)))
    count = _weekdays_before(end) - _weekdays_before(start) - closed
    return F.when(end <= start, F.lit(0)).otherwise(count).cast("int")


def holiday_literal(*days: str) -> Column:
    return F.array(*[F.to_date(F.lit(d)) for d in days]) if days else F.array().cast("array<date>")
