"""Daily and intraday price bars: parsing, roll-up, history upsert, panel."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

BAR_FIELDS = ["o", "h", "l", "c", "v"]


def order_key(*parts: tuple[Column, int]) -> Column:
    """One decimal from whole numbers of 0 or more, the most significant first, each with at most so many digits (38 in all).

    Orders rows as a struct of the parts would (null as 0), but has a fixed width, so that ``min_by`` and ``max_by`` update it in
    place in a hash aggregate; a struct makes Spark sort the whole input. A part with too many digits fails loudly.
    """
    key = F.lit(0).cast("decimal(1,0)")
    for column, digits in parts:
        part = F.coalesce(column, F.lit(0)).cast(f"decimal({digits},0)")
        key = key * F.lit(Decimal(10 ** digits)) + part
    return key.cast("decimal(38,0)")


def roll_up_ticks(ticks: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Open/high/low/close/volume per key; every aggregate combines before the shuffle.

    ``seq`` is the total order of the ticks within a key, of a fixed width (``order_key``).
    """
    return ticks.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("o"),
        F.max("price").alias("h"),
        F.min("price").alias("l"),
        F.max_by("price", "seq").alias("c"),
        F.sum("qty").alias("v"),
    )


def parse_bars(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Bars from provider rows: keep the exchange date, cast, and keep the first row of a date.

    The stamp carries the exchange's own midnight; its first ten characters are the date.
    """
    fields = [F.col(f).try_cast("double").alias(f) for f in BAR_FIELDS]
    return (
        raw.select("symbol", F.to_date(F.substring("t", 1, 10)).alias("date"), *fields, arrival)
        .groupBy("symbol", "date").agg(*[F.min_by(f, arrival).alias(f) for f in BAR_FIELDS])
    )


def pick_segment(bars: DataFrame, order: Sequence[str], key: str = "isin") -> DataFrame:
    """Bars of the first listing segment (in ``order``) that has any, per instrument."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("segment"))
    chosen = (
        bars.filter(F.col("segment").isin(*order))
        .groupBy(key).agg(F.min_by("segment", rank).alias("segment"))
    )
    return bars.join(chosen, [key, "segment"], "left_semi")


def refetch_from(history: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Per symbol, the first date to ask for again."""
    return history.groupBy("symbol").agg(F.date_sub(F.max("date"), overlap_days).alias("from_date"))


def upsert_bars(history: DataFrame, fetched: DataFrame) -> DataFrame:
    """Union of stored and newly fetched bars; the freshest copy (``load_ts``) of a day wins."""
    both = history.unionByName(fetched)
    freshest = [F.max_by(f, "load_ts").alias(f) for f in BAR_FIELDS]
    return both.groupBy("symbol", "date").agg(*freshest, F.max("load_ts").alias("load_ts"))


def build_panel(bars: DataFrame, index_bars: DataFrame, min_bars: int = 60) -> DataFrame:
    """Long panel: every kept symbol on every index date, nulls where it did not trade.

    A symbol is kept with more than ``min_bars`` bars. The dates of the index are at most one
    row per session, so the spine of dates is small whatever the size of the bars.
    """
    kept = bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") > min_bars).select("symbol")
    calendar = index_bars.agg(F.collect_set("date")).scalar()
    spine = kept.select("symbol", F.explode(calendar).alias("date"))
    fields = [F.col(f).cast("float").alias(n) for f, n in (("c", "close"), ("h", "high"), ("l", "low"), ("v", "vol"))]
    return spine.join(bars.select("symbol", "date", *fields), ["symbol", "date"], "left")


def fill_index(index_bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Index closes on the given dates, the last known close carried forward."""
    w = Window.partitionBy("index_name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    names = index_bars.select("index_name").distinct()
    calendar = dates.agg(F.collect_set("date")).scalar()
    spine = names.select("index_name", F.explode(calendar).alias("date"))
    return spine.join(index_bars, ["index_name", "date"], "left").select(
        "index_name", "date", F.last("c", ignorenulls=True).over(w).alias("close"))


def export_range(today: str, days: int) -> tuple[Column, Column]:
    """First and last date of an export: the last ``days`` calendar days, kept between 30 and 1100."""
    end = F.to_date(F.lit(today))
    return F.date_sub(end, min(max(int(days), 30), 1100)), end
