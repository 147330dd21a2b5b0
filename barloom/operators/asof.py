"""As-of lookups on session dates.

Points are first reduced to distinct (symbol, date), so a window partition holds one symbol's
sessions and asked dates - both bounded by the calendar - even if one symbol has most of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _lookup(points: DataFrame, bars: DataFrame, payload: Column, backward: bool) -> DataFrame:
    asked = points.select("symbol", "date").distinct()
    known = bars.select("symbol", "date", payload.alias("found"), F.lit(0).alias("kind"))
    want = asked.select("symbol", "date", F.lit(None).cast(known.schema["found"].dataType).alias("found"),
                        F.lit(1).alias("kind"))
    by_date = F.col("date") if backward else F.col("date").desc()
    w = Window.partitionBy("symbol").orderBy(by_date, "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = known.unionByName(want).withColumn("found", F.last("found", ignorenulls=True).over(w))
    return filled.filter("kind = 1").select("symbol", "date", "found")


def last_session_on_or_before(points: DataFrame, bars: DataFrame, payload: Column) -> DataFrame:
    """(symbol, date, found) with the payload of the newest bar not after the date, or null."""
    return _lookup(points, bars, payload, backward=True)


def first_session_on_or_after(points: DataFrame, bars: DataFrame, payload: Column) -> DataFrame:
    return _lookup(points, bars, payload, backward=False)


def align_by_date(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two series on the union of their dates; null where one of them has no bar."""
    a = left.select("date", F.struct(*[c for c in left.columns if c != "date"]).alias("a"))
    b = right.select("date", F.struct(*[c for c in right.columns if c != "date"]).alias("b"))
    return a.join(b, "date", "full_outer")
