"""Small Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def clip_range(x: Column, lo: float, hi: float) -> Column:
    return clip01((x - F.lit(float(lo))) / F.lit(float(hi - lo)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero, so that no infinity or NaN appears."""
    return numerator / F.when(denominator != 0, denominator)


def number(x: Column) -> Column:
    """Parse to double; text that is no number, NaN and infinities become null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def weighted_mean(parts: Sequence[tuple[float, Column]]) -> Column:
    """Mean over the components that are present, with their weights renormalised."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in parts])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in parts])
    return ratio(total, weight)


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def drop_nulls(items: Sequence[Column]) -> Column:
    """An array of the given strings without the null ones, order kept."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def signed_percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), F.lit("–")).otherwise(F.format_string(f"%+.{digits}f%%", x * 100))


def blank_to_null(x: Column, *blanks: str) -> Column:
    text = F.trim(x)
    return F.when(~text.isin("", *blanks), text)
