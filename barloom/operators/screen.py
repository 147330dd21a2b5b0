"""Filters, projections, sorts and ranks over company rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.functions import fixed_values as fv
from barloom.functions.scalars import all_of, is_true, number, ratio
from barloom.session import stage

COMPARE = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


# ---- rule screen ---------------------------------------------------------------------------------

def _plain_text(c: Column) -> Column:
    """Text of a value as it is compared: whole numbers without a decimal point, lower case."""
    return F.lower(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def rule(df: DataFrame, field: str, op: str, value: str | float) -> Column:
    """One condition as a Column that is never null.

    The field name is an alias or a column name in lower case; the value is a column of that kind, else a
    literal. A null field is false for every operator; a null column on the right counts as 0. Both sides
    are compared as numbers if both are numbers, else as lower-case text.
    """
    key = lambda s: fv.FIELD_ALIASES.get(s, s)
    left_name = key("".join(field.lower().split()))
    if left_name not in df.columns or op not in COMPARE:
        return F.lit(False)
    left = F.col(f"`{left_name}`")
    raw = str(value).replace("'", "").replace('"', "")
    right_name = key("".join(raw.split()).lower())
    if right_name in df.columns:
        right = F.col(f"`{right_name}`")
        right_number = F.when(right.isNull(), F.lit(0.0)).otherwise(number(right))
        right_text = F.coalesce(_plain_text(right), F.lit("null"))
    else:
        right_number = number(F.lit(raw))
        right_text = _plain_text(F.lit(raw))
    left_number = number(left)
    both = left_number.isNotNull() & right_number.isNotNull()
    same = COMPARE[op]
    return is_true(left.isNotNull() & F.when(both, same(left_number, right_number))
                   .otherwise(same(_plain_text(left), right_text)))


def rule_screen(df: DataFrame, conditions: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows that pass (logic, field, op, value) conditions, folded left to right without precedence."""
    passed = F.lit(True)
    for c in conditions:
        ok = rule(df, str(c["field"]), str(c["op"]), c["value"])
        passed = (passed | ok) if str(c.get("logic", "AND")).upper() == "OR" else (passed & ok)
    return df.filter(passed)


# ---- named filters -----------------------------------------------------------------------------------

def contains_text(query: str, *columns: str) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return text.contains(query.lower())


def equals_unless_all(column: str, wanted: str | None) -> Column:
    return F.lit(True) if wanted in (None, "All") else is_true(F.col(column) == wanted)


def technical_presets() -> dict[str, Column]:
    c = F.col
    return {
        "Price > 200 SMA": is_true(c("ltp") > c("sma200")),
        "Price > 50 SMA": is_true(c("ltp") > c("sma50")),
        "Golden Cross (50>200)": is_true(c("sma50") > c("sma200")),
        "Golden Cross (14>50)": is_true(c("sma14") > c("sma50")),
        "52W High Breakout": is_true(c("ltp") >= c("week52High") * 0.98),
    }


def only_watched(rows: DataFrame, watchlist: DataFrame) -> DataFrame:
    return rows.join(watchlist.select("symbol"), "symbol", "left_semi")


def within_bounds(bounds: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """All (low, high) bounds hold; a null in a bounded field fails, a field without bounds passes."""
    checks = []
    for name, (low, high) in bounds.items():
        if low is None and high is None:
            continue
        v = F.col(f"`{name}`")
        ok = v.isNotNull()
        if low is not None:
            ok = ok & (v >= low)
        if high is not None:
            ok = ok & (v <= high)
        checks.append(is_true(ok))
    return all_of(checks)


def result_screen_filter(search: str = "", max_days: int = 60, scored_only: bool = False, min_fund: float = 0.0,
                         hide_flagged: bool = False) -> Column:
    q = search.strip().lower()
    checks = [F.coalesce("days_left", F.lit(0)) <= max_days, F.coalesce("fund_score", F.lit(0.0)) >= min_fund]
    if q:
        named = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q) for c in ("company", "nse_symbol")]
        checks.append(named[0] | named[1])
    if scored_only:
        checks.append(F.col("composite").isNotNull())
    if hide_flagged:
        checks.append(F.coalesce("flags", F.lit("")) == "")
    return all_of(checks)


def pre_result_filter(search: str = "", stages: Sequence[str] = (), min_adv: float = 0.0,
                      enriched_only: bool = False) -> Column:
    """A null traded value passes; no chosen stage means all of them."""
    q = search.strip().lower()
    checks = [F.col("adv20_cr").isNull() | (F.col("adv20_cr") >= min_adv)]
    if q:
        named = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q) for c in ("company", "symbol")]
        checks.append(named[0] | named[1])
    if stages:
        checks.append(is_true(F.col("stage").isin(*stages)))
    if enriched_only:
        checks.append(is_true(F.col("enriched")))
    return all_of(checks)


def is_material() -> Column:
    return is_true((F.col("materiality_label") != "low") & (F.col("event_type") != "routine"))


def is_headline() -> Column:
    return is_true((F.col("novelty") >= 0.5) & ~F.col("event_type").isin("price_commentary", "other", "routine"))


def look_back_days(days: int) -> int:
    return min(max(int(days), 7), 365)


def upcoming_window(rows: DataFrame, today: str, days_ahead: int, min_sessions: int = 1) -> DataFrame:
    start = F.to_date(F.lit(today))
    return rows.filter(
        F.col("isin").isNotNull() & F.col("result_date").between(start, F.date_add(start, days_ahead))
        & (F.col("trading_days_left") >= min_sessions))


# ---- projections -----------------------------------------------------------------------------------------

def change_percent(pct: Column, net_change: Column, last: Column, previous_close: Column) -> Column:
    """Given percent, else net change over the price before it, else against the previous close."""
    prev = F.when(previous_close != 0, previous_close)
    from_net = F.when(prev.isNotNull(), ratio(net_change, last - net_change) * 100)
    return F.coalesce(pct, from_net, (last - prev) / prev * 100)


def price_with_source(live: Column, close: Column, master: Column) -> tuple[Column, Column]:
    """(price, its source); a zero counts as missing."""
    some = lambda c: F.nullif(c, F.lit(0.0))
    price = F.coalesce(some(live), some(close), master)
    label = F.when(some(live).isNotNull(), "live").when(some(close).isNotNull(), "last_close").otherwise("fundamentals")
    return price, label


def relative_volume(volume: Column, average: Column) -> Column:
    return ratio(volume, average)


def range_position(low: Column, high: Column, current: Column) -> Column:
    """Place of the price in its range, 0..100; null for an empty range."""
    value = ratio(current - low, high - low) * 100
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def positions(portfolio: DataFrame, quotes: DataFrame) -> DataFrame:
    """Profit and loss of held positions; without a quote the price counts as 0."""
    price = F.coalesce("ltp", F.lit(0.0))
    return portfolio.join(quotes.select("symbol", "ltp"), "symbol", "left").select(
        "symbol", "qty", "buy_price",
        ((price - F.col("buy_price")) * F.col("qty")).alias("pnl"),
        (ratio(price - F.col("buy_price"), F.col("buy_price")) * 100).alias("pnl_pct"))


def buy_checklist() -> list[Column]:
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    momentum = F.coalesce(F.col("macd_line") - F.col("macd_signal"), F.col("momentum_score"), F.lit(0.0))
    return [
        (zero("ltp") > zero("ema50")).alias("price_above_ema50"), (zero("ema21") > zero("ema50")).alias("trend_up"),
        (zero("rsi") > 50).alias("momentum_positive"), (momentum > 0).alias("macd_bullish"),
    ]


# ---- sorts, ranks and top lists -----------------------------------------------------------------------------

def nulls_as_lowest(column: str, descending: bool) -> Column:
    """Null and NaN sort like minus infinity in either direction."""
    v = F.col(column).cast("double")
    v = F.when(~F.isnan(v), v)
    return v.desc_nulls_last() if descending else v.asc_nulls_first()


def nulls_always_last(value: Column, descending: bool) -> Column:
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def relative_sort_value(k: int) -> Column:
    return F.coalesce(f"rel_sec_{k}d", f"rel_mkt_{k}d")


def row_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1..n over all rows in ``order``; no task sees more than its share of rows.

    Rows are range-partitioned by the order - its last column should split equal ones - and written down once, so that the
    partition numbers are the same when they are counted and when they are ranked.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "row_positions")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))   # one row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + inside).drop("_part", "_offset")


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """1..n by score (high first), null for rows without one; those stand last, so they shift nobody."""
    ranked = row_positions(df, [F.col(score).desc_nulls_last(), F.col(tie).asc()], name)
    return ranked.withColumn(name, F.when(F.col(score).isNotNull(), F.col(name)))


def best_first(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows; Spark keeps k per task and merges them."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_on: str,
                  salts: int = 32) -> DataFrame:
    """The k first rows per group in two steps: per (group, salt), then per group over at most k x salts rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    few = salted.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= k).drop("_salt")
    return few.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= k).drop("_rn")


# ---- unions and sets --------------------------------------------------------------------------------------------

def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_titles(items: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One item per title, compared in lower case without outer blanks; the first to arrive stays."""
    key = F.lower(F.trim("title"))
    payload = F.struct(*items.columns)
    return items.groupBy(key.alias("_key")).agg(F.min_by(payload, F.struct(*arrival)).alias("p")).select("p.*")


def recency_buckets(items: DataFrame, max_age_h: float = 720) -> DataFrame:
    """Drops old items, moves future ones to now, and names the age bucket."""
    h = F.greatest(F.col("hours_ago"), F.lit(0.0))
    return items.filter(F.col("hours_ago") <= max_age_h).withColumn("hours_ago", h).withColumn(
        "category", F.when(h <= 24, "Last 24 Hours").when(h <= 168, "Past 7 Days").otherwise("Past 30 Days"))


def symbol_union(*frames: DataFrame) -> DataFrame:
    return union_all(*[f.select("symbol") for f in frames]).distinct()
