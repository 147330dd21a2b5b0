"""Recursive indicators over long series, block by block: no task holds more than one block of a symbol.

A series is cut into blocks of time. An exponential mean is a linear recurrence, so a whole block acts on what came before it as an affine
map: mean' = p * sum + q * mean + r, where ``sum`` is that of the values before the first mean. The maps of a symbol's blocks, one row
each, are composed in order, which gives the state at the start of every block; then each block is filled from its own start.
The value before a block's first row comes the same way, from the last row of the block before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.carried import SKIPPED, smoothed_on
from barloom.session import stage, unstage

#: Seconds in a block of five-minute bars: at most 576 rows.
BLOCK_SECONDS = 2 * 86_400
BLOCK = ["symbol", "blk"]


@dataclass(frozen=True)
class Mean:
    """An exponential mean ``name`` of the column ``value``, nulls left out; it starts as the plain mean of ``period`` values."""

    name: str
    value: str
    period: int
    alpha: float


def block_of(ts: Column, seconds: int = BLOCK_SECONDS) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def with_previous(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds ``prev`` (struct of the columns on the row before, null on a symbol's first) and ``n`` (1, 2, ... per symbol).

    ``rows`` has symbol, blk and ts. Windows run inside blocks, and over one row per block.
    """
    told = F.struct(*columns)
    ends = rows.groupBy(*BLOCK).agg(F.max_by(told, "ts").alias("last"), F.count("*").alias("rows"))
    over = Window.partitionBy("symbol").orderBy("blk")
    starts = ends.select(*BLOCK, F.lag("last").over(over).alias("before"),
                         (F.sum("rows").over(over) - F.col("rows")).alias("offset"))
    inside = Window.partitionBy(*BLOCK).orderBy("ts")
    return rows.join(starts, BLOCK).select(
        *rows.columns, F.coalesce(F.lag(told).over(inside), F.col("before")).alias("prev"),
        (F.row_number().over(inside) + F.col("offset")).alias("n"))


def block_map(x: np.ndarray, seen: int, period: int, alpha: float) -> tuple[float, float, float, float]:
    """(p, q, r, s) of a block with the values ``x`` behind ``seen`` others: mean' = p * sum + q * mean + r, sum' = sum + s."""
    head = max(0, period - seen)
    s = float(x[:head].sum())
    if seen + len(x) < period:
        return 0.0, 0.0, 0.0, s
    rest = x[head:]
    keep = (1 - alpha) ** len(rest)
    r = float(pd.Series(np.append(0.0, rest)).ewm(alpha=alpha, adjust=False).mean().iloc[-1])
    return (keep / period, 0.0, r + keep * s / period, s) if head else (0.0, keep, r, s)


def blocked_means(rows: DataFrame, means: list[Mean]) -> DataFrame:
    """``rows`` (symbol, blk, ts and more) with a column per mean, null before its first value; stored."""
    over = Window.partitionBy("symbol").orderBy("blk")
    counts = rows.groupBy(*BLOCK).agg(*[F.count(m.value).alias(m.name) for m in means])
    seen = counts.select(*BLOCK, F.array(*[F.sum(m.name).over(over) - F.col(m.name) for m in means]).alias("seen"))
    numbered = stage(rows.join(seen, BLOCK), "blocks")
    known = lambda pdf, m: pdf[m.value].dropna().to_numpy(float)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        found = [x for i, m in enumerate(means) for x in block_map(known(pdf, m), int(pdf["seen"].iloc[0][i]), m.period, m.alpha)]
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "seen": [list(pdf["seen"].iloc[0])], "maps": [found]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a block: the state of each mean at its start."""
        pdf = pdf.sort_values("blk")
        sums, values, out = np.zeros(len(means)), np.full(len(means), np.nan), []
        for m in pdf["maps"]:
            out.append([float(x) for pair in zip(sums, values) for x in pair])
            p, q, r, s = np.array(m, float).reshape(-1, 4).T
            started = (p != 0) | (q != 0)
            values = np.where(started, p * sums + np.where(q != 0, q * values, 0.0) + r, np.nan)
            sums = sums + s
        return pd.DataFrame({"symbol": pdf["symbol"], "blk": pdf["blk"], "start": out})

    blocks = numbered.groupBy(*BLOCK).applyInPandas(maps, "symbol string, blk long, seen array<long>, maps array<double>")
    begun = blocks.select("symbol", "blk", "maps").groupBy("symbol").applyInPandas(starts, "symbol string, blk long, start array<double>")
    columns = [*rows.columns, *[m.name for m in means]]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        first, start = pdf["seen"].iloc[0], pdf["start"].iloc[0]
        for i, m in enumerate(means):
            values = np.full(len(pdf), np.nan)
            here = pdf[m.value].notna().to_numpy()
            values[here] = smoothed_on([float(first[i]), start[2 * i], start[2 * i + 1]], known(pdf, m), m.period, m.alpha)[0]
            pdf[m.name] = pd.array(values, dtype="Float64")
            pdf[m.name] = pdf[m.name].mask(np.isnan(values))
        return pdf[columns]

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"`{m.name}` double" for m in means]])
    out = stage(numbered.join(stage(begun, "starts"), BLOCK).groupBy(*BLOCK).applyInPandas(fill, schema), "filled")
    unstage(numbered)
    return out


LONG_FIELDS = ["ema21", "ema50", "rsi14", "macd_line", "macd_signal", "macd_hist", "atr14", "adx14"]


def long_indicators(bars: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(symbol, ts, LONG_FIELDS) on every bar; ``bars``: symbol, ts, h, l, c. The values are those of ``folds.indicator_series``."""
    rows = with_previous(bars.select("symbol", block_of(F.col("ts"), seconds).alias("blk"), "ts", "h", "l", "c"), "h", "l", "c")
    move, rise, fall = F.col("c") - F.col("prev.c"), F.col("h") - F.col("prev.h"), F.col("prev.l") - F.col("l")
    wide = F.greatest(F.col("h"), F.col("prev.c")) - F.least(F.col("l"), F.col("prev.c"))
    later = lambda v: F.when(F.col("prev").isNotNull(), v)
    zero = F.lit(0.0)
    first = rows.select(
        *BLOCK, "ts", "n", "c", wide.alias("tr"), later(F.greatest(move, zero)).alias("up_move"), later(F.greatest(-move, zero)).alias("down_move"), later(wide).alias("span_in"),
        later(F.when((rise > fall) & (rise > 0), rise).otherwise(zero)).alias("plus"),
        later(F.when((fall > rise) & (fall > 0), fall).otherwise(zero)).alias("minus"))
    w = 1 / 14
    means = blocked_means(first, [
        *[Mean(f"ema{p}", "c", p, 2 / (p + 1)) for p in (12, 21, 26, 50)], Mean("gain", "up_move", 14, w), Mean("loss", "down_move", 14, w),
        Mean("atr14", "tr", 14, 2 / 15), Mean("span", "span_in", 14, w), Mean("up", "plus", 14, w), Mean("down", "minus", 14, w)])
    both = F.col("up") + F.col("down")
    figure = F.when(F.col("span").isNotNull(), F.when((F.col("span") == 0) | (both == 0), zero).otherwise(F.abs(F.col("up") - F.col("down")) / both * 100))
    with_figure = means.withColumns({"line": F.col("ema12") - F.col("ema26"), "figure": figure})
    # the first mean of the figures stands one bar later, in the place of the one that is left out: the figures before it come one bar late
    last = SKIPPED + SKIPPED + 1                                          # the bar of the figure that is left out, counted from 1
    ready = with_previous(with_figure.drop("n"), "figure").withColumn(
        "figure", F.when(F.col("n") <= last, F.col("prev.figure")).otherwise(F.col("figure"))).drop("prev")
    done = blocked_means(ready, [Mean("macd_signal", "line", 9, 0.2), Mean("adx14", "figure", 14, w)])
    rsi = F.when(F.col("loss") == 0, 100.0).otherwise(100 * F.col("gain") / (F.col("gain") + F.col("loss")))
    return done.select(
        "symbol", "ts", "ema21", "ema50", rsi.alias("rsi14"), F.col("line").alias("macd_line"), "macd_signal",
        (F.col("line") - F.col("macd_signal")).alias("macd_hist"), "atr14", "adx14")
