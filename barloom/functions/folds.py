"""Recursive indicators: each value depends on the previous one, so no window frame fits.

``*_latest`` Columns fold one symbol's ordered bar array inside the JVM and give the newest value.
The array has one element per session, so its length is bounded by the calendar.
``indicator_series`` gives the value on every bar, with numpy inside one task per symbol.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

D = "double"


def _state(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _null() -> Column:
    return F.lit(None).cast(D)


def _count() -> Column:
    return F.lit(0)


def moves(values: Column) -> Column:
    """Differences of neighbours; empty for fewer than two values."""
    pairs = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values, lambda b, a: b - a)
    return F.filter(pairs, lambda d: d.isNotNull())


def ema_latest(values: Column, period: int) -> Column:
    """Exponential mean, seeded with the simple mean of the first ``period`` values."""
    k = 2.0 / (period + 1)
    n = F.size(values)
    seed = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    rest = F.slice(values, period + 1, F.greatest(n - period, F.lit(0)))
    return F.when(n >= period, F.aggregate(rest, seed, lambda a, x: x * k + a * (1 - k)))


def rsi_exponential(closes: Column, n: int = 14) -> Column:
    """RSI from exponential means (alpha = 1/n) that start at the first move; no fall gives 100."""
    alpha = 1.0 / n

    def step(s: Column, d: Column) -> Column:
        up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
        return _state(
            up=F.when(s["up"].isNull(), up).otherwise(s["up"] * (1 - alpha) + up * alpha),
            dn=F.when(s["dn"].isNull(), down).otherwise(s["dn"] * (1 - alpha) + down * alpha),
        )

    finish = lambda s: F.when(s["dn"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + s["up"] / s["dn"]))
    return F.aggregate(moves(closes), _state(up=_null(), dn=_null()), step, finish)


def rsi_wilder(closes: Column, period: int = 14) -> Column:
    """Wilder's RSI: seeded with the mean of the first ``period`` moves."""
    d = moves(closes)
    n = F.size(d)
    head = F.slice(d, 1, period)
    seed = _state(
        g=F.aggregate(head, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))) / period,
        l=F.aggregate(head, F.lit(0.0), lambda a, x: a + F.greatest(-x, F.lit(0.0))) / period,
    )

    def step(s: Column, x: Column) -> Column:
        return _state(
            g=(s["g"] * (period - 1) + F.greatest(x, F.lit(0.0))) / period,
            l=(s["l"] * (period - 1) + F.greatest(-x, F.lit(0.0))) / period,
        )

    finish = lambda s: F.when(s["l"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + s["g"] / s["l"]))
    rest = F.slice(d, period + 1, F.greatest(n - period, F.lit(0)))
    return F.when(n >= period, F.aggregate(rest, seed, step, finish))


def macd_latest(closes: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(line, signal, histogram) on the newest bar, all in one fold.

    The signal line is the exponential mean of the line, seeded with the mean of its first values.
    """
    kf, ks, kg = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)

    def ema_step(prev: Column, total: Column, n: Column, x: Column, period: int, k: float) -> Column:
        return F.when(n == period, (total + x) / period).when(n > period, x * k + prev * (1 - k))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        f = ema_step(s["f"], s["sum_f"], n, x, fast, kf)
        sl = ema_step(s["s"], s["sum_s"], n, x, slow, ks)
        line = f - sl
        m = F.when(line.isNotNull(), s["m"] + 1).otherwise(s["m"])
        g = F.when(line.isNull(), _null()).otherwise(ema_step(s["g"], s["sum_g"], m, line, signal, kg))
        return _state(
            n=n, sum_f=s["sum_f"] + x, sum_s=s["sum_s"] + x, f=f, s=sl,
            m=m, sum_g=s["sum_g"] + F.coalesce(line, F.lit(0.0)), g=g, line=line,
        )

    start = _state(n=_count(), sum_f=F.lit(0.0), sum_s=F.lit(0.0), f=_null(), s=_null(),
                   m=_count(), sum_g=F.lit(0.0), g=_null(), line=_null())
    finish = lambda s: _state(line=s["line"], signal=s["g"], histogram=s["line"] - s["g"])
    return F.aggregate(closes, start, step, finish)


def trend_latest(bars: Column, atr_period: int = 10, multiplier: float = 3.0) -> Column:
    """struct(atr, trend): the exponential true range and the ratcheted band trend (+1 or -1).

    ``bars`` is an ordered array of struct(h, l, c).
    """
    k = 2.0 / (atr_period + 1)

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        tr = F.when(s["c"].isNull(), x["h"] - x["l"]).otherwise(
            F.greatest(x["h"] - x["l"], F.abs(x["h"] - s["c"]), F.abs(x["l"] - s["c"])))
        atr = F.when(n == atr_period, (s["sum_tr"] + tr) / atr_period).when(n > atr_period, tr * k + s["atr"] * (1 - k))
        started = n > atr_period
        mid = (x["h"] + x["l"]) / 2
        top, bottom = mid + multiplier * atr, mid - multiplier * atr
        upper = F.when(started, F.when(s["upper"].isNull() | (top < s["upper"]) | (s["c"] > s["upper"]), top)
                       .otherwise(s["upper"]))
        lower = F.when(started, F.when(s["lower"].isNull() | (bottom > s["lower"]) | (s["c"] < s["lower"]), bottom)
                       .otherwise(s["lower"]))
        trend = F.when(started, F.when(x["c"] < lower, F.lit(-1)).when(x["c"] > upper, F.lit(1))
                       .otherwise(F.coalesce(s["trend"], F.lit(1))))
        return _state(n=n, c=x["c"], sum_tr=s["sum_tr"] + tr, atr=atr, upper=upper, lower=lower, trend=trend)

    start = _state(n=_count(), c=_null(), sum_tr=F.lit(0.0), atr=_null(), upper=_null(), lower=_null(),
                   trend=F.lit(None).cast("int"))
    return F.aggregate(bars, start, step, lambda s: _state(atr=s["atr"], trend=s["trend"]))


def adx_latest(bars: Column, period: int = 14) -> Column:
    """Wilder's directional index on the newest bar.

    The first value is the mean of the first ``period`` directional figures and stands on bar 2·period;
    the figure right after those is skipped, and smoothing goes on from the one behind it.
    """

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1                                     # number of moves seen, the first bar gives none
        known = s["c"].isNotNull()
        up, down = x["h"] - s["h"], s["l"] - x["l"]
        plus = F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))
        minus = F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0))
        tr = F.greatest(x["h"] - x["l"], F.abs(x["h"] - s["c"]), F.abs(x["l"] - s["c"]))

        def smooth(prev: Column, v: Column) -> Column:
            return F.when(i <= period, prev + v).otherwise(prev - prev / period + v)

        st, sp, sm = smooth(s["st"], tr), smooth(s["sp"], plus), smooth(s["sm"], minus)
        dp, dm = F.when(st != 0, sp / st * 100).otherwise(F.lit(0.0)), F.when(st != 0, sm / st * 100).otherwise(F.lit(0.0))
        both = dp + dm
        dx = F.when(both != 0, F.abs(dp - dm) / both * 100).otherwise(F.lit(0.0))
        j = i - period                                     # index of this directional figure, from 0
        sum_dx = F.when((j >= 0) & (j < period), s["sum_dx"] + dx).otherwise(s["sum_dx"])
        adx = (F.when(j < period, _null()).when(j == period, s["sum_dx"] / period)
               .otherwise((s["adx"] * (period - 1) + dx) / period))
        keep = lambda new, old: F.when(known, new).otherwise(old)
        return _state(i=keep(i, s["i"]), h=x["h"], l=x["l"], c=x["c"], st=keep(st, s["st"]), sp=keep(sp, s["sp"]),
                      sm=keep(sm, s["sm"]), sum_dx=keep(sum_dx, s["sum_dx"]), adx=keep(adx, s["adx"]))

    start = _state(i=_count(), h=_null(), l=_null(), c=_null(), st=F.lit(0.0), sp=F.lit(0.0), sm=F.lit(0.0),
                   sum_dx=F.lit(0.0), adx=_null())
    return F.aggregate(bars, start, step, lambda s: s["adx"])


# ---- values on every bar ---------------------------------------------------------------------

def _smoothed(x: np.ndarray, period: int, alpha: float) -> np.ndarray:
    """Exponential means of ``x``; the first stands at ``period`` values and is their plain mean."""
    out = np.full(len(x), np.nan)
    if len(x) >= period:
        seeded = np.append(x[:period].mean(), x[period:])
        out[period - 1:] = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean()
    return out


def _ema(x: np.ndarray, period: int) -> np.ndarray:
    return _smoothed(x, period, 2.0 / (period + 1))


def _share(part: np.ndarray, rest: np.ndarray, empty: float) -> np.ndarray:
    """``part`` in percent of ``part + rest``; ``empty`` where there is nothing to divide."""
    total = part + rest
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total == 0, empty, 100 * part / total)


def _wilder_rsi(x: np.ndarray, period: int = 14) -> np.ndarray:
    move = np.diff(x)
    gain, loss = (_smoothed(np.maximum(side, 0.0), period, 1 / period) for side in (move, -move))
    return np.append(np.nan, np.where(loss == 0, 100.0, _share(gain, loss, 100.0)))


def _on_defined(fn: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), np.nan)
    known = ~np.isnan(x)
    out[known] = fn(x[known])
    return out


def _true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.append(np.nan, c[:-1])
    return np.fmax(h, before) - np.fmin(l, before)


def _ratchet(level: np.ndarray, close: np.ndarray) -> np.ndarray:
    """A ceiling that only falls until a close breaks through it; the bar after a break starts a new one.

    Between two breaks it is a running minimum, so the work is one vector step per break.
    """
    out, start = level.copy(), 0
    while start < len(level):
        falling = np.minimum.accumulate(level[start:])
        broken = np.flatnonzero(close[start:] > falling)
        end = start + broken[0] + 1 if len(broken) else len(level)
        out[start:end] = falling[:end - start]
        start = end
    return out


def _band_trend(h, l, c, atr, period: int = 10, multiplier: float = 3.0) -> np.ndarray:
    """+1 or -1 from bar ``period`` on: the side of the last ratcheted band that a close went beyond, +1 at first."""
    out = np.full(len(c), np.nan)
    mid, width, close = (h + l)[period:] / 2, multiplier * atr[period:], c[period:]
    ceiling, floor = _ratchet(mid + width, close), -_ratchet(width - mid, -close)
    side = np.select([close < floor, close > ceiling], [-1.0, 1.0], np.nan)
    out[period:] = pd.Series(side).ffill().fillna(1.0)
    return out


def _adx(h, l, c, period: int = 14) -> np.ndarray:
    """Directional index, see ``adx_latest`` for its seed and the figure that is skipped."""
    out = np.full(len(c), np.nan)
    if len(c) <= 2 * period:
        return out
    rise, fall = np.diff(h), -np.diff(l)
    mean = lambda x: _smoothed(x, period, 1 / period)[period - 1:]
    span = mean(_true_range(h, l, c)[1:])
    up, down = mean(rise * (rise > np.maximum(fall, 0))), mean(fall * (fall > np.maximum(rise, 0)))
    figures = np.where(span == 0, 0.0, _share(np.maximum(up, down), np.minimum(up, down), 0.0)
                       - _share(np.minimum(up, down), np.maximum(up, down), 0.0))
    out[2 * period:] = _smoothed(np.delete(figures, period), period, 1 / period)[period - 1:]
    return out


SERIES_FIELDS = ["ema21", "ema50", "rsi14", "macd_line", "macd_signal", "macd_hist", "atr14", "adx14", "supertrend",
                 "stoch_d"]


def indicator_series(bars: DataFrame) -> DataFrame:
    """Every recursive indicator on every bar; a group is one symbol's daily bars."""

    def per_symbol(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        h, l, c = (pdf[f].to_numpy(float) for f in ("h", "l", "c"))
        line = _ema(c, 12) - _ema(c, 26)
        signal = _on_defined(lambda x: _ema(x, 9), line)
        tr = _true_range(h, l, c)
        lo, hi = pdf["l"].rolling(14).min().to_numpy(), pdf["h"].rolling(14).max().to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            stoch = np.where(hi == lo, 50.0, (c - lo) / (hi - lo) * 100)
        columns = dict(
            ema21=_ema(c, 21), ema50=_ema(c, 50), rsi14=_wilder_rsi(c), macd_line=line, macd_signal=signal,
            macd_hist=line - signal, atr14=_ema(tr, 14), adx14=_adx(h, l, c),
            supertrend=_band_trend(h, l, c, _ema(tr, 10)), stoch_d=_on_defined(lambda x: _ema(x, 3), stoch),
        )
        out = pdf[["symbol", "date"]].copy()
        for name, values in columns.items():
            out[name] = pd.array(values, dtype="Float64")
            out[name] = out[name].mask(np.isnan(values))
        return out

    schema = "symbol string, date date, " + ", ".join(f"{f} double" for f in SERIES_FIELDS)
    return bars.select("symbol", "date", "h", "l", "c").groupBy("symbol").applyInPandas(per_symbol, schema)
