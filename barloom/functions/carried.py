"""Recursive indicators that go on from a stored state: new bars advance it, old ones are not read again.

The state of a symbol is a flat list of numbers (``State``): counters and values of the exponential means, the last bar, the last 13 highs
and lows, the ratcheted bands and the directional sums. ``advance`` takes the bars behind it, in order, and gives every field of
``folds.SERIES_FIELDS`` on each of them; fed in any number of parts the values are those of ``folds.indicator_series`` over all bars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from barloom.functions.folds import SERIES_FIELDS

#: (name, period, alpha) of the exponential means; each starts as the plain mean of its first ``period`` values.
MEANS = {
    "ema12": (12, 2 / 13), "ema21": (21, 2 / 22), "ema26": (26, 2 / 27), "ema50": (50, 2 / 51), "signal": (9, 2 / 10), "gain": (14, 1 / 14),
    "loss": (14, 1 / 14), "atr10": (10, 2 / 11), "atr14": (14, 2 / 15), "span": (14, 1 / 14), "up": (14, 1 / 14), "down": (14, 1 / 14),
    "adx": (14, 1 / 14), "stoch_d": (3, 2 / 4),
}
WINDOW = 13                                                   # bars before the newest in the stochastic's range
BAND_START, BAND_WIDTH = 10, 3.0
SKIPPED = 14                                                  # the directional figure that is left out, counted from 0


def smoothed_on(held: list[float], x: np.ndarray, period: int, alpha: float) -> tuple[np.ndarray, list[float]]:
    """(means on each of the next values ``x``, what is held after them); held = [values seen, their sum before the first mean, the mean]."""
    seen, total, value = held
    out = np.full(len(x), np.nan)
    head = min(len(x), max(0, period - int(seen)))
    total += x[:head].sum()
    if head and seen + head == period:
        value = out[head - 1] = total / period
    if seen + len(x) > period and head < len(x):
        out[head:] = pd.Series(np.append(value, x[head:])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        value = out[-1]
    return out, [seen + len(x), total, value]


@dataclass
class State:
    """``means``: name -> [values seen, their sum, the mean]; nan where nothing is known."""

    bars: int = 0
    last: list[float] = field(default_factory=lambda: [np.nan] * 3)                     # high, low, close
    means: dict[str, list[float]] = field(default_factory=lambda: {k: [0.0, 0.0, np.nan] for k in MEANS})
    band: list[float] = field(default_factory=lambda: [np.nan, np.nan, 1.0])            # ceiling, floor, trend
    figures: int = 0
    highs: list[float] = field(default_factory=list)
    lows: list[float] = field(default_factory=list)

    def numbers(self) -> list[float]:
        return [float(x) for x in (self.bars, *self.last, *[x for k in MEANS for x in self.means[k]], *self.band, self.figures,
                                   *self.highs, *self.lows)]

    @classmethod
    def of(cls, numbers: list[float]) -> State:
        it = iter(numbers)
        take = lambda n: [next(it) for _ in range(n)]
        out = cls(int(next(it)), take(3), {k: take(3) for k in MEANS}, take(3), int(next(it)))
        rest = list(it)
        out.highs, out.lows = rest[:len(rest) // 2], rest[len(rest) // 2:]
        return out

    def mean(self, name: str, x: np.ndarray) -> np.ndarray:
        """The exponential means on each of the next values ``x``."""
        out, self.means[name] = smoothed_on(self.means[name], x, *MEANS[name])
        return out

    def mean_of_known(self, name: str, x: np.ndarray) -> np.ndarray:
        out, known = np.full(len(x), np.nan), ~np.isnan(x)
        out[known] = self.mean(name, x[known])
        return out


def _percent(part: np.ndarray, whole: np.ndarray, empty: float) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(whole == 0, empty, 100 * part / whole)


def _bands(s: State, mid: np.ndarray, width: np.ndarray, close: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The trend on each bar; a ceiling only falls and a floor only rises until the close before it broke through."""
    ceiling, floor, trend = s.band
    out = np.empty(len(mid))
    for i, (m, w, c, b) in enumerate(zip(mid.tolist(), width.tolist(), close.tolist(), before.tolist())):
        if not (ceiling <= m + w and b <= ceiling):
            ceiling = m + w
        if not (floor >= m - w and b >= floor):
            floor = m - w
        trend = -1.0 if c < floor else 1.0 if c > ceiling else trend
        out[i] = trend
    s.band = [ceiling, floor, trend]
    return out


def advance(s: State, h: np.ndarray, l: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """The fields on the next bars; ``s`` is moved on."""
    n, first = len(c), s.bars == 0
    ph, pl, pc = (np.append(x, y[:-1]) for x, y in zip(s.last, (h, l, c)))
    tr = np.fmax(h, pc) - np.fmin(l, pc)
    move = (c - pc)[first:]
    pad = lambda x: np.append(np.nan, x) if first else x  # noqa: E731 the first bar has no move
    line = s.mean("ema12", c) - s.mean("ema26", c)
    signal = s.mean_of_known("signal", line)
    gain, loss = s.mean("gain", np.maximum(move, 0)), s.mean("loss", np.maximum(-move, 0))
    rsi = np.where(loss == 0, 100.0, _percent(gain, gain + loss, 100.0))
    rsi[np.isnan(gain)] = np.nan

    atr10 = s.mean("atr10", tr)
    on = np.arange(s.bars, s.bars + n) >= BAND_START
    trend = np.full(n, np.nan)
    trend[on] = _bands(s, ((h + l) / 2)[on], BAND_WIDTH * atr10[on], c[on], np.where(np.arange(s.bars, s.bars + n) == BAND_START, np.nan, pc)[on])

    rise, fall = (h - ph)[first:], (pl - l)[first:]
    span = s.mean("span", tr[first:])
    up, down = s.mean("up", rise * (rise > np.maximum(fall, 0))), s.mean("down", fall * (fall > np.maximum(rise, 0)))
    known = ~np.isnan(span)
    figures = np.where(span == 0, 0.0, _percent(np.abs(up - down), up + down, 0.0))[known]
    number = np.arange(s.figures, s.figures + len(figures))
    counted = number != SKIPPED
    smooth, before = np.full(len(figures), np.nan), s.means["adx"][2]
    smooth[counted] = s.mean("adx", figures[counted])
    skipped = np.flatnonzero(~counted)
    if len(skipped):
        smooth[skipped] = smooth[skipped[0] - 1] if skipped[0] else before
    smooth[number < SKIPPED] = np.nan
    s.figures += len(figures)
    adx = np.full(len(span), np.nan)
    adx[known] = smooth

    highs, lows = np.append(s.highs, h), np.append(s.lows, l)
    top, bottom = (getattr(pd.Series(x).rolling(WINDOW + 1), f)().to_numpy()[-n:] for x, f in ((highs, "max"), (lows, "min")))
    k = np.where(top == bottom, 50.0, _percent(c - bottom, top - bottom, 50.0))
    k[np.isnan(top)] = np.nan
    out = dict(
        ema21=s.mean("ema21", c), ema50=s.mean("ema50", c), rsi14=pad(rsi), macd_line=line, macd_signal=signal, macd_hist=line - signal,
        atr14=s.mean("atr14", tr), adx14=pad(adx), supertrend=trend, stoch_d=s.mean_of_known("stoch_d", k))
    s.bars += n
    s.last = [float(h[-1]), float(l[-1]), float(c[-1])]
    s.highs, s.lows = highs[-WINDOW:].tolist(), lows[-WINDOW:].tolist()
    assert list(out) == SERIES_FIELDS
    return out
