"""One-shot alerts by level: a batch's ticks are cut down to the records of their running maxima and minima, and an alert looks up the
first record at or beyond its level. Work grows with ticks plus alerts, never with their product.

Alerts are a stream too: a row arms an alert, and the state holds the armed ones until they fire. A symbol's alerts are dealt over
shares by their id, so a symbol with a third of all alerts is no single task; each share gets the symbol's records. Shares of all
symbols are dealt over ``GROUPS`` state groups, so a symbol costs no group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPREAD = 16
GROUPS = 512
#: (metric, condition) of alerts with a level, and the sign under which "at or beyond" means "at least".
LEVELS = {("price", "above"): 1.0, ("price", "below"): -1.0, ("rsi", "above"): 1.0, ("rsi", "below"): -1.0}
COLUMN = {"price": "ltp", "rsi": "rsi"}
RECORD = "symbol string, ts timestamp, tick_id long, ltp double, rsi double, signal string"
FIRED = "alert_id string, symbol string, metric string, value string, tick_id long, ts timestamp, ltp double"
STATE = "symbol array<string>, alert_id array<string>, metric array<string>, condition array<string>, value array<string>"


def _records(rows: pd.DataFrame) -> np.ndarray:
    """Which of the rows (sorted by symbol and order) can be the first at or beyond any level, or the first with their signal."""
    of = rows["symbol"]
    keep = (rows["signal"].notna() & ~rows.duplicated(["symbol", "signal"])).to_numpy()
    for column in COLUMN.values():
        for sign in (1.0, -1.0):
            value = sign * rows[column].to_numpy(float)
            seen = pd.Series(np.where(np.isnan(value), -np.inf, value), rows.index).groupby(of).cummax()
            before = seen.groupby(of).shift(1).fillna(-np.inf)
            keep |= (value > before.to_numpy())
    return keep


def records_in_part(ticks: DataFrame) -> DataFrame:
    """The records of each batch of rows, before any shuffle. ``ticks``: symbol, ts, tick_id, ltp, rsi, signal."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows = rows.dropna(subset=["symbol", "ts"]).sort_values(["symbol", "ts", "tick_id"], kind="stable", ignore_index=True)
            yield rows[_records(rows)]

    return ticks.select("symbol", "ts", F.col("tick_id").cast("long"), F.col("ltp").cast("double"), F.col("rsi").cast("double"),
                        "signal").mapInPandas(run, RECORD)


def first_hits(armed: pd.DataFrame, ticks: pd.DataFrame) -> np.ndarray:
    """For each armed alert the place of the first tick of its symbol that fires it, or -1. ``ticks`` are sorted by symbol and order."""
    hit = np.full(len(armed), -1)
    level = pd.to_numeric(armed["value"], errors="coerce").to_numpy(float)
    kind = np.full(len(armed), -1)
    for n, (metric, condition) in enumerate(LEVELS):
        kind[((armed["metric"] == metric) & (armed["condition"] == condition)).to_numpy() & ~np.isnan(level)] = n
    kind[(armed["metric"] == "signal").to_numpy()] = len(LEVELS)
    wanted, said = armed["value"].to_numpy(object), ticks["signal"].to_numpy(object)
    values = [(COLUMN[metric], sign) for (metric, _), sign in LEVELS.items()]
    columns = {c: ticks[c].to_numpy(float) for c in COLUMN.values()}
    of = ticks["symbol"].to_numpy(object)
    starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
    places = {of[lo]: (lo, hi) for lo, hi in zip(starts, starts[1:])}
    for symbol, mine in armed.groupby("symbol").indices.items():
        if symbol not in places:
            continue
        lo, hi = places[symbol]
        for n in np.unique(kind[mine]):
            some = mine[kind[mine] == n]
            if n == len(LEVELS):
                first: dict[str, int] = {}
                for i in range(lo, hi):
                    if isinstance(said[i], str):
                        first.setdefault(said[i], i)
                for i in some:
                    w = wanted[i]
                    hit[i] = min((at for x, at in first.items() if x == w or (w in ("BUY", "SELL") and w in x)), default=-1)
            elif n >= 0:
                column, sign = values[n]
                value = sign * columns[column][lo:hi]
                highest = np.maximum.accumulate(np.where(np.isnan(value), -np.inf, value))
                at = np.searchsorted(highest, sign * level[some], side="left")
                hit[some] = np.where(at < hi - lo, lo + at, -1)
    return hit


def level_alerts(ticks: DataFrame, alerts: DataFrame, spread: int = SPREAD, shares: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """The alerts that fire, each with the tick that fired it.

    ``alerts``: alert_id, symbol, metric (price, rsi, signal), condition (above, below) and value (a level, or a signal family); a row
    arms its alert from its batch on, and once more if it comes again after firing. A level that is no number never fires.
    ``shares`` (symbol, shares) names the symbols with many alerts, a small table; the others have one share then. Without it every
    symbol has ``spread``. Shares and groups have to stay as they are as long as a checkpoint is used.
    """
    none = lambda t: F.lit(None).cast(t)

    def dealt(rows: DataFrame) -> DataFrame:
        if shares is None:
            return rows.withColumn("shares", F.lit(spread))
        return rows.join(F.broadcast(shares.select("symbol", F.col("shares").cast("int"))), "symbol", "left").fillna(1, ["shares"])

    slot = F.pmod(F.xxhash64("symbol", "share"), F.lit(groups))
    armed = dealt(alerts.filter((F.col("metric") == "signal") | F.col("value").try_cast("double").isNotNull())).select(
        "symbol", F.pmod(F.xxhash64("alert_id"), F.col("shares")).cast("int").alias("share"), "alert_id", "metric", "condition", "value",
        none("timestamp").alias("ts"), none("long").alias("tick_id"), none("double").alias("ltp"), none("double").alias("rsi"), none("string").alias("signal"))
    told = dealt(records_in_part(ticks)).select(
        "symbol", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *[none("string").alias(c) for c in (
            "alert_id", "metric", "condition", "value")], "ts", "tick_id", "ltp", "rsi", "signal")
    names = ["symbol", "alert_id", "metric", "condition", "value"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        new = rows[rows["alert_id"].notna()][names]
        if held.exists:
            new = pd.concat([pd.DataFrame(dict(zip(names, map(list, held.get))), dtype=object), new], ignore_index=True)
        new = new[new["symbol"].notna()].drop_duplicates(["symbol", "alert_id"], keep="last").reset_index(drop=True)
        ticks_ = rows[rows["alert_id"].isna()].sort_values(["symbol", "ts", "tick_id"], kind="stable", ignore_index=True)
        hit = first_hits(new, ticks_) if len(ticks_) and len(new) else np.full(len(new), -1)
        left = new[hit < 0]
        if len(left):
            held.update(tuple(left[c].tolist() for c in names))
        elif held.exists:
            held.remove()
        done = new[hit >= 0]
        by = ticks_.iloc[hit[hit >= 0]]
        yield pd.DataFrame({"alert_id": done["alert_id"].tolist(), "symbol": done["symbol"].tolist(), "metric": done["metric"].tolist(), "value": done["value"].tolist(),
                            "tick_id": by["tick_id"].astype("int64").tolist(), "ts": by["ts"].tolist(), "ltp": by["ltp"].tolist()})

    return armed.unionByName(told).withColumn("slot", slot).groupBy("slot").applyInPandasWithState(step, FIRED, STATE, "append", GroupStateTimeout.NoTimeout)
