"""Streams that keep state per symbol: the live screener and indicators that go on from their last values.

Both take a stream of rows and give a stream of rows; the state is Spark's, so it is restored from the checkpoint after a restart, and
a batch that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from barloom.functions import carried
from barloom.functions.folds import SERIES_FIELDS
from barloom.operators import screen

# ---- live screener ---------------------------------------------------------------------------------------------

#: What a quote says; the two of the last 52 weeks are kept from the last quote that had them.
QUOTE = ["ltp", "open", "high", "low", "volume", "prev_close", "given_pct", "net_change", "high52", "low52"]
QUOTED_RANGE = ["high52", "low52"]


def newest_in_part(ticks: DataFrame) -> DataFrame:
    """One row per symbol and batch of rows, before any shuffle: its newest tick, and the last known quoted range with its time.

    ``ticks``: symbol, ts, tick_id (order inside one time) and QUOTE. A symbol with a third of all ticks sends a few rows only.
    """
    times = [f"{c}_{x}" for c in QUOTED_RANGE for x in ("ts", "id")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows = rows.dropna(subset=["symbol", "ts"]).sort_values(["ts", "tick_id"], kind="stable")
            out = rows.groupby("symbol", as_index=False).tail(1).set_index("symbol")
            for c in QUOTED_RANGE:
                known = rows[rows[c].notna()].groupby("symbol").tail(1).set_index("symbol")
                out[f"kept_{c}"], out[f"{c}_ts"], out[f"{c}_id"] = known[c], known["ts"], known["tick_id"].astype("Int64")
            yield out.reset_index()[["symbol", "ts", "tick_id", *QUOTE, *[f"kept_{c}" for c in QUOTED_RANGE], *times]]

    fields = [*[f"{c} double" for c in QUOTE], *[f"kept_{c} double" for c in QUOTED_RANGE],
              *[f"{c}_{x} {t}" for c in QUOTED_RANGE for x, t in (("ts", "timestamp"), ("id", "long"))]]
    rows = ticks.select("symbol", "ts", F.col("tick_id").cast("long"), *[F.col(c).cast("double") for c in QUOTE])
    return rows.mapInPandas(run, f"symbol string, ts timestamp, tick_id long, {', '.join(fields)}")


def live_screener(ticks: DataFrame, universe: DataFrame, signals: DataFrame, fundamentals: DataFrame, late: str = "1 day",
                  expiry: timedelta = timedelta(days=30)) -> DataFrame:
    """A row of the screener table whenever a listed symbol's state changes, and one with ``gone`` when it expires.

    The tables are joined anew in every batch (stream-static): ``universe`` (symbol and listing facts; unknown tickers are dropped),
    ``signals`` (symbol, signalScore, avgVolume, week52High, week52Low and more) and ``fundamentals`` (symbol, fundamentalScore).
    The state of a symbol is its newest quote, the last quoted 52-week range and the last known signal columns, which stay where the
    table has none any more. Late and repeated ticks change nothing that is newer; ticks later than ``late`` are dropped, and a symbol
    without ticks for ``expiry`` of event time leaves state and table.
    """
    facts = universe.join(fundamentals, "symbol", "left").join(signals, "symbol", "left")
    of_signal = [f for f in signals.schema if f.name != "symbol"]
    listed = [f for f in universe.schema if f.name != "symbol"]
    live = newest_in_part(ticks).withWatermark("ts", late).join(facts, "symbol")
    kept = [f"kept_{c}" for c in QUOTED_RANGE]
    numbers = [*QUOTE, *kept]
    state = StructType([
        StructField("ts", TimestampType()), StructField("tick_id", LongType()), *[StructField(c, DoubleType()) for c in numbers],
        *[StructField(f"{c}_{x}", t) for c in QUOTED_RANGE for x, t in (("ts", TimestampType()), ("id", LongType()))], *of_signal])
    out = StructType([
        StructField("symbol", StringType()), StructField("gone", BooleanType()), StructField("ts", TimestampType()), *listed,
        StructField("fundamentalScore", DoubleType()), *[StructField(c, DoubleType()) for c in numbers], *of_signal])
    names, of = state.fieldNames(), {n: i for i, n in enumerate(state.fieldNames())}

    def plain(v):
        """Values as the state stores them: pandas' missing values are None."""
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return None
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if isinstance(v, np.generic) else v

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([{"symbol": key[0], "gone": True}]).reindex(columns=out.fieldNames())
            return
        now = list(held.get) if held.exists else [None] * len(names)
        row = None
        for frame in frames:
            for row in frame.to_dict("records"):
                row = {k: plain(v) for k, v in row.items()}
                if now[0] is None or (row["ts"], row["tick_id"] or 0) >= (now[0], now[1] or 0):
                    for c in ("ts", "tick_id", *QUOTE):
                        now[of[c]] = row[c]
                for c in QUOTED_RANGE:
                    at, held_at = (row[f"{c}_ts"], row[f"{c}_id"] or 0), (now[of[f"{c}_ts"]], now[of[f"{c}_id"]] or 0)
                    if at[0] is not None and (held_at[0] is None or at >= held_at):
                        now[of[f"kept_{c}"]], now[of[f"{c}_ts"]], now[of[f"{c}_id"]] = row[f"kept_{c}"], *at
        if row is None:
            return
        if row["signalScore"] is not None:
            for f in of_signal:
                now[of[f.name]] = row[f.name]
        until = int((now[0] + expiry).timestamp() * 1000)
        gone = until <= held.getCurrentWatermarkMs()
        if gone:
            if held.exists:
                held.remove()
        else:
            held.update(tuple(now))
            held.setTimeoutTimestamp(until)
        known = {**{f.name: row[f.name] for f in listed}, **dict(zip(names, now))}
        yield pd.DataFrame([{**known, "symbol": key[0], "gone": gone, "fundamentalScore": row["fundamentalScore"]}]).reindex(columns=out.fieldNames())

    changed = live.groupBy("symbol").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.EventTimeTimeout)
    return changed.withColumns({
        "changePct": screen.change_percent(F.col("given_pct"), F.col("net_change"), F.col("ltp"), F.col("prev_close")),
        "relVol": screen.relative_volume(F.col("volume"), F.col("avgVolume")),
        "week52High": F.coalesce("high52", "week52High", "kept_high52"), "week52Low": F.coalesce("low52", "week52Low", "kept_low52"),
    }).drop("given_pct", "net_change", "prev_close", *kept, *QUOTED_RANGE)


def newest_rows(saved: DataFrame, key: str = "symbol") -> DataFrame:
    """The table that the saved batches (``batch_id``) add up to: the newest row per key, without those that are gone."""
    row = F.struct(*[c for c in saved.columns if c not in (key, "batch_id")])
    return saved.groupBy(key).agg(F.max_by(row, "batch_id").alias("r")).select(key, "r.*").filter("not gone").drop("gone")


# ---- indicators ---------------------------------------------------------------------------------------------------

def carried_indicators(bars: DataFrame) -> DataFrame:
    """Every recursive indicator on every new daily bar, from the state that the bars before it left; no history is read.

    ``bars``: symbol, date, h, l, c, load_ts. Of bars of one date in a batch the newest load counts. A bar that is not behind the
    symbol's last one cannot be folded in; it comes out with ``late`` and without values, for a refold of that symbol.
    """
    schema = "symbol string, date date, late boolean, " + ", ".join(f"{f} double" for f in SERIES_FIELDS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["date", "load_ts"], kind="stable").drop_duplicates("date", keep="last")
        state, last = carried.State(), None
        if held.exists:
            last, numbers = held.get
            state = carried.State.of(list(numbers))
        late = rows["date"] <= last if last is not None else pd.Series(False, rows.index)
        new = rows[~late]
        out = pd.DataFrame({"symbol": key[0], "date": [*rows[late]["date"], *new["date"]], "late": [True] * int(late.sum()) + [False] * len(new)})
        values = carried.advance(state, *[new[f].to_numpy(float) for f in "hlc"]) if len(new) else {f: [] for f in SERIES_FIELDS}
        for f in SERIES_FIELDS:
            filled = np.append(np.full(int(late.sum()), np.nan), values[f])
            out[f] = pd.array(filled, dtype="Float64")
            out[f] = out[f].mask(np.isnan(filled))
        if len(new):
            held.update((new["date"].iloc[-1], state.numbers()))
        yield out

    return bars.select("symbol", "date", "h", "l", "c", "load_ts").groupBy("symbol").applyInPandasWithState(
        step, schema, "last date, numbers array<double>", "append", GroupStateTimeout.NoTimeout)
