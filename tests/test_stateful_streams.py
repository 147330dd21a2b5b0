"""Streams with state over several micro-batches, with a restart between them, against plain versions over all rows seen."""

import datetime as dt
import random
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import carried, folds
from barloom.functions.event_rules import COMMON_ALIASES
from barloom.operators import dedup
from barloom.session import fresh_dir
from barloom.streaming import state, stories
from barloom.streaming.alerts import level_alerts
from barloom.streaming.feed import in_parts, save_batches


def test_carried_state_equals_the_full_fold():
    r = np.random.default_rng(1)
    for trial in range(20):
        n = int(r.integers(1, 160))
        c = np.full(n, 50.0) if trial % 7 == 0 else 100 * np.exp(np.cumsum(r.normal(0, 0.03, n)))
        wide = np.abs(r.normal(0, 0.01, (2, n))) * (trial % 7 != 0)
        h, l = c * (1 + wide[0]), c * (1 - wide[1])
        tr, line = folds._true_range(h, l, c), folds._ema(c, 12) - folds._ema(c, 26)
        lo, hi = pd.Series(l).rolling(14).min().to_numpy(), pd.Series(h).rolling(14).max().to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            stoch = np.where(hi == lo, 50.0, (c - lo) / (hi - lo) * 100)
        signal = folds._on_defined(lambda x: folds._ema(x, 9), line)
        want = dict(
            ema21=folds._ema(c, 21), ema50=folds._ema(c, 50), rsi14=folds._wilder_rsi(c), macd_line=line, macd_signal=signal,
            macd_hist=line - signal, atr14=folds._ema(tr, 14), adx14=folds._adx(h, l, c), supertrend=folds._band_trend(h, l, c, folds._ema(tr, 10)),
            stoch_d=folds._on_defined(lambda x: folds._ema(x, 3), stoch))
        s, got, at = carried.State(), [], 0
        while at < n:
            k = 1 if trial % 2 else int(r.integers(1, 40))
            got.append(carried.advance(s, h[at:at + k], l[at:at + k], c[at:at + k]))
            s, at = carried.State.of(s.numbers()), at + k
        for f in folds.SERIES_FIELDS:
            assert np.allclose(np.concatenate([g[f] for g in got]), want[f], equal_nan=True, rtol=1e-9), (trial, f)


def test_carried_stream_reads_only_its_own_bars(spark):
    r = random.Random(4)
    rows, day0 = [], dt.date(2024, 1, 1)
    for s in ("A", "B", "C"):
        price = 100.0
        for i in range(60):
            price *= 1 + r.gauss(0, 0.02)
            rows.append((s, day0 + timedelta(days=i), price * 1.01, price * 0.99, price, 1))
    late = ("A", day0 + timedelta(days=5), 1.0, 1.0, 1.0, 2)                      # comes last: behind A's newest bar
    newer = [("B", day0 + timedelta(days=10), *[rows[70][k] for k in (2, 3, 4)], 2), ("B", day0 + timedelta(days=10), 9.0, 9.0, 9.0, 0)]
    schema = "symbol string, date date, h double, l double, c double, load_ts int"
    bars = spark.createDataFrame([*rows, late, *newer], schema)
    part = F.when(F.col("load_ts") == 2, F.when(F.col("symbol") == "A", 2).otherwise(0)).otherwise(F.least(F.floor(F.datediff("date", F.lit(day0)) / 25), F.lit(2)))
    out = fresh_dir(spark, "carried")
    in_parts(bars, part.cast("int"), 3, lambda x: state.carried_indicators(x).writeStream.outputMode("append").foreachBatch(save_batches(out)))
    saved = spark.read.parquet(out)
    assert [tuple(x) for x in saved.filter("late").select("symbol", "date", "ema21").collect()] == [("A", late[1], None)]
    got = {(x.symbol, x.date): x for x in saved.filter("not late").collect()}
    want = folds.indicator_series(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(want) == saved.count() - 1
    for w in want:
        for f in folds.SERIES_FIELDS:
            a, b = got[w.symbol, w.date][f], w[f]
            assert (a is None and b is None) or abs(a - b) < 1e-9


TICK = "symbol string, ts timestamp, tick_id long, ltp double, open double, high double, low double, volume double, prev_close double, " \
       "given_pct double, net_change double, high52 double, low52 double, part int"


def tick(symbol, hour, n, ltp, part, high52=None, low52=None, prev=10.0):
    return symbol, dt.datetime(2024, 3, 1) + timedelta(hours=hour), n, ltp, ltp, ltp, ltp, 40.0, prev, None, None, high52, low52, part


def test_live_screener(spark):
    """Late, repeated and dropped ticks, a kept range, kept signals, an unknown ticker, and a symbol that expires and comes back."""
    ticks = [
        tick("A", 1, 1, 11.0, 0, high52=30.0), tick("A", 2, 2, 12.0, 0), tick("B", 1, 3, 5.0, 0, low52=1.0), tick("X", 1, 4, 5.0, 0), tick("C", 1, 5, 7.0, 0, high52=70.0),
        tick("A", 30, 6, 13.0, 1), tick("A", 30, 6, 13.0, 1), tick("A", 29, 7, 99.0, 1, low52=2.0), tick("B", 30, 8, 6.0, 1), tick("D", 30, 9, 8.0, 1),
        tick("A", 200, 10, 14.0, 2), tick("B", 30, 8, 6.0, 2), tick("D", 3, 11, 1.0, 2),                       # the last two come too late
        tick("A", 210, 12, 15.0, 3), tick("C", 205, 13, 9.0, 3),
    ]
    universe = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Gamma"), ("D", "Delta")], "symbol string, name string")
    scores = spark.createDataFrame([("A", 60.0)], "symbol string, fundamentalScore double")
    signals = spark.createDataFrame([("A", 55.0, "STRONG BUY", 20.0, 25.0, 5.0)],
                                    "symbol string, signalScore double, signal string, avgVolume double, week52High double, week52Low double")
    none = signals.withColumn("signalScore", F.lit(None).cast("double")).withColumn("signal", F.lit(None).cast("string"))
    out, started = fresh_dir(spark, "live"), []

    def start(rows):
        now = signals if len(started) < 2 else none                              # the table loses A's signal; the state keeps it
        started.append(1)
        live = state.live_screener(rows.drop("part"), universe, now, scores, "12 hours", timedelta(hours=100))
        return live.writeStream.outputMode("update").foreachBatch(save_batches(out))

    in_parts(spark.createDataFrame(ticks, TICK), F.col("part"), 4, start)
    saved = spark.read.parquet(out)
    assert saved.select("batch_id").distinct().count() >= 4
    rows = {r.symbol: r for r in state.newest_rows(saved).collect()}
    assert sorted(rows) == ["A", "C"]                                           # B and D had no tick for 100 hours, X is not listed
    assert {r.symbol for r in saved.filter("gone").collect()} == {"B", "C", "D"}
    a, c = rows["A"], rows["C"]
    assert (a.ltp, a.name, a.signalScore, a.signal, a.fundamentalScore, a.relVol) == (15.0, "Alpha", 55.0, "STRONG BUY", 60.0, 2.0)
    assert (a.week52High, a.week52Low, a.changePct) == (25.0, 5.0, 50.0)          # the table's range stands before a kept one
    assert (c.ltp, c.week52High, c.signalScore, c.relVol) == (9.0, None, None, None)     # C came back without its old state
    first = {r.symbol: r for r in state.newest_rows(saved.filter("batch_id = 0")).collect()}
    assert first["C"].week52High == 70.0 and first["B"].week52Low == 1.0 and first["A"].ltp == 12.0


def test_rolling_stories_equal_all_items_after_each_batch(spark):
    """Chains longer than a day, merges of stored stories by a late item, equal titles, repeated deliveries and items without a source."""
    t0 = dt.datetime(2024, 5, 1)
    heads = ["Acme wins port contract worth Rs 500 crore", "Acme wins the port contract worth Rs 500 crore today", "Borealis profit falls 12% in quarter",
             "Cobalt Mines signs copper supply deal", "Cobalt Mines signs a copper supply deal with rail firm"]
    rows = []
    for i in range(24):                                                          # a story every 20 hours: one chain over 19 days
        rows.append((100 + i, heads[i % 2], ("Reuters", "Mint", None, "")[i % 4], t0 + timedelta(hours=20 * i), 0 if i < 8 else 1 if i < 16 else 2))
    for i, (hour, part) in enumerate([(0, 0), (60, 0), (30, 1), (45, 1), (15, 2)]):   # gaps that later items close
        rows.append((10 + i, heads[2], "Mint", t0 + timedelta(hours=hour), part))
    rows += [(50, heads[3], "Mint", t0, 0), (49, heads[4], "Reuters", t0 + timedelta(hours=10), 1), (60, heads[3], "Mint", t0 + timedelta(hours=300), 2),
             (50, heads[3], "Mint", t0, 2), (103, heads[1], "", t0 + timedelta(hours=60), 2)]
    items = spark.createDataFrame(rows, "item_id long, title string, source string, ts timestamp, part int")
    aliases = spark.createDataFrame([("acme", "ACME"), ("cobalt mines", "COB"), *COMMON_ALIASES.items()], "alias string, symbol string")
    titles = items.dropDuplicates(["item_id"]).groupBy(F.col("title").alias("key")).agg(F.count("*").alias("n"))
    corpus = dedup.corpus_of(titles)
    out, seen = fresh_dir(spark, "stories"), []
    step = stories.rolling_stories(out, aliases, corpus)

    def checked(batch, batch_id):
        step(batch, batch_id)
        step(batch, batch_id)                                                    # a batch that runs again replaces itself
        seen.append(batch.select("item_id").toPandas()["item_id"].tolist())
        so_far = sorted({x for ids in seen for x in ids})
        known = items.dropDuplicates(["item_id"]).filter(F.col("item_id").isin(so_far))
        aged = known.select("item_id", "title", "source", (F.unix_micros(F.lit(t0 + timedelta(days=40))) / 3.6e9 - F.unix_micros("ts") / 3.6e9).alias("hours_ago"))
        links = dedup.story_links(aged, aliases, corpus=corpus)
        assert {tuple(x) for x in stories.story_of_items(spark, out).collect()} == {tuple(x) for x in links.select("item_id", "story").collect()}
        want = dedup.representatives(aged, links)
        columns = ["story", "item_id", "copies", "related_sources"]
        assert sorted(map(repr, stories.live_stories(spark, out).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))

    in_parts(items, F.col("part"), 3, lambda x: x.drop("part").writeStream.foreachBatch(checked))
    assert len(seen) == 3
    retired = stories.read(spark, out, "stories").filter("not live").select("story").distinct().collect()
    assert {x.story for x in retired} >= {11}                                     # 11 was a story of its own until 13 joined it to 10


def test_level_alerts_by_brute_force(spark):
    """Nulls, NaN, bad levels, equal times, an alert armed twice and one symbol with most alerts, over three parts."""
    r = random.Random(9)
    num = lambda hi: r.choice([None, float("nan"), round(r.uniform(0, hi), 1), round(r.uniform(0, hi), 1)])
    t0, ticks, alerts = dt.datetime(2024, 6, 1), [], []
    for i in range(240):
        ticks.append((r.choice("AAAB"), t0 + timedelta(minutes=i // 3), i, num(100), num(100), r.choice([None, "STRONG BUY", "SELL", "NEUTRAL"]), i // 80))
    for i in range(90):
        metric = r.choice(["price", "rsi", "signal"])
        value = r.choice(["BUY", "SELL", "NEUTRAL", "gone"]) if metric == "signal" else r.choice(["soon", str(r.randint(0, 130)), str(r.randint(40, 60))])
        alerts.append((f"a{i}", r.choice("AAAAB"), metric, r.choice(["above", "below"]), value, i % 3))
    alerts.append(alerts[0])

    def fires(a, t):
        _, _, metric, condition, value, _ = a
        if metric == "signal":
            return t[5] is not None and (t[5] == value or (value in ("BUY", "SELL") and value in t[5]))
        seen = t[3] if metric == "price" else t[4]
        if seen is None or np.isnan(seen) or value == "soon":
            return False
        return seen >= float(value) if condition == "above" else seen <= float(value)

    want = {}
    for a in alerts:
        hit = next((t[2] for t in ticks if t[0] == a[1] and t[6] >= a[5] and fires(a, t)), None)
        if hit is not None:
            want[a[0]] = hit
    said = spark.createDataFrame(ticks, "symbol string, ts timestamp, tick_id long, ltp double, rsi double, signal string, part int")
    both = said.unionByName(spark.createDataFrame(alerts, "alert_id string, symbol string, metric string, condition string, value string, part int"),
                            allowMissingColumns=True)
    out = fresh_dir(spark, "fired")

    def start(rows):
        fired = level_alerts(rows.filter("alert_id is null"), rows.filter("alert_id is not null"), spread=3)
        return fired.writeStream.outputMode("append").foreachBatch(save_batches(out))

    in_parts(both.repartition(4), F.col("part"), 3, start)
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) > 30 and {x.alert_id: x.tick_id for x in got} == want
