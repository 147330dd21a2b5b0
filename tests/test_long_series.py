"""Indicators over long series in blocks against the fold over the whole series, for blocks of every size."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import blocked, folds


@pytest.mark.parametrize("minutes", [7, 60, 100000])
def test_blocks_equal_the_fold(spark, minutes):
    r = random.Random(3)
    rows, start = [], dt.datetime(2024, 1, 1)
    for s, n in (("A", 90), ("B", 29), ("C", 28), ("D", 5), ("E", 1)):
        price = 50.0
        for i in range(n):
            price *= 1 + (0 if s == "B" and i < 20 else r.gauss(0, 0.02))
            rows.append((s, start + dt.timedelta(days=i), start + dt.timedelta(minutes=i), price * 1.01, price * 0.99, price))
    bars = spark.createDataFrame(rows, "symbol string, date timestamp, ts timestamp, h double, l double, c double")
    got = {(x.symbol, x.ts): x for x in blocked.long_indicators(bars, minutes * 60).collect()}
    want = folds.indicator_series(bars.withColumn("date", F.to_date("date"))).collect()
    assert len(got) == len(want) == len(rows)
    at = {(s, d.date()): t for s, d, t, *_ in rows}
    for w in want:
        g = got[w.symbol, at[w.symbol, w.date]]
        for f in blocked.LONG_FIELDS:
            assert (g[f] is None and w[f] is None) or abs(g[f] - w[f]) < 1e-8, (w.symbol, w.date, f)
    most = bars.groupBy("symbol", blocked.block_of(F.col("ts"), minutes * 60)).count().agg(F.max("count")).first()[0]
    assert most <= minutes


def test_maps_compose_to_the_whole():
    r = np.random.default_rng(2)
    x = r.normal(size=60)
    for cuts in ([0, 60], [0, 1, 5, 14, 15, 40, 60], list(range(61))):
        total, mean = 0.0, np.nan
        for a, b in zip(cuts, cuts[1:]):
            p, q, add, s = blocked.block_map(x[a:b], a, 14, 0.1)
            mean = p * total + (q * mean if q else 0.0) + add if b >= 14 else np.nan
            total += s
        assert mean == pytest.approx(folds._smoothed(x, 14, 0.1)[-1])
