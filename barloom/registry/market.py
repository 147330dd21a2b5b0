"""Verified queries on bars, windows, indicators and composite signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import bar_windows as b
from barloom.functions.folds import SERIES_FIELDS, indicator_series
from barloom.operators import features, scoring
from barloom.registry.core import query
from barloom.registry.snippets import ALL_FEATURES, BARS, MARKET, RSI_EXP, SECTORS, TICKS, UNIVERSE, r, rs
from barloom.session import fresh_dir
from barloom.sources import bars as bar_source, sinks
from barloom.sources.bindings import bars_daily, market_index, monthly_bars, stored_bars, sector_index, trade_ticks, universe


def rounded(*names: str, digits: int = 6) -> list:
    return [(F.round(F.col(n).cast("double"), digits) + F.lit(0.0)).alias(n) for n in names]


def day(name: str = "date"):
    return F.col(name).cast("string").alias(name)


# ---- bars --------------------------------------------------------------------------------------

@query("agg10_daily_bar_rollup", f"WITH {BARS} SELECT symbol, CAST(date AS VARCHAR) AS date, o, h, l, c, v FROM bars")
def daily_bars(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("symbol", day(), "o", "h", "l", "c", "v")


@query("src01_parse_bars", f"""WITH {TICKS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY k1, k2, k3, k4) AS n FROM ticks)
SELECT symbol, CAST(date AS VARCHAR) AS date, price AS o, price AS h, price AS l, price AS c, qty AS v FROM ranked WHERE n = 1""")
def parse_bars(spark, sf_dir):
    """Provider rows with text fields and repeated dates; the first row of a date is kept."""
    text = F.col("price").cast("string")
    raw = trade_ticks(spark, sf_dir).select(
        "symbol", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00+05:30")).alias("t"),
        text.alias("o"), text.alias("h"), text.alias("l"), text.alias("c"), F.col("qty").cast("string").alias("v"),
        F.col("seq").alias("arrival"))
    return bar_source.parse_bars(raw).select("symbol", day(), "o", "h", "l", "c", "v")


@query("src02_segment_fallback", f"""WITH {TICKS}, seg AS (
  SELECT part_id AS isin, flag AS segment, count(DISTINCT date) AS n FROM ticks WHERE flag IN ('R', 'A') GROUP BY 1, 2)
SELECT isin, segment, n AS bars FROM (
  SELECT *, row_number() OVER (PARTITION BY isin ORDER BY CASE segment WHEN 'R' THEN 1 ELSE 2 END) AS rk FROM seg)
WHERE rk = 1""")
def segment_fallback(spark, sf_dir):
    """Return flag stands in for the listing segment: R first, then A."""
    ticks = trade_ticks(spark, sf_dir).withColumns({"isin": F.col("part_id"), "segment": F.col("flag")})
    bars = bar_source.roll_up_ticks(ticks, ["isin", "segment", "date"])
    return bar_source.pick_segment(bars, ["R", "A"]).groupBy("isin", "segment").agg(F.count("*").alias("bars"))


@query("src03_history_upsert", f"""WITH {BARS}, stored AS (SELECT *, 1 AS load_ts FROM bars WHERE date <= DATE '2000-12-31'),
start AS (SELECT symbol, max(date) - 7 AS from_date FROM stored GROUP BY symbol),
fetched AS (SELECT b.symbol, date, o, h, l, c * 1.01 AS c, v, 2 AS load_ts FROM bars b JOIN start USING (symbol) WHERE date >= from_date),
both_ AS (SELECT * FROM stored UNION ALL SELECT * FROM fetched)
SELECT symbol, CAST(date AS VARCHAR) AS date, o, h, l, c, v, load_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY load_ts DESC) AS n FROM both_) WHERE n = 1""")
def history_upsert(spark, sf_dir):
    """History stored by month to the end of 2000, then a refetch from 7 days before each symbol's last bar; old months are not touched."""
    bars, path = stored_bars(spark, sf_dir), fresh_dir(spark, "history")
    sinks.write_bars(bars.filter("date <= '2000-12-31'").withColumn("load_ts", F.lit(1)), path)
    start = bar_source.refetch_from(sinks.read_bars(spark, path))
    fetched = bars.join(start, "symbol").filter("date >= from_date").drop("from_date") \
        .withColumns({"c": F.col("c") * 1.01, "load_ts": F.lit(2)})
    sinks.upsert_stored(fetched, path)
    return sinks.read_bars(spark, path).select("symbol", day(), "o", "h", "l", "c", "v", "load_ts")


@query("src04_panel", f"""WITH {BARS}, {MARKET}, kept AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) > 60),
spine AS (SELECT symbol, date FROM kept CROSS JOIN (SELECT date FROM market))
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(CAST(c AS FLOAT) AS DOUBLE) AS close,
  CAST(CAST(h AS FLOAT) AS DOUBLE) AS high, CAST(CAST(l AS FLOAT) AS DOUBLE) AS low, CAST(CAST(v AS FLOAT) AS DOUBLE) AS vol
FROM spine LEFT JOIN bars USING (symbol, date)""")
def panel(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    return bar_source.build_panel(bars, market_index(bars)).select(
        "symbol", day(), *[F.col(n).cast("double").alias(n) for n in ("close", "high", "low", "vol")])


@query("src04_index_fill", f"""WITH {BARS}, {UNIVERSE}, {SECTORS}, days AS (SELECT DISTINCT date FROM bars),
spine AS (SELECT sector AS index_name, date FROM (SELECT DISTINCT sector FROM sectors) CROSS JOIN days)
SELECT index_name, CAST(date AS VARCHAR) AS date, CAST(CAST(last_value(c IGNORE NULLS) OVER
  (PARTITION BY index_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS FLOAT) AS DOUBLE) AS close
FROM spine LEFT JOIN sectors ON sector = index_name AND sectors.date = spine.date""".replace(
    "SELECT index_name, CAST(date AS", "SELECT index_name, CAST(spine.date AS").replace("ORDER BY date ROWS", "ORDER BY spine.date ROWS"))
def index_fill(spark, sf_dir):
    bars = bars_daily(spark, sf_dir)
    index = sector_index(bars, universe(bars)).withColumnRenamed("sector", "index_name")
    filled = bar_source.fill_index(index, bars.select("date").distinct())
    return filled.select("index_name", day(), F.col("close").cast("float").cast("double").alias("close"))


@query("src20_bar_export", f"""WITH {BARS} SELECT symbol, CAST(date AS VARCHAR) AS date, o, h, l, c, v FROM bars
WHERE date BETWEEN DATE '2001-06-30' - 400 AND DATE '2001-06-30'""")
def bar_export(spark, sf_dir):
    """From bars stored by month: only the months of the range are read."""
    stored = sinks.read_bars(spark, monthly_bars(spark, sf_dir))
    return sinks.between(stored, *bar_source.export_range("2001-06-30", 400)).orderBy("symbol", "date").select(
        "symbol", day(), "o", "h", "l", "c", "v")


# ---- windows -------------------------------------------------------------------------------------

def per_bar(name: str, columns: list[str], digits: int = 6):
    """Registers a query that shows some scanner features on every bar."""
    sql = f"WITH {ALL_FEATURES} SELECT symbol, CAST(date AS VARCHAR) AS date, {rs(*columns, digits=digits)} FROM f3"

    @query(name, sql)
    def run(spark, sf_dir):
        several = any("mkt" in c or "sec" in c for c in columns)
        bars = stored_bars(spark, sf_dir) if several else bars_daily(spark, sf_dir)
        members = universe(bars)
        market = market_index(bars) if any("mkt" in c for c in columns) else None
        sector = None
        if any("sec" in c for c in columns):
            sector = sector_index(bars, members)
            bars = bars.join(members.select("symbol", "sector"), "symbol")
        return features.all_bar_features(bars, market, sector).select("symbol", day(), *rounded(*columns, digits=digits))


per_bar("win01_returns", ["ret_5d", "ret_10d", "ret_20d", "ret_60d", "ret_prev5d", "accel"])
per_bar("win02_relative_returns",
        ["rel_mkt_5d", "rel_mkt_10d", "rel_mkt_20d", "rel_sec_5d", "rel_sec_10d", "rel_sec_20d"])
per_bar("win03_volatility", ["sigma_daily", "vol_ann"])
per_bar("win04_relative_volume", ["rvol_5d", "rvol_1d"])
per_bar("win05_up_down_volume", ["updown_vol_ratio"])
per_bar("win06_traded_value", ["adv20_cr"])
per_bar("win07_range_percent", ["atr_pct"])
per_bar("win08_percent_of_high", ["pct_of_52w_high"])
per_bar("win09_above_average", ["above_20dma", "above_50dma"])
per_bar("win10_return_z", ["z_5d", "z_20d"])

WINDOW_EXTRA = f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("win11_volume_5_over_60", f"""WITH {BARS} SELECT symbol, CAST(date AS VARCHAR) AS date, round(
  avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) /
  nullif(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 0), 6) AS vol_ratio_5v60 FROM bars""")
def volume_ratio(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("symbol", "date", b.volume_5_over_60().alias("vol_ratio_5v60")) \
        .select("symbol", day(), *rounded("vol_ratio_5v60"))


@query("win12_streak", f"""{WINDOW_EXTRA}, s AS (
  SELECT symbol, n, CASE WHEN n >= 200 THEN sign(c - avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)) END AS side
  FROM x), m AS (SELECT symbol, max(n) AS last_n, arg_max(side, n) AS now FROM s GROUP BY symbol)
SELECT symbol, CAST(CASE WHEN now > 0 THEN last_n - coalesce((SELECT max(n) FROM s WHERE s.symbol = m.symbol AND coalesce(side, 0) <= 0), 0)
            WHEN now < 0 THEN -(last_n - coalesce((SELECT max(n) FROM s WHERE s.symbol = m.symbol AND coalesce(side, 0) >= 0), 0))
            ELSE 0 END AS BIGINT) AS streak FROM m""")
def streak(spark, sf_dir):
    return features.streak_vs_sma(bars_daily(spark, sf_dir))


DELIVERY = f"""{TICKS}, delivery AS (
  SELECT symbol, date, sum(CASE WHEN flag <> 'R' THEN qty END) AS deliv_qty, sum(qty) AS traded_qty,
         100 * sum(CASE WHEN flag <> 'R' THEN qty END) / sum(qty) AS deliv_pct FROM ticks GROUP BY 1, 2),
recent AS (SELECT * FROM delivery WHERE date IN (SELECT DISTINCT date FROM delivery ORDER BY date DESC LIMIT 25))"""


def delivery_days(spark, sf_dir) -> DataFrame:
    """Delivered quantity = what was not returned; null on days when all came back."""
    kept = F.sum(F.when(F.col("flag") != "R", F.col("qty")))
    return trade_ticks(spark, sf_dir).groupBy("symbol", "date").agg(
        kept.alias("deliv_qty"), F.sum("qty").alias("traded_qty"), (100 * kept / F.sum("qty")).alias("deliv_pct"))


@query("src08_recent_delivery", f"""WITH {DELIVERY} SELECT symbol, CAST(date AS VARCHAR) AS date,
  {rs('deliv_qty', 'traded_qty', 'deliv_pct')} FROM recent""")
def recent_delivery(spark, sf_dir):
    """From delivery rows stored by month: the newest months alone say where the newest 25 dates begin."""
    path = fresh_dir(spark, "delivery")
    sinks.write_bars(delivery_days(spark, sf_dir), path)
    return features.recent_stored_sessions(sinks.read_bars(spark, path)).select(
        "symbol", day(), *rounded("deliv_qty", "traded_qty", "deliv_pct"))


DELIVERY_TREND = f"""{DELIVERY}, p AS (SELECT symbol, deliv_pct, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn
  FROM recent WHERE deliv_pct IS NOT NULL),
q AS (SELECT symbol, deliv_qty, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM recent WHERE deliv_qty IS NOT NULL),
pa AS (SELECT symbol, count(*) AS n, avg(CASE WHEN rn <= 5 THEN deliv_pct END) AS a, avg(CASE WHEN rn > 5 THEN deliv_pct END) AS z FROM p GROUP BY 1),
qa AS (SELECT symbol, count(*) AS n, avg(CASE WHEN rn <= 5 THEN deliv_qty END) AS a, avg(CASE WHEN rn > 5 THEN deliv_qty END) AS z FROM q GROUP BY 1),
trend AS (SELECT s.symbol, CASE WHEN pa.n >= 8 THEN pa.a END AS deliv_pct_5d, CASE WHEN pa.n >= 8 THEN pa.z END AS deliv_pct_base,
  CASE WHEN pa.n >= 8 THEN pa.a - pa.z END AS deliv_pct_change, CASE WHEN pa.n >= 8 AND qa.n >= 10 THEN qa.a / nullif(qa.z, 0) END AS deliv_qty_ratio
FROM (SELECT DISTINCT symbol FROM recent) s LEFT JOIN pa USING (symbol) LEFT JOIN qa USING (symbol))"""


@query("win13_delivery_trend", f"""WITH {DELIVERY_TREND} SELECT symbol,
 {rs('deliv_pct_5d', 'deliv_pct_base', 'deliv_pct_change', 'deliv_qty_ratio')} FROM trend""")
def delivery_trend(spark, sf_dir):
    recent = features.recent_sessions(delivery_days(spark, sf_dir))
    return features.delivery_trend(recent).select(
        "symbol", *rounded("deliv_pct_5d", "deliv_pct_base", "deliv_pct_change", "deliv_qty_ratio"))


# ---- indicators without memory -------------------------------------------------------------------

@query("ind01_sma", f"""{WINDOW_EXTRA} SELECT symbol, CAST(date AS VARCHAR) AS date,
  {', '.join(f"round(CASE WHEN n >= {k} THEN avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS {k - 1} PRECEDING) END, 6) AS sma{k}" for k in (14, 50, 100, 200))}
  FROM x""")
def sma(spark, sf_dir):
    names = [f"sma{k}" for k in (14, 50, 100, 200)]
    return bars_daily(spark, sf_dir).select(
        "symbol", "date", *[b.full_average("c", int(n[3:])).alias(n) for n in names]).select("symbol", day(), *rounded(*names))


@query("ind06_bollinger", f"""{WINDOW_EXTRA}, y AS (
  SELECT symbol, date, CASE WHEN n >= 20 THEN avg(c) OVER w END AS mid, stddev_pop(c) OVER w AS sd FROM x
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
SELECT symbol, CAST(date AS VARCHAR) AS date, round(mid + 2 * sd, 5) AS upper, round(mid, 5) AS middle, round(mid - 2 * sd, 5) AS lower FROM y""")
def bollinger(spark, sf_dir):
    up, mid, low = b.bollinger()
    return bars_daily(spark, sf_dir).select("symbol", "date", up.alias("upper"), mid.alias("middle"), low.alias("lower")) \
        .select("symbol", day(), *rounded("upper", "middle", "lower", digits=5))


@query("ind07_vwap", f"""WITH {BARS} SELECT symbol, CAST(date AS VARCHAR) AS date, round(
  sum((h + l + c) / 3 * v) OVER w / nullif(sum(v) OVER w, 0), 5) AS vwap FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def vwap(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("symbol", "date", b.cumulative_vwap().alias("vwap")) \
        .select("symbol", day(), *rounded("vwap", digits=5))


@query("ind11_obv", f"""WITH {BARS}, d AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY date) AS change FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date, round(sum(coalesce(sign(change) * v, 0)) OVER
  (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 4) + CAST(0 AS DOUBLE) AS obv FROM d""")
def obv(spark, sf_dir):
    moved = bars_daily(spark, sf_dir).withColumn("change", F.col("c") - F.lag("c").over(b.series()))
    return moved.select("symbol", "date", b.on_balance_volume().alias("obv")).select(
        "symbol", day(), *rounded("obv", digits=4))


@query("ind12_stochastic_k", f"""{WINDOW_EXTRA}, y AS (SELECT symbol, date, n, c, min(l) OVER w AS lo, max(h) OVER w AS hi FROM x
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
SELECT symbol, CAST(date AS VARCHAR) AS date, round(CASE WHEN n >= 14 THEN CASE WHEN hi = lo THEN 50.0 ELSE (c - lo) / (hi - lo) * 100 END END, 6) AS k FROM y""")
def stochastic(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("symbol", "date", b.stochastic_k().alias("k")).select("symbol", day(), *rounded("k"))


@query("ind13_close_high_low_volume", f"WITH {BARS} SELECT symbol, CAST(date AS VARCHAR) AS date, c, h, l, v FROM bars")
def extractors(spark, sf_dir):
    return bars_daily(spark, sf_dir).select("symbol", day(), "c", "h", "l", "v")


# ---- recursive indicators --------------------------------------------------------------------------

RECURSIVE = f"""WITH RECURSIVE {BARS}, t AS MATERIALIZED (
  SELECT *, row_number() OVER w AS n, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
u AS MATERIALIZED (
  SELECT symbol, date, n, h, l, c, v, pc,
    CASE WHEN n = 1 THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr,
    CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0.0 END AS dmp,
    CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0.0 END AS dmm,
    greatest(c - pc, 0) AS gain, greatest(pc - c, 0) AS loss,
    avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 11 PRECEDING) AS a12,
    avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS a21,
    avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 25 PRECEDING) AS a26,
    avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS a50,
    CASE WHEN n >= 14 THEN CASE WHEN max(h) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) = min(l) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) THEN 50.0
      ELSE (c - min(l) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)) / (max(h) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) - min(l) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)) * 100 END END AS k
  FROM t),
u2 AS MATERIALIZED (
  SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS tr10,
    avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS tr14,
    avg(gain) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS g14,
    avg(loss) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS l14,
    avg(k) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) AS k3 FROM u),
first_pass AS (
  SELECT symbol, n, CAST(NULL AS DOUBLE) AS e12, CAST(NULL AS DOUBLE) AS e21, CAST(NULL AS DOUBLE) AS e26, CAST(NULL AS DOUBLE) AS e50,
    CAST(NULL AS DOUBLE) AS rg, CAST(NULL AS DOUBLE) AS rl, CAST(NULL AS DOUBLE) AS atr10, CAST(NULL AS DOUBLE) AS atr14,
    CAST(NULL AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS st, CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DOUBLE) AS sm,
    CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS lo, CAST(1 AS INT) AS trend
  FROM u2 WHERE n = 1
  UNION ALL
  SELECT symbol, n, e12, e21, e26, e50, rg, rl, atr10, atr14, sd, st, sp, sm, up, lo,
    CASE WHEN n > 10 THEN CASE WHEN c < lo THEN -1 WHEN c > up THEN 1 ELSE trend END ELSE trend END
  FROM (
    SELECT q.symbol, q.n, q.c, p.trend,
      CASE WHEN q.n = 12 THEN q.a12 WHEN q.n > 12 THEN q.c * (2.0::DOUBLE / 13) + p.e12 * (1 - 2.0::DOUBLE / 13) END AS e12,
      CASE WHEN q.n = 21 THEN q.a21 WHEN q.n > 21 THEN q.c * (2.0::DOUBLE / 22) + p.e21 * (1 - 2.0::DOUBLE / 22) END AS e21,
      CASE WHEN q.n = 26 THEN q.a26 WHEN q.n > 26 THEN q.c * (2.0::DOUBLE / 27) + p.e26 * (1 - 2.0::DOUBLE / 27) END AS e26,
      CASE WHEN q.n = 50 THEN q.a50 WHEN q.n > 50 THEN q.c * (2.0::DOUBLE / 51) + p.e50 * (1 - 2.0::DOUBLE / 51) END AS e50,
      CASE WHEN q.n = 15 THEN q.g14 WHEN q.n > 15 THEN (p.rg * 13 + q.gain) / 14 END AS rg,
      CASE WHEN q.n = 15 THEN q.l14 WHEN q.n > 15 THEN (p.rl * 13 + q.loss) / 14 END AS rl,
      CASE WHEN q.n = 10 THEN q.tr10 WHEN q.n > 10 THEN q.tr * (2.0::DOUBLE / 11) + p.atr10 * (1 - 2.0::DOUBLE / 11) END AS atr10,
      CASE WHEN q.n = 14 THEN q.tr14 WHEN q.n > 14 THEN q.tr * (2.0::DOUBLE / 15) + p.atr14 * (1 - 2.0::DOUBLE / 15) END AS atr14,
      CASE WHEN q.n = 16 THEN q.k3 WHEN q.n > 16 THEN q.k * 0.5::DOUBLE + p.sd * 0.5::DOUBLE END AS sd,
      CASE WHEN q.n <= 15 THEN coalesce(p.st, 0) + q.tr ELSE p.st - p.st / 14 + q.tr END AS st,
      CASE WHEN q.n <= 15 THEN coalesce(p.sp, 0) + q.dmp ELSE p.sp - p.sp / 14 + q.dmp END AS sp,
      CASE WHEN q.n <= 15 THEN coalesce(p.sm, 0) + q.dmm ELSE p.sm - p.sm / 14 + q.dmm END AS sm,
      CASE WHEN q.n > 10 THEN CASE WHEN p.up IS NULL OR b.top < p.up OR q.pc > p.up THEN b.top ELSE p.up END END AS up,
      CASE WHEN q.n > 10 THEN CASE WHEN p.lo IS NULL OR b.bottom > p.lo OR q.pc < p.lo THEN b.bottom ELSE p.lo END END AS lo
    FROM first_pass p JOIN u2 q ON q.symbol = p.symbol AND q.n = p.n + 1,
    LATERAL (SELECT (q.h + q.l) / 2 + 3 * (q.tr * (2.0::DOUBLE / 11) + p.atr10 * (1 - 2.0::DOUBLE / 11)) AS top,
                    (q.h + q.l) / 2 - 3 * (q.tr * (2.0::DOUBLE / 11) + p.atr10 * (1 - 2.0::DOUBLE / 11)) AS bottom) b)),
first_done AS MATERIALIZED (
  SELECT f.*, e12 - e26 AS line, CASE WHEN n >= 15 THEN
    CASE WHEN dp + dm = 0 THEN 0.0 ELSE abs(dp - dm) / (dp + dm) * 100 END END AS dx
  FROM (SELECT *, CASE WHEN st = 0 THEN 0.0 ELSE sp / st * 100 END AS dp, CASE WHEN st = 0 THEN 0.0 ELSE sm / st * 100 END AS dm
        FROM first_pass) f),
smooth AS MATERIALIZED (SELECT *, avg(line) OVER (PARTITION BY symbol ORDER BY n ROWS 8 PRECEDING) AS line9,
    avg(dx) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS dx14 FROM first_done),
second_pass AS (
  SELECT symbol, n, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx FROM smooth WHERE n = 1
  UNION ALL
  SELECT q.symbol, q.n, CASE WHEN q.n = 34 THEN q.line9 WHEN q.n > 34 THEN q.line * 0.2::DOUBLE + p.sig * (1 - 0.2::DOUBLE) END,
    CASE WHEN q.n = 29 THEN q.dx14 WHEN q.n > 29 THEN (p.adx * 13 + q.dx) / 14 END
  FROM second_pass p JOIN smooth q ON q.symbol = p.symbol AND q.n = p.n + 1),
series AS MATERIALIZED (
  SELECT u2.symbol, u2.date, u2.n, s.e21 AS ema21, s.e50 AS ema50, CASE WHEN u2.n >= 15 THEN
      CASE WHEN s.rl = 0 THEN 100.0 ELSE 100 - 100 / (1 + s.rg / s.rl) END END AS rsi14,
    s.line AS macd_line, z.sig AS macd_signal, s.line - z.sig AS macd_hist, s.atr14, z.adx AS adx14,
    CASE WHEN u2.n > 10 THEN CAST(s.trend AS DOUBLE) END AS supertrend, s.sd AS stoch_d, s.atr10, u2.c, u2.v
  FROM u2 JOIN smooth s USING (symbol, n) JOIN second_pass z USING (symbol, n))"""


@query("ind_series_recursive", f"{RECURSIVE} SELECT symbol, CAST(date AS VARCHAR) AS date, {rs(*SERIES_FIELDS, digits=5)} FROM series")
def recursive_series(spark, sf_dir):
    """IND-02/03/05/08/09/10 and the %D of IND-12 on every bar."""
    return indicator_series(bars_daily(spark, sf_dir)).select("symbol", day(), *rounded(*SERIES_FIELDS, digits=5))


LATEST = ["ema21", "ema50", "rsi", "macd_line", "macd_signal", "adx", "supertrend"]


@query("ind_latest_recursive", f"""{RECURSIVE} SELECT symbol, {rs('ema21', 'ema50', digits=5)}, {r('rsi14', 5, 'rsi')},
  {rs('macd_line', 'macd_signal', digits=5)}, {r('adx14', 5, 'adx')}, {r('supertrend', 5)}
FROM series QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1""")
def recursive_latest(spark, sf_dir):
    """The same indicators on the newest bar, folded in the JVM."""
    return scoring.signal_inputs(bars_daily(spark, sf_dir)).select("symbol", *rounded(*LATEST, digits=5))


@query("ind04_rsi_exponential", f"WITH {BARS}, {RSI_EXP} SELECT symbol, {r('rsi14')} FROM rsi_exp")
def rsi_exp(spark, sf_dir):
    return features.scanner_features(bars_daily(spark, sf_dir)).select("symbol", *rounded("rsi14"))


SIGNAL = f"""{RECURSIVE}, last_bar AS (
  SELECT *, avg(v) OVER (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING) AS avg20, lead(n) OVER (PARTITION BY symbol ORDER BY n) IS NULL AS is_last FROM series),
fund AS (SELECT symbol, CAST(CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0 THEN 40 + CAST(split_part(symbol, '#', 2) AS INT) END AS DOUBLE) AS fs
  FROM (SELECT DISTINCT symbol FROM bars)),
parts AS (
  SELECT symbol, n, CASE WHEN n >= 50 THEN greatest(-1, least(1, (ema21 - ema50) / ema50 * 25)) END AS p1,
    greatest(-1, least(1, macd_hist / (c * 0.004::DOUBLE))) AS p2, supertrend AS p3,
    supertrend * abs(greatest(-1, least(1, (v / avg20 - 1) * 2))) AS p4, CASE WHEN fs IS NOT NULL THEN greatest(-1, least(1, (fs - 50) / 50)) END AS p6
  FROM last_bar JOIN fund USING (symbol) WHERE is_last),
totals AS (
  SELECT *, CASE WHEN p6 IS NULL THEN 0.75 ELSE 0.85 END::DOUBLE AS w FROM parts),
sig AS (
  SELECT symbol, CASE WHEN n >= 50 THEN CAST(floor((0.30 * p1 + 0.20 * p2 + 0.15 * p3 + 0.10 * p4 + 0.10 * coalesce(p6, 0)) * 100 / w + 0.5) AS BIGINT) END AS signal_score
  FROM totals)"""


@query("sco01_composite_signal", f"""{SIGNAL} SELECT symbol, signal_score, CASE WHEN signal_score >= 40 THEN 'STRONG BUY' WHEN signal_score >= 15 THEN 'BUY'
  WHEN signal_score <= -40 THEN 'STRONG SELL' WHEN signal_score <= -15 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM sig""")
def composite_signal(spark, sf_dir):
    """Even brands have a fundamental score, odd ones do not, so both weightings occur."""
    return signal_rows(spark, sf_dir).select("symbol", F.col("signal_score").cast("long").alias("signal_score"), "signal")


def signal_rows(spark, sf_dir) -> DataFrame:
    n = F.substring_index("symbol", "#", -1).cast("int")
    inputs = scoring.signal_inputs(bars_daily(spark, sf_dir)).withColumn(
        "fundamental_score", F.when(n % 2 == 0, (40 + n).cast("double")))
    return scoring.composite_signal(inputs)


# ---- feature passes ---------------------------------------------------------------------------------

FEATURE_ROWS = ", ".join([ALL_FEATURES, RSI_EXP])


@query("fea01_scanner_features", f"""WITH {FEATURE_ROWS}
SELECT f3.symbol, bar_no AS history_days, CAST(date AS VARCHAR) AS last_candle_date, {r('c', 6, 'last_close')},
 {rs(*features.FEATURES)}, {rs(*[f'rel_{n}_{k}d' for n in ('mkt', 'sec') for k in (5, 10, 20)])}, {r('rsi14')}
FROM f3 JOIN rsi_exp USING (symbol) WHERE is_last AND bar_no >= 60""")
def scanner_features(spark, sf_dir):
    return scanner_rows(spark, sf_dir).select(
        "symbol", "history_days", day("last_candle_date"), *rounded("last_close", *features.FEATURES,
        *[f"rel_{n}_{k}d" for n in ("mkt", "sec") for k in (5, 10, 20)], "rsi14"))


def scanner_rows(spark, sf_dir) -> DataFrame:
    bars = stored_bars(spark, sf_dir)
    members = universe(bars)
    return features.scanner_features(
        bars.join(members.select("symbol", "sector"), "symbol"), market_index(bars), sector_index(bars, members))


RESULT_FEATURES = """rf AS (
  SELECT symbol, date, c AS last_close, row_number() OVER w AS n, lead(date) OVER w IS NULL AS is_last,
    c / lag(c, 5) OVER w - 1 AS ret_5d, c / lag(c, 20) OVER w - 1 AS ret_20d, c / lag(c, 60) OVER w - 1 AS ret_60d,
    c / max(c) OVER (PARTITION BY symbol ORDER BY date ROWS 249 PRECEDING) AS pct_of_52w_high,
    stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) * sqrt(250) AS vol_ann,
    avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) / nullif(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 0) AS vol_ratio_5v60,
    avg(c * v) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) / 1e7 AS adv20_cr,
    c > avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS above_50dma
  FROM (SELECT *, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM bars)
  WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("fea02_result_screen_features", f"""WITH {BARS}, {RESULT_FEATURES} SELECT symbol, n AS history_days, CAST(date AS VARCHAR) AS last_candle_date,
  {rs('last_close', 'ret_5d', 'ret_20d', 'ret_60d', 'pct_of_52w_high')}, round(CASE WHEN n > 20 THEN vol_ann END, 6) AS vol_ann,
  {rs('vol_ratio_5v60', 'adv20_cr')}, {r('CASE WHEN n >= 50 THEN above_50dma END', 0, 'above_50dma')} FROM rf WHERE is_last""")
def result_features(spark, sf_dir):
    return features.result_screen_features(bars_daily(spark, sf_dir)).select(
        "symbol", "history_days", day("last_candle_date"), *rounded(
            "last_close", "ret_5d", "ret_20d", "ret_60d", "pct_of_52w_high", "vol_ann", "vol_ratio_5v60", "adv20_cr",
            "above_50dma"))


@query("agg09_base_rate", f"""WITH {BARS}, x AS (
  SELECT symbol, n, CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0 THEN 7 ELSE 15 END AS h,
    CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0 THEN top7 ELSE top15 END / c - 1 AS top,
    CASE WHEN CAST(split_part(symbol, '#', 2) AS INT) % 2 = 0 THEN end7 ELSE end15 END / c - 1 AS fin
  FROM (SELECT symbol, c, count(*) OVER (PARTITION BY symbol) AS n,
    max(c) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS top7,
    max(c) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS top15,
    lead(c, 7) OVER (PARTITION BY symbol ORDER BY date) AS end7, lead(c, 15) OVER (PARTITION BY symbol ORDER BY date) AS end15 FROM bars))
SELECT symbol, CAST(h AS BIGINT) AS base_window_days, round(avg(CASE WHEN top >= 0.10 THEN 1.0 ELSE 0.0 END), 6) AS base_touch_10pct,
  round(avg(CASE WHEN fin <= -0.10 THEN 1.0 ELSE 0.0 END), 6) AS base_close_below_m10pct
FROM x WHERE fin IS NOT NULL AND n > h + 30 GROUP BY symbol, h""")
def base_rate(spark, sf_dir):
    """Even brands have 8 sessions left, odd ones 12."""
    bars = bars_daily(spark, sf_dir)
    left = bars.select("symbol").distinct().withColumn(
        "trading_days_left", F.when(F.substring_index("symbol", "#", -1).cast("int") % 2 == 0, 8).otherwise(12))
    return features.base_rate(bars, left).select(
        "symbol", F.col("base_window_days").cast("long").alias("base_window_days"),
        *rounded("base_touch_10pct", "base_close_below_m10pct"))
