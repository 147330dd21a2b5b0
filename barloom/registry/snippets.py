"""SQL building blocks (common table expressions) for the check queries."""

TICKS = """ticks AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
         l_returnflag AS flag, l_linestatus AS status, l_partkey AS part_id, l_discount AS discount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BARS = TICKS + """,
bars AS (
  SELECT symbol, date, first(price ORDER BY k1, k2, k3, k4) AS o, max(price) AS h, min(price) AS l,
         last(price ORDER BY k1, k2, k3, k4) AS c, sum(qty) AS v
  FROM ticks GROUP BY symbol, date)"""

UNIVERSE = """universe AS (
  SELECT symbol, 'Company ' || n AS name,
         ['Financial Services', 'Information Technology', 'Healthcare', 'Realty', 'Unlisted Trades'][((n - 1) // 5) % 5 + 1] AS sector,
         ['Large', 'Mid', 'Small', 'Micro'][n % 4 + 1] AS cap, n % 3 = 0 AS flagship,
         printf('INE%07d', n) AS isin, 500000 + n AS bse_code
  FROM (SELECT DISTINCT symbol, CAST(split_part(symbol, '#', 2) AS INT) AS n FROM bars))"""

MARKET = "market AS (SELECT date, avg(c) AS c FROM bars GROUP BY date)"
SECTORS = """sectors AS (
  SELECT sector, date, avg(c) AS c FROM bars JOIN universe USING (symbol) GROUP BY sector, date)"""

# scanner features on every bar (named windows w; frames are written out)
FEATURES = """aligned AS (
  SELECT b.*, u.sector,
         last_value(m.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS mkt,
         last_value(s.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS sec
  FROM bars b JOIN universe u USING (symbol)
  LEFT JOIN market m ON m.date = b.date LEFT JOIN sectors s ON s.date = b.date AND s.sector = u.sector),
f1 AS (
  SELECT *, row_number() OVER w AS bar_no, lead(date) OVER w IS NULL AS is_last, ln(c / lag(c) OVER w) AS log_ret,
         c - lag(c) OVER w AS change,
         c / lag(c, 5) OVER w - 1 AS ret_5d, c / lag(c, 10) OVER w - 1 AS ret_10d,
         c / lag(c, 20) OVER w - 1 AS ret_20d, c / lag(c, 60) OVER w - 1 AS ret_60d,
         mkt / lag(mkt, 5) OVER w - 1 AS m5, mkt / lag(mkt, 10) OVER w - 1 AS m10, mkt / lag(mkt, 20) OVER w - 1 AS m20,
         sec / lag(sec, 5) OVER w - 1 AS s5, sec / lag(sec, 10) OVER w - 1 AS s10, sec / lag(sec, 20) OVER w - 1 AS s20
  FROM aligned WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f2 AS (
  SELECT *, lag(ret_5d, 5) OVER w AS ret_prev5d,
    nullif(stddev_samp(log_ret) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 0) AS sigma_daily,
    avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)
      / nullif(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 54 PRECEDING AND 5 PRECEDING), 0) AS rvol_5d,
    v / nullif(avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS rvol_1d,
    sum(CASE WHEN change > 0 THEN v ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)
      / nullif(sum(CASE WHEN change > 0 THEN 0 ELSE v END) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), 0)
      AS updown_vol_ratio,
    avg(c * v) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) / 1e7 AS adv20_cr,
    avg((h - l) / c) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS atr_pct,
    c / max(h) OVER (PARTITION BY symbol ORDER BY date ROWS 249 PRECEDING) AS pct_of_52w_high,
    c > avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS above_20dma,
    c > avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS above_50dma
  FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f3 AS (
  SELECT *, ret_5d - ret_prev5d AS accel, sigma_daily * sqrt(250) AS vol_ann,
    ret_20d / (sigma_daily * sqrt(20)) AS z_20d, ret_5d / (sigma_daily * sqrt(5)) AS z_5d,
    ret_5d - m5 AS rel_mkt_5d, ret_10d - m10 AS rel_mkt_10d, ret_20d - m20 AS rel_mkt_20d,
    ret_5d - s5 AS rel_sec_5d, ret_10d - s10 AS rel_sec_10d, ret_20d - s20 AS rel_sec_20d
  FROM f2)"""

ALL_FEATURES = ", ".join([BARS, UNIVERSE, MARKET, SECTORS, FEATURES])

# exponential RSI of the whole history, newest value
RSI_EXP = """moved AS (
  SELECT symbol, date, c - lag(c) OVER (PARTITION BY symbol ORDER BY date) AS d FROM bars),
move_lists AS (
  SELECT symbol, list(greatest(d, 0) ORDER BY date) AS ups, list(greatest(-d, 0) ORDER BY date) AS dns
  FROM moved WHERE d IS NOT NULL GROUP BY symbol),
rsi_exp AS (
  SELECT symbol, CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi14 FROM (
    SELECT symbol, list_reduce(ups, lambda a, x: a * (1 - 1.0::DOUBLE / 14) + x * (1.0::DOUBLE / 14)) AS up,
           list_reduce(dns, lambda a, x: a * (1 - 1.0::DOUBLE / 14) + x * (1.0::DOUBLE / 14)) AS dn FROM move_lists))"""


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    """A rounded output column without negative zero."""
    name = alias or expr
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits) for n in names)
