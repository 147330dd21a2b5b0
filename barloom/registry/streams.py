"""Verified streaming queries: each runs to the end of the events table and is read back from its sink."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions import text_events as te
from barloom.functions.blocked import LONG_FIELDS, long_indicators
from barloom.functions.folds import SERIES_FIELDS
from barloom.operators import dedup
from barloom.plans.screener import screener_signals
from barloom.registry.companies import SCREEN
from barloom.registry.core import query
from barloom.registry.events import REPS, brand_aliases, stop_list
from barloom.registry.market import RECURSIVE, day, rounded
from barloom.registry.snippets import BARS, r, rs
from barloom.session import fresh_dir, stage
from barloom.sources import bars as bar_source
from barloom.sources.bindings import brand_number, filings, stored_bars, table, universe
from barloom.streaming import alerts as alert_stream, quotes as st, state, stories
from barloom.streaming.feed import in_parts, save_batches


def event_ticks(spark, sf_dir, stream: bool) -> DataFrame:
    """Events as ticks: symbol = event type, price = value, one unit each."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema) if stream else spark.read.schema(schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"),
        F.col("event_id").alias("tick_id"), "user_id")


BARS5 = "bars5 AS (SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS s, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"


@query("str03_five_minute_bars", f"WITH {BARS5} SELECT symbol, strftime(s, '%Y-%m-%d %H:%M') AS bar_start, o, h, l, c, v FROM bars5")
def stream_bars(spark, sf_dir):
    """The stream in update mode; each bar's last state is its result."""
    out = fresh_dir(spark, "bars5")
    bars = st.five_minute_bars(event_ticks(spark, sf_dir, True))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    st.run_to_end(bars.writeStream.outputMode("update").foreachBatch(save), fresh_dir(spark, "cp"))
    done = spark.read.parquet(out)
    return done.groupBy("symbol", "bar_start").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "batch_id").alias("b")).select(
        "symbol", F.date_format("bar_start", "yyyy-MM-dd HH:mm").alias("bar_start"), "b.*")


@query("agg10_intraday_last_session", f"""WITH {BARS5} SELECT symbol, strftime(s, '%Y-%m-%d %H:%M') AS bar_start, o, h, l, c, v FROM bars5
QUALIFY CAST(s + INTERVAL 330 MINUTE AS DATE) = max(CAST(s + INTERVAL 330 MINUTE AS DATE)) OVER (PARTITION BY symbol)""")
def last_session(spark, sf_dir):
    bars = st.last_session(st.five_minute_bars(event_ticks(spark, sf_dir, False), watermark=None))
    return bars.select("symbol", F.date_format("bar_start", "yyyy-MM-dd HH:mm").alias("bar_start"), "o", "h", "l", "c", "v")


@query("ind_long_series", f"""{RECURSIVE.replace(BARS, BARS5 + ", bars AS (SELECT symbol, s AS date, o, h, l, c, v FROM bars5)")}
SELECT symbol, strftime(date, '%Y-%m-%d %H:%M') AS bar_start, {rs(*LONG_FIELDS, digits=5)} FROM series""")
def long_series(spark, sf_dir):
    """IND-02/03/05/08/09 on five-minute bars, a month of them per symbol, in blocks of two days."""
    bars = st.five_minute_bars(event_ticks(spark, sf_dir, False), watermark=None).withColumnRenamed("bar_start", "ts")
    return long_indicators(bars).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("bar_start"), *rounded(*LONG_FIELDS, digits=5))


PARTS = """parted AS (SELECT *, least(CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END, 2) AS part,
  time_bucket(INTERVAL 5 MINUTE, ts) AS s FROM events),
marks AS (SELECT p AS part, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM parted WHERE part < p) AS mark FROM (VALUES (0), (1), (2), (3)) AS t(p)),
timely AS (SELECT e.*, coalesce(s + INTERVAL 5 MINUTE > mark, true) AS ok FROM parted e JOIN marks USING (part))"""


@query("str03_final_bars", f"""WITH {PARTS} SELECT event_type AS symbol, strftime(s, '%Y-%m-%d %H:%M') AS bar_start, first(value ORDER BY ts, event_id) FILTER (ok) AS o, max(value) FILTER (ok) AS h,
  min(value) FILTER (ok) AS l, last(value ORDER BY ts, event_id) FILTER (ok) AS c, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS late
FROM timely GROUP BY 1, 2, s HAVING count(*) FILTER (ok) > 0 AND s + INTERVAL 5 MINUTE <= (SELECT mark FROM marks WHERE part = 3)""")
def final_bars(spark, sf_dir):
    """Ticks come in three parts, a thirteenth of them a part too late; each bar is written once, when the watermark has passed it."""
    out = fresh_dir(spark, "final")
    ticks = event_ticks(spark, sf_dir, False).drop("user_id")
    base = F.when(F.col("ts") < "2024-01-09", 0).when(F.col("ts") < "2024-01-20", 1).otherwise(2)
    part = F.least(base + F.when(F.col("tick_id") % 13 == 0, 1).otherwise(0), F.lit(2))
    in_parts(ticks, part, 3, lambda rows: st.final_bars(rows).writeStream.outputMode("append").foreachBatch(save_batches(out)))
    bars = spark.read.parquet(out)
    late = st.late_ticks(ticks, bars)
    return bars.join(late, ["symbol", "bar_start"], "left").select(
        "symbol", F.date_format("bar_start", "yyyy-MM-dd HH:mm").alias("bar_start"), "o", "h", "l", "c", "n", F.coalesce("late", F.lit(0)).alias("late"))


def quote_ticks(spark, sf_dir, stream: bool) -> DataFrame:
    """One ticker per user; every third tick carries a signal, the others lack it."""
    k = F.col("tick_id")
    return event_ticks(spark, sf_dir, stream).select(
        F.concat(F.lit("U"), "user_id").alias("symbol"), "ts", "tick_id", F.col("price").alias("ltp"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, "STRONG BUY").otherwise("SELL")).alias("signal"),
        F.when(k % 3 == 0, (k % 100).cast("double")).alias("rsi"))


@query("str01_src19_latest_quotes", """SELECT 'U' || user_id AS symbol, last(value ORDER BY ts, event_id) AS ltp,
  last(CASE WHEN event_id % 2 = 0 THEN 'STRONG BUY' ELSE 'SELL' END ORDER BY ts, event_id) FILTER (event_id % 3 = 0) AS signal,
  last(CAST(event_id % 100 AS DOUBLE) ORDER BY ts, event_id) FILTER (event_id % 3 = 0) AS rsi FROM events GROUP BY 1""")
def latest_quotes(spark, sf_dir):
    """Upsert per ticker: newest price, and the last known signal where the newest tick has none."""
    out = fresh_dir(spark, "quotes")
    live = st.latest_quotes(quote_ticks(spark, sf_dir, True), ["ltp"], ["signal", "rsi"], F.struct("ts", "tick_id"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    st.run_to_end(live.writeStream.outputMode("update").foreachBatch(save), fresh_dir(spark, "cp"))
    return spark.read.parquet(out).groupBy("symbol").agg(
        F.max_by(F.struct("ltp", "signal", "rsi"), "batch_id").alias("q")).select("symbol", "q.*")


@query("str02_one_shot_alerts", """WITH alerts AS (SELECT DISTINCT user_id, 'U' || user_id AS symbol, user_id % 4 AS k, 20 + user_id % 60 AS lvl FROM events),
hits AS (SELECT a.symbol, e.event_id, e.ts FROM alerts a JOIN events e USING (user_id) WHERE CASE k WHEN 0 THEN value >= lvl WHEN 1 THEN value <= lvl
  WHEN 2 THEN event_id % 3 = 0 AND event_id % 100 >= lvl ELSE event_id % 3 = 0 AND event_id % 2 = 0 END)
SELECT 'A' || symbol AS alert_id, arg_min(event_id, (ts, event_id)) AS tick_id FROM hits GROUP BY symbol""")
def one_shot_alerts(spark, sf_dir):
    """One alert per ticker: price above or below, RSI above, or a BUY-family signal. Each fires once."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id") % 4
    alerts = users.select(
        F.concat(F.lit("AU"), "user_id").alias("alert_id"), F.concat(F.lit("U"), "user_id").alias("symbol"),
        F.when(k < 2, "price").when(k == 2, "rsi").otherwise("signal").alias("metric"),
        F.when(k == 1, "below").otherwise("above").alias("condition"),
        F.when(k == 3, "BUY").otherwise((20 + F.col("user_id") % 60).cast("string")).alias("value"))
    out = fresh_dir(spark, "alerts")
    st.run_to_end(quote_ticks(spark, sf_dir, True).writeStream.foreachBatch(st.alert_latch(alerts, out)), fresh_dir(spark, "cp"))
    done = spark.read.parquet(out)
    ticks = quote_ticks(spark, sf_dir, False).select("symbol", "ts", "ltp", "tick_id")
    return done.join(ticks, ["symbol", "ts", "ltp"]).select("alert_id", "tick_id")


@query("str02_level_alerts", """WITH t AS (SELECT event_id, ts, value, 'U' || user_id AS symbol, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS part FROM events),
a AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN (SELECT 'U' || min(user_id) FROM events) ELSE 'U' || user_id END AS symbol, event_id % 5 AS k, event_id % 120 AS lvl, event_id % 2 AS part FROM events WHERE event_id % 3 = 0),
hits AS (SELECT id, event_id, ts FROM a JOIN t ON a.symbol = t.symbol AND t.part >= a.part WHERE CASE k WHEN 0 THEN value >= lvl WHEN 1 THEN value <= lvl
  WHEN 2 THEN event_id % 3 = 0 AND event_id % 100 >= lvl WHEN 3 THEN event_id % 3 = 0 AND event_id % 100 <= lvl ELSE event_id % 3 = 0 AND event_id % 2 = lvl % 2 END)
SELECT 'A' || id AS alert_id, arg_min(event_id, (ts, event_id)) AS tick_id FROM hits GROUP BY id""")
def level_alerts(spark, sf_dir):
    """An alert for every third event, a third of them on one symbol; alerts and ticks come in three parts."""
    ticks = quote_ticks(spark, sf_dir, False)
    first = table(spark, sf_dir, "events").agg(F.min("user_id").alias("u")).first()["u"]
    e, k = F.col("event_id"), F.col("event_id") % 5
    level = (e % 120).cast("string")
    alerts = table(spark, sf_dir, "events").filter(e % 3 == 0).select(
        F.concat(F.lit("A"), e).alias("alert_id"), F.concat(F.lit("U"), F.when(e % 9 == 0, first).otherwise(F.col("user_id"))).alias("symbol"),
        F.when(k < 2, "price").when(k < 4, "rsi").otherwise("signal").alias("metric"), F.when((k == 1) | (k == 3), "below").otherwise("above").alias("condition"),
        F.when(k < 4, level).when(e % 2 == 0, "BUY").otherwise("SELL").alias("value"), (e % 2).cast("int").alias("part"))
    said = ticks.withColumn("part", F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2))
    both = said.unionByName(alerts, allowMissingColumns=True)
    out, many = fresh_dir(spark, "fired"), 10_000
    shares = stage(alerts.groupBy("symbol").agg(F.ceil(F.count("*") / many).alias("shares")).filter("shares > 1"), "shares")

    def start(rows: DataFrame):
        fired = alert_stream.level_alerts(rows.filter("alert_id is null"), rows.filter("alert_id is not null"), shares=shares)
        return fired.writeStream.outputMode("append").foreachBatch(save_batches(out))

    in_parts(both, F.col("part"), 3, start)
    return spark.read.parquet(out).select("alert_id", "tick_id")


@query("str04_session_quotes", """SELECT 'U' || user_id AS symbol, count(*) AS n FROM events WHERE isodow(ts + INTERVAL 330 MINUTE) < 6
  AND hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) BETWEEN 540 AND 929 GROUP BY 1""")
def session_quotes(spark, sf_dir):
    """Ticks outside pre-open and session hours are dropped from the stream."""
    out = fresh_dir(spark, "session")
    st.run_to_end(st.during_session(quote_ticks(spark, sf_dir, True)).select("symbol", "tick_id").writeStream.format("parquet").option(
        "path", out), fresh_dir(spark, "cp"))
    return spark.read.parquet(out).groupBy("symbol").agg(F.count("*").alias("n"))


@query("str05_refreshed_signals", """WITH b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2),
x AS (SELECT *, avg(c) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS m, lead(date) OVER (PARTITION BY symbol ORDER BY date) IS NULL AS last_one, count(*) OVER (PARTITION BY symbol) AS n FROM b)
SELECT symbol, n AS bars, round(m, 6) AS sma14 FROM x WHERE last_one""")
def refreshed_signals(spark, sf_dir):
    """Daily bars arrive as a stream; each batch merges them and recomputes the symbols it touched."""
    from barloom.operators.scoring import signal_inputs

    landing, bars_path, signals_path = (fresh_dir(spark, n) for n in ("landing", "bars", "signals"))
    daily = bar_source.roll_up_ticks(event_ticks(spark, sf_dir, False).withColumn("seq", bar_source.order_key((F.unix_micros("ts"), 18), (F.col("tick_id"), 19))), ["symbol", F.to_date("ts").alias("date")])
    daily.withColumn("load_ts", F.lit(1)).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    step = st.refresh_signals(bars_path, signals_path, lambda b: signal_inputs(b).select("symbol", "bars", "sma14"), bar_source.upsert_bars)
    st.run_to_end(spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(step), fresh_dir(spark, "cp"))
    return st.newest_signals(spark.read.parquet(signals_path)).select("symbol", "bars", *rounded("sma14"))


@query("str05_carried_signals", f"{RECURSIVE} SELECT symbol, CAST(date AS VARCHAR) AS date, {rs(*SERIES_FIELDS, digits=5)} FROM series")
def carried_signals(spark, sf_dir):
    """Daily bars come in four parts, each with a restart; every recursive indicator goes on from the state the part before left."""
    out, bars = fresh_dir(spark, "carried"), stored_bars(spark, sf_dir).withColumn("load_ts", F.lit(1))
    year = F.least(F.greatest(F.year("date") - 1996, F.lit(0)), F.lit(3))
    in_parts(bars, year, 4, lambda rows: state.carried_indicators(rows).writeStream.outputMode("append").foreachBatch(save_batches(out)))
    return spark.read.parquet(out).filter("not late").select("symbol", day(), *rounded(*SERIES_FIELDS, digits=5))


LATE, EXPIRY_DAYS = 10, 150


@query("str01_pip05_live_screener", f"""{SCREEN}, hist AS (SELECT symbol, date, h, l, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars),
told AS (SELECT symbol, max(date) AS newest, arg_max(CASE WHEN n % 3 = 0 THEN h * 1.5::DOUBLE END, n) AS hi_last, last(h * 1.5::DOUBLE ORDER BY n) FILTER (n % 3 = 0) AS hi_kept,
  last(CASE WHEN n % 3 = 0 THEN h * 1.5::DOUBLE END ORDER BY n) AS hi_now, last(CASE WHEN n % 4 = 0 THEN l * 0.5::DOUBLE END ORDER BY n) AS lo_now,
  last(l * 0.5::DOUBLE ORDER BY n) FILTER (n % 4 = 0) AS lo_kept, max(n) AS bars FROM hist GROUP BY symbol)
SELECT symbol, name, sector, cap, ltp, {r('changePct', 5)}, volume, {rs('relVol', digits=5)}, CASE WHEN bars >= 50 THEN CAST(signal_score AS DOUBLE) END AS signalScore,
  coalesce(hi_now, CASE WHEN bars >= 50 THEN hi52 END, hi_kept) AS week52High, coalesce(lo_now, CASE WHEN bars >= 50 THEN lo52 END, lo_kept) AS week52Low, fs AS fundamentalScore
FROM screen JOIN told USING (symbol) WHERE newest + INTERVAL {EXPIRY_DAYS} DAY > (SELECT max(newest) FROM told) - INTERVAL {LATE} DAY""")
def streamed_screener(spark, sf_dir):
    """Every daily bar is a quote; quotes come in four parts with late and repeated ones, tables are joined in each batch."""
    bars = stored_bars(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    number = brand_number(F.col("symbol"))
    prev = F.lag("c").over(Window.partitionBy("symbol").orderBy("date"))
    ticks = bars.select(
        "symbol", F.col("date").cast("timestamp").alias("ts"), n.alias("tick_id"), F.col("c").alias("ltp"), F.col("o").alias("open"),
        F.col("h").alias("high"), F.col("l").alias("low"), F.col("v").alias("volume"), prev.alias("before")).select(
        "*", F.when(number % 6 != 5, F.col("before")).alias("prev_close"), F.when(number % 3 == 0, F.lit(1.5) - number % 4).alias("given_pct"),
        F.when(number % 3 != 2, F.col("ltp") - F.col("before")).alias("net_change"),
        F.when(F.col("tick_id") % 3 == 0, F.col("high") * 1.5).alias("high52"), F.when(F.col("tick_id") % 4 == 0, F.col("low") * 0.5).alias("low52"))
    scores = bars.select("symbol").distinct().filter(number % 2 == 0).select("symbol", (40 + number).cast("double").alias("fundamentalScore"))
    signals = stage(screener_signals(bars, scores).select("symbol", "signalScore", "signal", "avgVolume", "week52High", "week52Low"), "signals")
    listed, out = stage(universe(bars).select("symbol", "name", "sector", "cap"), "universe"), fresh_dir(spark, "screener")
    span = F.datediff(F.to_date("ts"), F.lit("1995-01-01"))
    part = F.least(F.greatest(F.floor(span / 650), F.lit(0)), F.lit(3)).cast("int")
    late = (F.col("tick_id") % 9 == 0) & (F.floor((span + 5) / 650) > F.floor(span / 650))      # comes with the next part, up to five days late
    again = ticks.filter(F.col("tick_id") % 11 == 0).withColumn("part", F.least(part + late.cast("int"), F.lit(3)))
    dealt = ticks.withColumn("part", F.least(part + late.cast("int"), F.lit(3))).unionByName(again)

    def start(rows: DataFrame):
        live = state.live_screener(rows.drop("part"), listed, signals, scores, f"{LATE} days", timedelta(days=EXPIRY_DAYS))
        return live.writeStream.outputMode("update").foreachBatch(save_batches(out))

    in_parts(dealt, F.col("part"), 4, start)
    return state.newest_rows(spark.read.parquet(out)).select(
        "symbol", "name", "sector", "cap", "ltp", *rounded("changePct", digits=5), "volume", *rounded("relVol", digits=5),
        F.col("signalScore").cast("double").alias("signalScore"), "week52High", "week52Low", "fundamentalScore")


@query("str06_rolling_news", f"WITH RECURSIVE {REPS} SELECT story, b.item_id, copies, array_to_string(list_filter(srcs, lambda s: s <> a.source), ', ') AS related FROM best b JOIN art a USING (item_id)")
def rolling_news(spark, sf_dir):
    """Headlines come in three parts, some with a later one; after the last the live stories are those of all items."""
    items = filings(spark, sf_dir).select("item_id", "title", "source", "ts")
    keys = items.select(te.headline_title(F.col("title"), F.col("source")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    out = fresh_dir(spark, "stories")
    step = stories.rolling_stories(out, brand_aliases(spark, sf_dir), dedup.corpus_of(keys, stop_list()), stop=stop_list())
    part = F.when(F.col("item_id") % 17 == 0, 2).when(F.col("ts") < "1997-01-01", 0).when(F.col("ts") < "1999-06-01", 1).otherwise(2)
    in_parts(items, part, 3, lambda rows: rows.writeStream.foreachBatch(step))
    return stories.live_stories(spark, out).select("story", "item_id", "copies", F.concat_ws(", ", "related_sources").alias("related"))
