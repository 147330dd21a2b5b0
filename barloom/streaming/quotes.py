"""Live quotes, one-shot alerts and intraday bars with Structured Streaming.

Stateful parts are streaming aggregates (state per ticker or per bar) or ``foreachBatch`` merges whose output is
keyed by batch, so a batch that runs again after a failure replaces its own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from barloom.functions.clock import exchange_date, skip_quotes
from barloom.functions.scalars import is_true
from barloom.sources.bars import order_key


# ---- quotes --------------------------------------------------------------------------------------------

def latest_quotes(ticks: DataFrame, fields: list[str], kept_fields: list[str], order: Column) -> DataFrame:
    """The newest row per symbol; ``kept_fields`` keep their last known value when the newest row lacks them.

    Works on a stream (state: one row per symbol, updated in place) and on a table alike. Both kinds of
    aggregates combine before the shuffle, so a symbol with very many ticks is cheap.
    """
    newest = F.max_by(F.struct(*fields), order).alias("q")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in kept_fields]
    return ticks.groupBy("symbol").agg(F.max(order).alias("at"), newest, *kept).select("symbol", "at", "q.*", *kept_fields)


def during_session(ticks: DataFrame, ts: str = "ts", keep_all: bool = False) -> DataFrame:
    """Quotes inside pre-open and session hours; ``keep_all`` is for the first load, when nothing is held yet."""
    return ticks if keep_all else ticks.filter(~skip_quotes(F.col(ts)))


# ---- intraday bars ---------------------------------------------------------------------------------------

def five_minute_bars(ticks: DataFrame, watermark: str | None = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """OHLCV per symbol and five minutes. Ticks: symbol, ts, price, qty, tick_id (order inside one time)."""
    rows = ticks.withWatermark("ts", watermark) if watermark else ticks
    order = F.struct("ts", "tick_id")
    return rows.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", order).alias("c"), F.sum("qty").alias("v"),
    ).select("symbol", F.col("window.start").alias("bar_start"), "o", "h", "l", "c", "v")


def final_bars(ticks: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Bars of a stream that are finished by the watermark, for append mode: a bar comes once and never changes; ``n`` is its ticks.

    Ticks that come after their bar is finished are not in it; ``late_ticks`` counts them. Ticks of one time are ordered by tick_id.
    """
    order = order_key((F.unix_micros("ts"), 18), (F.col("tick_id"), 19))
    return ticks.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", order).alias("c"), F.sum("qty").alias("v"), F.count("*").alias("n"),
    ).select("symbol", F.col("window.start").alias("bar_start"), "o", "h", "l", "c", "v", "n")


def late_ticks(arrived: DataFrame, bars: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(symbol, bar_start, late): ticks that arrived for a finished bar (``final_bars``) but are not in it."""
    came = arrived.groupBy("symbol", F.window("ts", width).start.alias("bar_start")).agg(F.count("*").alias("came"))
    return came.join(bars.select("symbol", "bar_start", "n"), ["symbol", "bar_start"]).filter("came > n").select(
        "symbol", "bar_start", (F.col("came") - F.col("n")).alias("late"))


def last_session(bars: DataFrame) -> DataFrame:
    """Only the bars of each symbol's newest exchange date."""
    dated = bars.withColumn("_d", exchange_date(F.col("bar_start")))
    newest = dated.groupBy("symbol").agg(F.max("_d").alias("_d"))
    return dated.join(newest, ["symbol", "_d"], "left_semi").drop("_d")


# ---- alerts ---------------------------------------------------------------------------------------------------

def alert_fires() -> Column:
    """Price or RSI at or beyond its level, or a signal of the wanted family; missing data never fires."""
    level = F.col("value").try_cast("double")
    seen = F.when(F.col("metric") == "price", F.col("ltp")).when(F.col("metric") == "rsi", F.col("rsi"))
    known = seen.isNotNull() & ~F.isnan(seen) & level.isNotNull()
    crossed = F.when(F.col("condition") == "above", seen >= level).otherwise(seen <= level)
    wanted = F.col("value")
    family = (F.col("signal") == wanted) | ((wanted == "BUY") & F.col("signal").contains("BUY")) | (
        (wanted == "SELL") & F.col("signal").contains("SELL"))
    return is_true(F.when(F.col("metric").isin("price", "rsi"), known & crossed)
                   .when(F.col("metric") == "signal", family & F.col("signal").isNotNull()))


def fired(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first quote that fires each alert."""
    order = F.struct("ts", "tick_id")
    return quotes.join(alerts, "symbol").filter(alert_fires()).groupBy("alert_id").agg(
        F.min_by(F.struct("symbol", "ts", "ltp", "metric", "value"), order).alias("f")).select("alert_id", "f.*")


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def alert_latch(alerts: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: writes alerts that fire for the first time; once written they never fire again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _read_or_none(spark, out)
        open_ = alerts if done is None else alerts.join(done.filter(F.col("batch_id") < batch_id), "alert_id", "left_anti")
        (fired(batch, open_).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    return step


# ---- history --------------------------------------------------------------------------------------------

def refresh_signals(history_path: str, signals_path: str, compute: Callable[[DataFrame], DataFrame],
                    upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: merges newly loaded bars into history and recomputes only the symbols that changed.

    Each batch appends its own partition of bars; a bar's newest copy wins on read, so nothing is rewritten.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        def save(df: DataFrame, path: str) -> None:
            (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

        spark = batch.sparkSession
        save(batch, history_path)
        all_bars = spark.read.parquet(history_path).filter(F.col("batch_id") <= batch_id).drop("batch_id")
        changed = batch.select("symbol").distinct()
        touched = all_bars.join(changed, "symbol", "left_semi")
        merged = upsert(touched.limit(0), touched)
        save(compute(merged), signals_path)

    return step


def newest_signals(signals: DataFrame) -> DataFrame:
    """The last computed signal row per symbol."""
    payload = F.struct(*[c for c in signals.columns if c not in ("symbol", "batch_id")])
    return signals.groupBy("symbol").agg(F.max_by(payload, "batch_id").alias("p")).select("symbol", "p.*")


# ---- running ----------------------------------------------------------------------------------------------------------

def run_to_end(query_writer, checkpoint: str) -> None:
    """Starts a prepared writer on everything available now and waits for it."""
    q: StreamingQuery = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
