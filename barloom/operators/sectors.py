"""Market breadth, sector roll-ups and index performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import bar_windows as b
from barloom.functions.scalars import ratio


def breadth(rows: DataFrame) -> DataFrame:
    """Advancing, declining and unchanged; an unknown change counts as unchanged."""
    up = F.count_if(F.col("changePct") > 0)
    down = F.count_if(F.col("changePct") < 0)
    return rows.agg(F.count(F.lit(1)).alias("total"), up.alias("advancing"), down.alias("declining"),
                    (F.count(F.lit(1)) - up - down).alias("unchanged"))


def sector_rollup(rows: DataFrame) -> DataFrame:
    """Per sector: size, movers, medians, best and worst stock."""
    up, down = F.count_if(F.col("changePct") > 0), F.count_if(F.col("changePct") < 0)
    known = F.when(F.col("changePct").isNotNull(), F.struct("changePct", "symbol"))
    return rows.filter(F.col("sector").isNotNull()).groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), up.alias("adv"), down.alias("dec"),
        (F.count(F.lit(1)) - up - down).alias("flat"),
        F.median("changePct").alias("today"), F.median("signal_score").alias("score"),
        F.max_by("symbol", known).alias("best"), F.min_by("symbol", known).alias("worst"))


def index_performance(index_bars: DataFrame, market: DataFrame, min_bars: int = 61) -> DataFrame:
    """Returns over 1/5/20/60 sessions on the newest bar of each index, and minus the market's.

    ``index_bars`` is (symbol = index, date, c); an index needs 61 bars, and so does the market.
    """
    spans = (1, 5, 20, 60)

    def newest(bars: DataFrame) -> DataFrame:
        rows = bars.select(
            "symbol", "date", b.bar_number().alias("n"), b.is_last_bar().alias("is_last"),
            *[b.session_return(k).alias(f"ret_{k}d") for k in spans], b.above_average(50).alias("above_50dma"))
        return rows.filter("is_last").drop("is_last")

    m = newest(market.withColumn("symbol", F.lit("market"))).filter(F.col("n") >= min_bars)
    one_row = m.agg(F.first(F.struct(*[f"ret_{k}d" for k in spans]))).scalar()
    return newest(index_bars).filter(F.col("n") >= min_bars).withColumn("_m", one_row).select(
        F.col("symbol").alias("index_name"), F.col("date").alias("as_of"), *[f"ret_{k}d" for k in spans],
        F.when(F.col("n") >= 50, F.col("above_50dma")).alias("above_50dma"),
        *[(F.col(f"ret_{k}d") - F.col("_m")[f"ret_{k}d"]).alias(f"rel_{k}d") for k in spans])


def stock_returns(bars: DataFrame, spans: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Percent returns on the newest bar and the number of bars, per symbol."""
    rows = bars.select("symbol", b.bar_number().alias("bars"), b.is_last_bar().alias("is_last"),
                       *[(b.session_return(k) * 100).alias(f"own_{k}") for k in spans])
    return rows.filter("is_last").drop("is_last")


def sector_trend(stocks: DataFrame, index_rows: DataFrame, market_returns: dict[int, Column] | None = None,
                 spans: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Sector return minus the market's: from its own stocks if enough of them have history, else its index.

    ``stocks`` has sector, bars, own_k and the market's m_k (a fraction); ``index_rows`` has sector, index_name, rel_k.
    """
    long = F.col("bars") > 61
    agg = stocks.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(long).alias("with_history"),
        *[F.median(F.when(long, F.col(f"own_{k}"))).alias(f"own_{k}") for k in spans],
        *[F.first(f"m_{k}", ignorenulls=True).alias(f"m_{k}") for k in spans])
    own = F.col("with_history") >= F.greatest(F.lit(3.0), F.col("n") * 0.5)
    joined = agg.join(index_rows, "sector", "left")
    return joined.select(
        "sector", "n", "with_history",
        *[F.when(own, F.col(f"own_{k}") - F.col(f"m_{k}") * 100).otherwise(F.col(f"rel_{k}d") * 100).alias(f"rel{k}")
          for k in spans],
        F.when(own, F.concat(F.lit("median of "), F.col("with_history"), F.lit(" stocks")))
        .when(F.col("index_name").isNotNull(), F.concat("index_name", F.lit(" index (proxy)"))).alias("trend_source"),
        (~own & F.col(f"rel_{spans[0]}d").isNotNull()).alias("proxy"))


def sector_order(metric: str) -> list[Column]:
    """Groups under three stocks last, then the metric from high to low. 'breadth' is the rising share."""
    value = ratio(F.col("adv"), F.col("n")) if metric == "breadth" else F.col(metric)
    return [(F.col("n") < 3).asc(), value.desc_nulls_last()]
