"""Events of all companies with their summaries, and the news feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators import dedup, events, screen
from barloom.session import stage


def company_events(filings: DataFrame, news: DataFrame, bars: DataFrame, now: Column, days: int = 45,
                   include_routine: bool = False, history_days: int = 400) -> tuple[DataFrame, DataFrame]:
    """(scored items, summary per company) over filings and news of the last ``days`` (7 to 365).

    Price moves come from the bars of the last ``history_days``.
    """
    last = F.to_date(now)
    bars = bars.filter(F.col("date").between(F.date_sub(last, history_days), last))
    span = screen.look_back_days(days)
    both = screen.union_all(filings, news.withColumn("source_type", F.coalesce("source_type", F.lit("media"))))
    recent = both.filter((F.col("ts") >= now - F.expr(f"INTERVAL {span} DAYS")) & (F.col("ts") <= now))
    items = stage(events.analyse(recent, bars))
    shown = items if include_routine else items.filter("event_type <> 'routine'")
    return shown, events.summarise(shown, now)


def news_feed(headlines: DataFrame, aliases: DataFrame, max_age_h: float = 720, window_h: float = 24,
              stop: Sequence[str] | None = None) -> DataFrame:
    """United headlines: exact titles once, old ones dropped, one article per story, newest first.

    ``headlines``: item_id (arrival order), title, source, hours_ago and whatever else is to be kept.
    """
    unique = screen.recency_buckets(screen.distinct_titles(headlines, ["item_id"]), max_age_h)
    return dedup.dedupe_articles(stage(unique), aliases, window_h, stop).orderBy("hours_ago", "item_id")
