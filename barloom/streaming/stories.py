"""Rolling news: stories as connected components that grow, merge and are retired while items come in.

A batch is compared with itself and with the stored items of the days around it, not with all items. What it links joins the stored
stories of those items, so a chain may be longer than any look-back. When stories merge, the one with the smallest id stands for all;
the others are written as retired, and their ids point to it.

Three tables lie below one folder, each with a partition per batch, so a batch that runs again replaces itself:

* ``items``: the items with the story they got when they came (also by day, so that only days near a batch are read),
* ``aliases``: a replaced story and the one that stands for it now; the newest row of a story counts,
* ``stories``: the new state of each story that a batch touched; the newest row of a story counts, unless it is retired.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import text_events as te
from barloom.operators.dedup import DAY_H, Corpus, story_links
from barloom.operators.linking import connected_components
from barloom.session import stage, unstage

ITEM = "item_id long, title string, source string, ts timestamp"
TABLES = {
    "items": f"{ITEM}, label long, batch_id int, day long",
    "aliases": "label long, story long, batch_id int",
    "stories": f"story long, live boolean, {ITEM}, tier int, copies long, sources array<string>, batch_id int",
}


def read(spark: SparkSession, out: str, name: str, before: int | None = None) -> DataFrame:
    """A table as it was before a batch; empty while nothing is written."""
    try:
        saved = spark.read.schema(TABLES[name]).parquet(f"{out}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], TABLES[name])
    return saved if before is None else saved.filter(F.col("batch_id") < before)


def newest_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("label").agg(F.max_by("story", "batch_id").alias("story"))


def resolved(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items with the story that stands for theirs now."""
    now = newest_aliases(aliases).withColumnRenamed("story", "now")
    return items.join(now, "label", "left").withColumn("story", F.coalesce("now", "label")).drop("now", "label")


def newest_stories(stories: DataFrame) -> DataFrame:
    """The newest row of each story, retired ones too."""
    row = F.struct(*[c for c in stories.columns if c not in ("story", "batch_id")])
    return stories.groupBy("story").agg(F.max_by(row, "batch_id").alias("r")).select("story", "r.*")


def live_stories(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """One row per story: its representative (best source, then newest), number of copies and the other sources, sorted."""
    rows = newest_stories(read(spark, out, "stories", before)).filter("live")
    return rows.select("story", "item_id", "title", "source", "ts", "copies", F.array_sort(
        F.array_except("sources", F.array("source"))).alias("related_sources"))


def story_of_items(spark: SparkSession, out: str) -> DataFrame:
    """(item_id, story) of all items seen."""
    return resolved(read(spark, out, "items"), read(spark, out, "aliases")).select("item_id", "story")


def _merged(rows: DataFrame) -> DataFrame:
    """Rows (root and the columns of a story) added up per root."""
    item = F.struct("item_id", "title", "source", "ts", "tier")
    best = F.struct(-F.col("tier"), -F.unix_micros("ts"), F.col("item_id"))
    return rows.groupBy(F.col("root").alias("story")).agg(
        F.min_by(item, best).alias("r"), F.sum("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources")).select(
        "story", F.lit(True).alias("live"), "r.*", "copies", "sources")


def rolling_stories(out: str, aliases: DataFrame, corpus: Corpus, window_h: float = DAY_H,
                    stop: Sequence[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step over items (item_id, title, source, ts); an item that came before is not taken again.

    Similarities are weighted by ``corpus``, so a pair is judged alike whenever it meets. After every batch the stories equal those of
    ``dedup.story_links`` over all items seen.
    """
    day = F.floor(F.unix_timestamp("ts") / (window_h * 3600))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def save(df: DataFrame, name: str, *by: str) -> None:
            (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id", *by).parquet(f"{out}/{name}"))

        items, renames = read(spark, out, "items", batch_id), read(spark, out, "aliases", batch_id)
        came = batch.select("item_id", "title", "source", "ts").filter("ts is not null").dropDuplicates(["item_id"]).withColumn("day", day)
        days = stage(came.select(F.explode(F.array(*[F.col("day") + k for k in (-1, 0, 1)])).alias("day")).distinct(), "days")
        near = stage(resolved(items.join(days, "day", "left_semi").drop("batch_id"), renames), "near")
        new = stage(came.join(near, "item_id", "left_anti"), "new")
        both = near.select("item_id", "title", "source", "ts", "story").unionByName(
            new.select("item_id", "title", "source", "ts", F.col("item_id").alias("story")))
        hours = (F.unix_micros("ts") / 3.6e9).alias("hours_ago")
        links = story_links(both.select("item_id", "title", "source", hours), aliases, window_h, stop, corpus=corpus)
        grouped = stage(links.withColumnRenamed("story", "local").join(both.select("item_id", "story"), "item_id"), "grouped")
        lowest = grouped.groupBy("local").agg(F.min("story").alias("low"))
        edges = grouped.join(lowest, "local").filter("story <> low").select(F.col("story").alias("a"), F.col("low").alias("b")).distinct()
        touched = grouped.select(F.col("story").alias("node")).distinct()
        root = stage(connected_components(touched, edges).select(F.col("node").alias("was"), F.col("label").alias("root")), "roots")

        own = new.join(root, F.col("item_id") == F.col("was")).drop("was")
        stored = newest_stories(read(spark, out, "stories", batch_id)).filter("live")
        changed = root.filter("was <> root").select("root").union(own.select("root")).distinct()
        merging = stage(stored.join(root, F.col("story") == F.col("was")).join(changed, "root", "left_semi"), "merging")
        named = F.when(F.coalesce("source", F.lit("")) != "", F.array("source")).otherwise(F.array().cast("array<string>"))
        singles = own.select("root", "item_id", "title", "source", "ts", te.source_tier(F.col("source")).cast("int").alias("tier"),
                             F.lit(1).cast("long").alias("copies"), named.alias("sources"))
        grown = _merged(merging.select(*singles.columns).unionByName(singles))
        retired = merging.filter("was <> root").select("story", F.lit(False).alias("live"), "item_id", "title", "source", "ts", "tier", "copies", "sources")
        moved = retired.select(F.col("story").alias("label")).join(root, F.col("label") == F.col("was")).select("label", F.col("root").alias("story"))
        earlier = newest_aliases(renames).join(root.filter("was <> root"), F.col("story") == F.col("was")).select("label", F.col("root").alias("story"))

        # a day's items together, or every task would write a file for each day
        save(own.withColumn("label", F.col("root")).select("item_id", "title", "source", "ts", "label", "day").hint("rebalance", "day"), "items", "day")
        save(moved.unionByName(earlier), "aliases")
        save(grown.unionByName(retired), "stories")
        for old in (days, near, new, grouped, root, merging):
            unstage(old)

    return step
