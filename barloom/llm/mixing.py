"""Mixing sources to target weights by entropy balancing.

Targets come from weights by water filling: a source stops at a multiple of its size and the excess is shared again. The rates
are the ones closest (in relative entropy) to taking each document once that meet every source's token target with no rate above
the same multiple. Their dual has one multiplier per source: rate = min(cap, exp(multiplier * tokens / mean tokens)). It is
solved by guarded Newton steps; each step is one aggregation over a histogram of (source, tokens), the multipliers are a small
table joined to it, and the driver only sees the largest error. Last, rates are rounded into whole copies.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import packed, words_of
from barloom.session import stage, unstage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Documents that are rounded together; a source of any size is dealt into so many groups that none is larger.
GROUP_ROWS = 4096


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their position by code point, null last. One row per source is sorted, not one per document."""
    return sources.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, position, target) from (source, source_size, ...).

    A source is stopped exactly if source_size / weight lies below a level; each round raises the level by the excess of the
    sources that it stops, until none more is. Sources without words get no target.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    known = stage(_ranked(sources).withColumn("weight", F.element_at(weight, (F.col("position") % len(weights) + 1).cast("int"))), "sources")
    total = share * float(known.agg(F.sum("source_size")).collect()[0][0] or 0)
    limit, level, stopped = cap * F.col("source_size"), 0.0, -1
    while True:
        below = limit < level * F.col("weight")
        now = known.agg(F.sum(F.when(below, limit)).alias("used"), F.sum(F.when(~below, F.col("weight"))).alias("open"),
                        F.count(F.when(below, 1)).alias("stopped")).collect()[0]
        if not now["open"] or now["stopped"] == stopped:
            break
        level, stopped = max(0.0, total - float(now["used"] or 0)) / now["open"], now["stopped"]
    return known.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def solved(histogram: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """(position, multiplier, mean) of the dual; ``histogram`` is (position, size, n) without sizes of 0.

    A Newton step that leaves the bracket of its source is replaced by bisection, so every source converges; one that has not after
    ``rounds`` rounds is an error. A source whose
    target is cap times its size takes every document cap times; its multiplier is infinite.
    """
    start = histogram.groupBy("position").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
                                              F.max("size").alias("largest"), F.min("size").alias("smallest"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    full = F.col("target") >= cap * F.col("source_size")
    at = F.when(full, F.lit(float("inf"))).otherwise(ratio)
    span = F.greatest(F.abs(ratio), F.lit(1.0)) * F.col("mean") / F.col("smallest") * 2
    state = stage(start.join(goals, "position").filter("target > 0").select(
        "position", "mean", "target", at.alias("multiplier"), (-span).alias("low"), (span * 20).alias("high")), "dual")
    for _ in range(rounds):
        raw = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0)))
        rate, mass = F.least(raw, F.lit(float(cap))), F.col("size") * F.col("n")
        step = histogram.join(state, "position").groupBy("position").agg(
            F.sum(mass * rate).alias("value"), F.sum(F.when(raw < cap, mass * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        error = F.col("value") - F.col("target")
        low = F.when(error < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - error / F.when(F.col("slope") > 0, F.col("slope"))
        done = F.abs(error) <= tolerance * F.col("target")
        free = F.col("multiplier") < float("inf")
        following = stage(state.join(step, "position").select(
            "position", "mean", "target", F.when(done | ~free, F.col("multiplier")).when(
                newton.isNotNull() & (newton > low) & (newton < high), newton).otherwise((low + high) / 2).alias("multiplier"),
            low.alias("low"), high.alias("high"), (done | ~free).alias("done")), "dual")
        unstage(state)
        state = following.drop("done")
        if following.filter("not done").isEmpty():
            return state.select("position", "multiplier", "mean")
    raise RuntimeError(f"a source has not reached its target after {rounds} rounds")


def _rounded(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies whose words follow the sum of the rates: from long to short, each document takes what is still owed."""
    group = group.sort_values(["size", "order", "row_id"], ascending=[False, True, True])
    copies, owed = [], 0.0
    for size, wanted, cap in zip(group["size"].tolist(), group["wanted"].tolist(), group["cap"].tolist()):
        owed += wanted
        n = min(max(int(owed / size + 0.5), 0), cap)
        owed -= n * size
        copies.append(n)
    return pd.DataFrame({"row_id": group["row_id"], "copies": copies})


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per document: row_id, doc_id, source, size, source_size, target, rate, copies.

    Null text has no words: rate and copies 1. Null is a source of its own, after all others. Repeated rows are documents of
    their own. Rounding goes by groups of (source, hash of the row): each ends within half of its last documents' size of its
    share, and no group grows with its source.
    """
    rows = stage(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"),
                             F.xxhash64("doc_id", "text").alias("order"), F.monotonically_increasing_id().alias("row_id")), "sizes")
    goals = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights,
                          share, cap), "targets")
    histogram = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    histogram = stage(histogram.join(goals, same(histogram, goals)).select("position", "size", "n"), "histogram")
    dual = stage(solved(histogram, goals, cap), "multipliers")
    known = stage(goals.join(dual, "position", "left"), "goals")
    joined = rows.join(known, same(rows, known)).select(rows["*"], known["source_size"], known["target"], known["position"],
                                                        known["documents"], known["multiplier"], known["mean"])
    raw = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("multiplier").isNull(), 0.0).otherwise(F.least(raw, F.lit(float(cap))))
    rated = stage(joined.withColumn("rate", rate), "rates")
    part = F.pmod(F.col("order"), F.ceil(F.col("documents") / group_rows))
    copies = rated.filter("size > 0").select("row_id", "size", "order", (F.col("rate") * F.col("size")).alias("wanted"), F.lit(cap).alias("cap"),
                                             "position", part.alias("part")).groupBy("position", "part").applyInPandas(
        _rounded, "row_id long, copies int")
    return rated.join(copies, "row_id", "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "target", "rate", F.when(F.col("size") == 0, 1).otherwise(F.coalesce("copies", F.lit(0))).alias("copies"), "order")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: each as often as it has copies, with all its columns; those without words stay once.

    Rows meet their copies by doc_id and a hash of the text; repeated rows share the sum of their copies.
    """
    made = rates(docs.select("doc_id", "source", "text")).groupBy(
        F.col("doc_id").alias("made_id"), F.col("order").alias("made_order")).agg(F.sum("copies").alias("sum"), F.count("*").alias("rows"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("order"))
    met = rows.join(made, F.col("id").eqNullSafe(F.col("made_id")) & (F.col("order") == F.col("made_order")))
    nth = F.row_number().over(Window.partitionBy("id", "order").orderBy(F.xxhash64("row")))
    copies = (F.floor(F.col("sum") / F.col("rows")) + F.when(nth <= F.col("sum") % F.col("rows"), 1).otherwise(0)).cast("int")
    return met.withColumn("copies", copies).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, rate."""
    return rates(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
                              "copies", "rate")
