"""Connected components of a large graph of long ids by label rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.session import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Large-star and small-star rounds: each node hands its neighbours the smallest node it knows. Every round is stored; the
    driver only sees whether the edges changed. Nulls and loops are left out; repeated edges do no harm.
    """
    pair = stage(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high > low").distinct(), "edges")
    while True:
        both = pair.union(pair.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "next")
        best = both.groupBy("node").agg(F.min("next").alias("best"))
        best = stage(best.select("node", F.least("node", "best").alias("best")), "best")
        large = both.join(best, "node").filter("next > node").select(F.col("next").alias("high"), F.col("best").alias("low"))
        large = stage(large.union(best.filter("best < node").select(F.col("node").alias("high"), F.col("best").alias("low"))).filter("high > low").distinct(), "edges")
        least = stage(large.groupBy("high").agg(F.min("low").alias("best")), "best")
        small = large.join(least, "high").select("high", "low", "best")
        small = small.select("high", F.col("best").alias("low")).union(
            small.filter("low > best").select(F.col("low").alias("high"), F.col("best").alias("low"))).distinct()
        small = stage(small, "edges")
        moved = not (small.count() == pair.count() and small.exceptAll(pair).isEmpty())
        for old in (pair, best, large, least):
            unstage(old)
        pair = small
        if not moved:
            return pair.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                pair.select("low", "low").distinct())
