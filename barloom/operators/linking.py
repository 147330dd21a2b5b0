"""Building blocks to link similar items without ever forming all pairs of a group.

``first_at_or_after``   earliest row of a key from a time on, split by time blocks
``token_set_pairs``     pairs of distinct token sets with a Jaccard bound, by prefix filtering (lossless)
``close_vectors``       pairs of vectors above a cosine within a day, by bounded matrix blocks (exact)
``follow_to_root``      ends of parent chains, by pointer jumping
``connected_components`` smallest label per component
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.session import stage, unstage

HOUR = 3_600_000_000                       # microseconds
DAY = 24 * HOUR


def first_at_or_after(probes: DataFrame, candidates: DataFrame, block: int = 6 * HOUR) -> DataFrame:
    """For each probe (key, item_id, t, from_t) the earliest candidate (key, t, item_id) with t >= from_t.

    Two steps keep every window small: inside the probe's own time block, and over one row per later block.
    A key with most of the rows is thereby spread over its blocks. Result: probe columns and ``hit`` (t, id).
    """
    blk = lambda c: F.floor(F.col(c) / block).alias("blk")
    hit = F.struct(F.col("t").alias("t"), F.col("item_id").alias("id"))
    none = F.lit(None)
    rows = candidates.select(
        "key", blk("t"), F.col("t").alias("at"), F.lit(0).alias("kind"), hit.alias("hit"), F.col("item_id").alias("order_id"),
        none.cast("long").alias("item_id"), none.cast("long").alias("t"))
    hit_type = rows.schema["hit"].dataType
    asks = probes.select(
        "key", blk("from_t"), F.col("from_t").alias("at"), F.lit(1).alias("kind"), none.cast(hit_type).alias("hit"),
        none.cast("long").alias("order_id"), "item_id", "t")
    near = Window.partitionBy("key", "blk").orderBy(F.desc("at"), "kind", F.desc("order_id")).rowsBetween(
        Window.unboundedPreceding, 0)
    inside = rows.unionByName(asks).withColumn("hit", F.last("hit", ignorenulls=True).over(near)).filter("kind = 1").select(
        "key", "blk", "item_id", "t", "hit")

    heads = candidates.groupBy("key", blk("t")).agg(F.min(hit).alias("hit")).select("key", "blk", F.lit(1).alias("kind"), "hit")
    asked = probes.select("key", blk("from_t")).distinct().select("key", "blk", F.lit(0).alias("kind"), none.cast(hit_type).alias("hit"))
    later = Window.partitionBy("key").orderBy(F.desc("blk"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = heads.unionByName(asked).withColumn("next", F.last("hit", ignorenulls=True).over(later)).filter("kind = 0").select(
        "key", "blk", "next")
    return inside.join(after, ["key", "blk"], "left").select(
        "key", "item_id", "t", F.coalesce("hit", "next").alias("hit"))


def follow_to_root(parents: DataFrame) -> DataFrame:
    """(item_id, root) from (item_id, parent), parent = struct(t, id): each round doubles the distance covered.

    Every round is written to the shared folder; the driver only sees whether something changed.
    """
    current = stage(parents.select("item_id", F.col("parent").alias("root")))
    while True:
        up = current.select(F.col("item_id").alias("_id"), F.col("root").alias("_up"))
        moved = current.join(up, F.col("root.id") == F.col("_id"), "left").select(
            "item_id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved"))
        moved = stage(moved)
        unstage(current)
        current = moved.select("item_id", "root")
        if moved.filter("moved").isEmpty():
            return current


#: Edges that one task joins at the end of ``connected_components``.
LAST_EDGES = 200_000


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node id of each component; ``edges`` is (a, b), both directions are used.

    Each round moves every node to the neighbour that comes first in an order drawn anew, and on to where that one moves; the edges between
    what is left are the next round's. On a path, where labels that only travel need as many rounds as it is long, at most half of the nodes
    are left. A bounded rest of edges is joined by one task. A node with very many neighbours is no single task, as minima combine before
    the shuffle. Nodes without edges keep out of the rounds; a node that comes twice has one row.
    """
    every = nodes.select("node").distinct()
    known = edges.join(every.withColumnRenamed("node", "a"), "a", "left_semi").join(every.withColumnRenamed("node", "b"), "b", "left_semi")
    both = stage(known.select("a", "b").union(known.select("b", "a")).filter("a <> b").distinct(), "edges")
    moves = []
    while (left := both.count()) > LAST_EDGES:
        drawn = lambda c: F.xxhash64(F.lit(len(moves)), c)  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min_by("b", drawn(F.col("b"))).alias("b"))
        up = stage(first.select(F.col("a").alias("node"), F.when(drawn(F.col("b")) < drawn(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("up")), "up")
        further = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        moves.append(stage(up.join(further, "up").select("node", "root"), "moves"))
        to = lambda c: moves[-1].select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
        less = both.join(to("a"), "a").join(to("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        less = stage(less.distinct(), "edges")
        unstage(both)
        unstage(up)
        both = less
    if left:
        moves.append(both.filter("a < b").groupBy().applyInPandas(_joined, "node long, root long"))
    rooted = None
    for move in reversed(moves):
        later = None if rooted is None else rooted.select(F.col("node").alias("root"), F.col("root").alias("last"))
        rooted = stage(move if later is None else move.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    for old in (both, *(moves if not left else moves[:-1])):
        unstage(old)
    if rooted is None:
        return every.select("node", F.col("node").alias("label"))
    least = rooted.groupBy("root").agg(F.min(F.least("node", "root")).alias("label"))
    return every.join(rooted.join(least, "root").select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, root): the ends of a bounded number of edges (a, b) and the smallest of their component."""
    root = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(edges.a.tolist(), edges.b.tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ends = list(root)
    return pd.DataFrame({"node": ends, "root": [find(x) for x in ends]})


# ---- token sets ------------------------------------------------------------------------------------

MAX_HOT = 100_000


def with_frequency(exploded: DataFrame, freq: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """Adds the frequency columns of each key value; frequent keys do not meet in one task.

    Keys that make up at least 1/100,000 of all rows are at most 100,000 in number whatever the size of the
    data, so that list is broadcast; the rest, none of them frequent, is joined by shuffle.
    """
    total = freq.agg(F.sum(count)).scalar()
    hot = freq.filter(F.col(count) * MAX_HOT >= total)
    cold = freq.filter(F.col(count) * MAX_HOT < total)
    extra = [c for c in freq.columns if c not in ([key] if isinstance(key, str) else key)]
    marked = exploded.join(F.broadcast(hot), key, "left")
    done = marked.filter(F.col(count).isNotNull())
    rest = marked.filter(F.col(count).isNull()).drop(*extra).join(cold, key)
    return done.unionByName(rest)


def ordered_tokens(members: DataFrame, within: list[str]) -> DataFrame:
    """(within..., sig, ordered): the tokens of each set (within..., sig, tokens), the rare ones of its group first.

    A word that is rare overall may stand in every set of one group (a company's own name); there it comes last.
    """
    exploded = members.select(*within, "sig", F.explode("tokens").alias("token"))
    freq = exploded.groupBy(*within, "token").agg(F.count(F.lit(1)).alias("df"))
    ranked = with_frequency(exploded, freq, [*within, "token"], "df")
    return ranked.groupBy(*within, "sig").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ordered"))


def token_set_pairs(places: DataFrame, sets: DataFrame, scope: list[str], threshold: float,
                    within: list[str] | None = None) -> DataFrame:
    """Pairs (scope..., p_sig, c_sig) of different token sets with Jaccard >= threshold.

    ``sets`` is (sig, tokens), one row per distinct set, so copies are compared once however many there are.
    ``places`` says where a set occurs: scope columns, sig and role ('p' asks, 'c' answers).
    Two such sets share a token among the first n - ceil(threshold*n) + 1 of each, in any order that both sides keep, so only
    those are joined. ``within`` is a part of the scope: tokens are ranked by their frequency there (default: the whole scope).
    At the first token they share, the tokens behind it bound the overlap from above; joined tokens whose bound is too low go
    before the pairs are made distinct.
    """
    within = scope if within is None else within
    members = places.select(*within, "sig").distinct().join(sets, "sig")
    size = F.size("ordered")
    prefix = ordered_tokens(members, within).select(*within, "sig", size.alias("size"), F.posexplode(F.slice(
        "ordered", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))).alias("at", "token")).withColumn(
        "behind", F.col("size") - F.col("at") - 1)
    spread = places.join(prefix, [*within, "sig"])
    side = lambda role: spread.filter(F.col("role") == role).select(
        *scope, "token", *[F.col(x).alias(f"{role}_{x}") for x in ("sig", "size", "behind")])
    both = F.col("p_size") + F.col("c_size")
    maybe = side("p").join(side("c"), [*scope, "token"]).filter(
        (F.col("p_sig") != F.col("c_sig"))
        & (F.least("p_size", "c_size") >= threshold * F.greatest("p_size", "c_size") - 1e-9)
        & (F.least("p_behind", "c_behind") + 1 >= threshold / (1 + threshold) * both - 1e-9)
    ).select(*scope, "p_sig", "c_sig").distinct()
    # similarity is a matter of the two sets, not of the place: compare each pair once
    pairs = maybe.select(F.least("p_sig", "c_sig").alias("s1"), F.greatest("p_sig", "c_sig").alias("s2")).distinct()
    t1 = sets.select(F.col("sig").alias("s1"), F.col("tokens").alias("t1"))
    t2 = sets.select(F.col("sig").alias("s2"), F.col("tokens").alias("t2"))
    shared = F.size(F.array_intersect("t1", "t2"))
    close = pairs.join(t1, "s1").join(t2, "s2").filter(
        shared / (F.size("t1") + F.size("t2") - shared) >= threshold).select("s1", "s2")
    return maybe.withColumns({"s1": F.least("p_sig", "c_sig"), "s2": F.greatest("p_sig", "c_sig")}).join(
        close, ["s1", "s2"]).select(*scope, "p_sig", "c_sig")


# ---- vectors ------------------------------------------------------------------------------------------

CHUNKS, CHUNK_ROWS = 12, 30_000


def close_vectors(items: DataFrame, threshold: float, window_h: float = 24.0, block_rows: int = 2000) -> DataFrame:
    """Pairs (a < b, sim) of unit vectors with cosine >= threshold that lie at most ``window_h`` hours apart.

    ``items`` is (node, hours, vec). A day is split into chunks; a task multiplies two chunks of the same or of neighbouring
    windows, ``block_rows`` rows of each at a time, and gives back only what passes. A row is sent to every chunk near it, so a day
    has ``CHUNKS`` of them, fewer if they would hold less than ``block_rows`` and more if they would hold over ``CHUNK_ROWS`` rows. No pair
    is lost, and up to days of CHUNKS * CHUNK_ROWS rows what is shuffled grows with the rows, not with their square.
    """
    placed = items.withColumn("day", F.floor(F.col("hours") / window_h).cast("long"))
    chunks = placed.groupBy("day").agg(F.greatest(
        F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(CHUNKS)), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS)).cast("int").alias("k"))
    near = lambda shift, name: chunks.select((F.col("day") + shift).alias("day"), F.col("k").alias(name))
    sized = placed.join(chunks, "day").join(near(-1, "k_next"), "day", "left").join(near(1, "k_prev"), "day", "left")
    mine = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here, day = F.col("chunk"), F.col("day")
    cell = lambda d1, c1, d2, c2, side: F.struct(
        d1.alias("d1"), c1.alias("c1"), d2.alias("d2"), c2.alias("c2"), F.lit(side).alias("side"))
    cells = F.concat(
        F.transform(F.sequence(here, F.col("k") - 1), lambda o: cell(day, here, day, o, 0)),
        F.transform(F.sequence(F.lit(0), here), lambda o: cell(day, o, day, here, 1)),
        F.transform(upto(F.col("k_next")), lambda o: cell(day, here, day + 1, o, 0)),
        F.transform(upto(F.col("k_prev")), lambda o: cell(day - 1, o, day, here, 1)))
    spread = mine.select("node", "hours", "vec", F.explode(cells).alias("x")).select("node", "hours", "vec", "x.*")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        v, w = (np.stack(x.vec.to_numpy()).astype(float) for x in (left, right))
        (n, h), (m, g) = ((x.node.to_numpy(), x.hours.to_numpy()) for x in (left, right))
        found = []
        for i0 in range(0, len(v), block_rows):
            for j0 in range(0, len(w), block_rows):
                rows, cols = slice(i0, i0 + block_rows), slice(j0, j0 + block_rows)
                sim = v[rows] @ w[cols].T
                i, j = np.nonzero((sim >= threshold) & (np.abs(h[rows][:, None] - g[cols][None, :]) <= window_h))
                a, b = n[rows][i], m[cols][j]
                found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sim[i, j]}))
        out = pd.concat(found, ignore_index=True)
        return out[out.a < out.b].drop_duplicates(["a", "b"])

    return spread.groupBy("d1", "c1", "d2", "c2").applyInPandas(multiply, "a long, b long, sim double")


def unit(vec: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))

