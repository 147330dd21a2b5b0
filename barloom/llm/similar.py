"""Near-dedup of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

A 64-bit SimHash cannot stand for this: pairs of 0.8 differ in about ten bits. So documents meet by MinHash: BANDS keys of ROWS
minima each, where a pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. Whatever meets is
compared by the exact Jaccard similarity of its shingles (as 64-bit hashes), so no link is below the bound.

Pairs of a key are looked at in two rounds. First every member is compared with a few centres of its key, the same ones for most keys
of a dense group; this joins nearly all of such a group with a few comparisons a member. Members that are still apart from the component most
common in one of their keys are compared with its middle member (``to_nearest``), or each of them would meet all of a dense group.

MinHash and SimHash may miss a pair, so a search follows that loses none, over all documents and not only those that share a key. A document
of n shingles has at most 0.2 n that a partner lacks. So of its shingles in a fixed slice of the hashes (``SLICE`` of them), all but 0.2 n
have to stand in a document of another component too, or it has no partner there (``reaching``). What is left is searched without forming all
pairs. Three bounds, all lossless, stand before a pair:

* prefixes: with shingles in one order (rare ones first), a pair of 0.8 shares a shingle among the first n - ceil(0.8 n) + 1 of the
  larger set and among the first n - ceil(2 * 0.8 / 1.8 * n) + 1 of the smaller one, so members that have only a common passage in
  common never meet;
* places: sets that meet at places i and j have at most 1 + min(rest behind i, rest behind j) shingles in common;
* pivot tables: the Jaccard distances of each set to a set of each of the largest groups are stored; the distance obeys the triangle
  inequality, so two sets whose distances to any pivot differ by more than 0.2 are no pair.

Each set also has a SimHash fingerprint of WIDE bits (bit i is set if it is set in more than half of the shingles' hashes), on a table with its
Hamming distances to pivots, fingerprints of the largest groups. A pair that meets is discarded where the distances to any pivot differ by more
than RADIUS (triangle inequality), then where its fingerprints do; only survivors get to the exact comparison. This holds for centres and
middle members; pairs of the search are all compared, so what fingerprints set aside wrongly comes back there. Sets of similarity 0.8 have a
cosine of 0.889 at least and differ in 0.152 * WIDE bits, 39 of 256 with a deviation of 5.7, so RADIUS = 80 lies seven deviations above them,
and six below the 128 of unlike sets. Sets of fewer than TINY shingles have too few votes a bit for that and are compared as they are.

Documents with equal shingle sets are one node. Fewer than five words are one shingle; texts without words are equal to each other.
Null ids are larger than all others; repeated rows leave one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.components import components
from barloom.llm.simhash import SEED, first_of_group
from barloom.session import stage, unstage

SHINGLE_WORDS = 5
#: The least similarity in hundredths.
SIMILAR = 80
BANDS = 20
ROWS = 5
CENTRES = 3
#: Sets to which distances are stored.
PIVOTS = 16
#: Bits of a fingerprint, the distance over which a pair is discarded, and the shingles under which none is.
WIDE, RADIUS, TINY = 256, 80, 32

#: Share of all hashes that lies in the slice by which documents without a partner are found; above 1 - SIMILAR / 100.
SLICE = 0.3

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words are those of ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[min(shingle_words, len(words)) - 1:] - 1).tolist())], np.uint64))


_LANES = _RANDOM.integers(0, 1 << 63, WIDE // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE bits as signed longs: bit i is set if it is set in more than half of the hashes; no hashes give zero."""
    out = []
    for factor in _LANES:
        mixed = hashes * factor
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        lanes = (mixed ^ (mixed >> np.uint64(29))).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def away_bits(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, WIDE // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)).astype(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band; a bounded block of shingles is hashed at a time."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i:i + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    return [int(np.uint64(xxhash.xxh64_intdigest(band.astype("<u8").tobytes(), SEED + 1 + i)).astype(np.int64))
            for i, band in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, keys, fp, part) per row, part being the shingles in the slice; stored."""
    upto = np.uint64(int(SLICE * 2 ** 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t.as_py()) for t in batch["text"])
            rows = [(node_of(s), len(s), band_keys(s), wide_fingerprint(s), s[:np.searchsorted(s, upto)].astype(np.int64)) for s in sets]
            types = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], ["doc_id", "node", "size", "keys", "fp", "part"])

    schema = "doc_id long, node long, size long, keys array<long>, fp array<long>, part array<long>"
    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "sketches")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles), one row per node; stored. A batch holds few rows, as sets are as large as their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py()) for t in batch["text"].slice(i, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()),
                                                  pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return stage(docs.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def can_be_similar(a: Column, b: Column, percent: int = SIMILAR) -> Column:
    """The smaller set of a pair has at least this share of the larger one; loses nothing."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the bound."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    held = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return held.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def pivot_table(nodes: DataFrame, pivots: list[int]) -> DataFrame:
    """(node, size, fp, near): the distances of each fingerprint of (node, size, fp) to those of the pivot nodes; stored."""
    refs = [r["fp"] for r in nodes.filter(F.col("node").isin(pivots)).select("fp").collect()]
    ref = lambda fp: F.array(*[F.lit(x).cast("long") for x in fp])
    near = F.array(*[away_bits(F.col("fp"), ref(fp)) for fp in refs]) if refs else F.array().cast("array<int>")
    return stage(nodes.select("node", "size", "fp", near.alias("near")), "pivots")


def not_discarded(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither the pivot table nor their fingerprints exclude."""
    side = lambda x: table.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("size", "fp", "near")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.exists(F.zip_with("a_near", "b_near", lambda x, y: F.abs(x - y)), lambda d: d > RADIUS)
    return both.filter((F.least("a_size", "b_size") < TINY) | (~apart & (away_bits(F.col("a_fp"), F.col("b_fp")) <= RADIUS))).select("a", "b")


def across(left: DataFrame, sets: DataFrame, pivots: list[int], percent: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes of different roots in ``left`` (node, size, root) that no bound excludes; ``pivots`` are nodes of ``sets``."""
    tokens = stage(left.join(sets, "node").select("node", "size", "root", F.explode("shingles").alias("token")), "tokens")
    references = sets.filter(F.col("node").isin(pivots)).select("node", F.size("shingles").alias("size"), "shingles")
    sizes = {r["node"]: r["size"] for r in references.select("node", "size").collect()}
    bit = F.lit(0)
    for i, node in enumerate(sizes):
        bit = F.when(F.col("node") == node, F.lit(1 << i)).otherwise(bit)
    known = tokens.select("token", F.lit(1).alias("n"), F.lit(0).alias("bits")).union(
        references.select(F.explode("shingles").alias("token"), F.lit(0).alias("n"), bit.cast("int").alias("bits"))).groupBy("token").agg(
        F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).filter("n > 1 or bits <> 0")

    order = F.sort_array(F.collect_list(F.struct(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"), "token")))
    common = [F.sum(F.when(F.col("bits").bitwiseAND(1 << i) != 0, 1).otherwise(0)).alias(f"with_{i}") for i in range(len(sizes))]
    away = F.array(*[1 - F.col(f"with_{i}") / (F.col("size") + n - F.col(f"with_{i}")) for i, n in enumerate(sizes.values())])
    probing = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    indexed = F.col("size") - F.ceil(F.col("size") * (2 * percent / (100 + percent)) - 1e-9) + 1
    ranked = tokens.join(known, "token", "left").groupBy("node", "size", "root").agg(order.alias("order"), *common)
    first = ranked.select("node", "size", "root", indexed.alias("indexed"), away.alias("away"), F.slice("order", F.lit(1), probing.cast("int")).alias("first"))
    prefix = stage(first.select("node", "size", "root", "indexed", "away", F.posexplode("first").alias("at", "shingle")).filter("shingle.n > 1").select(
        "node", "size", "root", "indexed", "away", "at", F.col("shingle.token").alias("token")), "prefixes")

    x, y = prefix.alias("x"), prefix.filter("at < indexed").alias("y")                 # x is the larger set
    larger = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") > F.col("y.node")))
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    enough = (100 + percent) * rest >= percent * (F.col("x.size") + F.col("y.size"))
    near = F.lit(True)
    for i in range(len(sizes)):
        near = near & (F.abs(F.col("x.away")[i] - F.col("y.away")[i]) <= 1 - percent / 100 + 1e-9)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & larger & (F.col("x.root") != F.col("y.root"))
                   & can_be_similar(F.col("x.size"), F.col("y.size"), percent) & enough & near)
    out = stage(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "across")
    for old in (tokens, prefix):
        unstage(old)
    return out


def divided(met: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, size, root) of the members of keys that hold different components, and (node, size, root) of these members; both stored."""
    named = met.select("key", "node", "size").join(joined, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    parts = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    named = stage(named.join(parts, "key", "left_semi"), "named")
    return named, stage(named.groupBy("node").agg(F.first("size").alias("size"), F.first("root").alias("root")), "left")


def reaching(rows: DataFrame, joined: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(node, size, root) of all nodes of the sketches ``rows`` that can have a partner in another component of ``joined``; stored.

    Counted on the shingles of the slice, which are the same ones in all sets: of those a partner lacks no more than of the whole set.
    """
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("part").alias("part"))
    rooted = nodes.join(joined, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), "part")
    of_token = Window.partitionBy("token")
    tokens = rooted.select("node", "root", F.explode("part").alias("token"))
    other = tokens.select("node", F.min("root").over(of_token).alias("low"), F.max("root").over(of_token).alias("high")).filter("low < high")
    shared = other.groupBy("node").agg(F.count("*").alias("shared"))
    lacking = F.floor(F.col("size") * (100 - percent) / 100)
    found = rooted.select("node", "size", "root", F.size("part").alias("n")).join(shared, "node", "left")
    return stage(found.filter(F.coalesce("shared", F.lit(0)) >= F.col("n") - lacking).select("node", "size", "root"), "reaching")


def to_nearest(named: DataFrame, left: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of each node and the middle member of the component that is most common in one of its keys, if it is another one.

    A component's core is what most of its members hold. Where two sets differ from a core in different shingles, they have as many in common
    as their own differences leave of it, so a node that is linked with such a member is linked with the one for which 80 size - 180 common
    is least too. Single comparisons thus join what would meet each member of a dense group. At most one pair a key.
    """
    large = left.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > CENTRES)
    tokens = left.join(large, "root").join(sets, "node").select("root", "members", "node", "size", F.explode("shingles").alias("token"))
    core = tokens.groupBy("root", "token").agg(F.count("*").alias("n"), F.first("members").alias("members")).filter("2 * n > members").select("root", "token")
    held = tokens.join(core, ["root", "token"]).groupBy("root", "node", "size").agg(F.count("*").alias("common"))
    weight = SIMILAR * F.col("size") - (100 + SIMILAR) * F.col("common")
    middle = held.groupBy("root").agg(F.min_by(F.struct("node", "size"), F.struct(weight, "node")).alias("c"))
    common = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    pairs = named.join(common, "key").filter(F.col("root") != F.col("most")).select("node", "size", F.col("most").alias("root")).distinct().join(
        middle, "root").filter(can_be_similar(F.col("size"), F.col("c.size")))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are linked with others, given the sketches ``rows`` of ``docs``."""
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "size", "first")
    centre = [F.min_by(F.struct("node", "size"), F.xxhash64(F.lit(i), "node")).alias(f"c{i}") for i in range(CENTRES)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), *centre).filter("n > 1")
    met = stage(keyed.join(shared, "key"), "met")

    ids = met.select(F.col("first").alias("id")).distinct()
    sets = shingle_sets(docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi"))
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    near = met.select("node", "size", F.explode(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("c")).filter(
        (F.col("node") != F.col("c.node")) & can_be_similar(F.col("size"), F.col("c.size")))
    groups = shared.orderBy(F.desc("n"), "key").limit(PIVOTS).select("c0.node")
    table = pivot_table(nodes.join(met.select("node").distinct(), "node", "left_semi"), [r["node"] for r in groups.collect()])
    pairs = near.select(*ordered(F.col("node"), F.col("c.node"))).distinct()
    found = stage(verified(not_discarded(pairs, table), sets), "links")

    joined = stage(components(found), "joined")
    named, left = divided(met, joined)
    middle = stage(verified(not_discarded(to_nearest(named, left, sets), table), sets), "links")
    if not middle.isEmpty():
        found = found.union(middle)
        for old in (named, left):
            unstage(old)
        joined = stage(components(found), "joined")
        named, left = divided(met, joined)
    largest = named.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(PIVOTS)
    pivots = [r["root"] for r in largest.collect()]
    for old in (met, table, named, left):
        unstage(old)

    open_ = reaching(rows, joined)
    known = sets.select("node")
    more_ids = open_.join(known, "node", "left_anti").join(nodes.select("node", "first"), "node").select(F.col("first").alias("id")).distinct()
    rest = shingle_sets(docs.join(more_ids, docs["doc_id"].eqNullSafe(more_ids["id"]), "left_semi"))
    every = sets.union(rest.join(known, "node", "left_anti"))
    out = components(found.union(verified(across(open_, every, pivots), every)))
    for old in (sets, rest, open_):
        unstage(old)
    return out


def similar_copies(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, component_id (smallest doc_id of its component)."""
    rows = sketches(docs)
    label = rows.select("doc_id", F.col("node").alias("own")).join(links(docs, rows), F.col("own") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "own").alias("root"))
    label = stage(label, "labels")
    smallest = label.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return label.join(smallest, F.col("root") == F.col("of")).select("doc_id", "component_id")


def without_similar(docs: DataFrame) -> DataFrame:
    """The documents that stand for their group (smallest doc_id), with all their columns; repeated rows leave one."""
    return first_of_group(docs, similar_copies(docs.select("doc_id", "text")))
