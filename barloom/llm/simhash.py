"""SimHash near-dedup with pivot distance tables.

Fingerprints are made per text. Equal ones are one class; the search runs over distinct fingerprints only. A table holds each
one's Hamming distances to a set of reference fingerprints (pivots). Two fingerprints whose distances to any pivot differ by more
than the radius cannot be within it (triangle inequality), so such pairs are discarded by their largest coordinate difference,
and only survivors are compared bit by bit.

The tables discard pairs but do not say which pairs to look at, and looking at all is quadratic. So fingerprints first meet by
equal parts: of k parts at least k - radius are untouched in a close pair, so a pair meets under some choice of k - radius equal
parts (lossless). Where more than HOT meet under one choice - the lightly edited copies of one template - the bits outside the choice
are cut into parts in the same way, and members meet there under more equal parts only (lossless as well), so a task never holds such a
group. Where many meet, no pairs are formed: one after the other takes all that are close to it out of the rest, and a
spanning forest of the links is all that is emitted.

Null and empty texts have fingerprint zero and are linked like any other; very long texts are read whole. Null ids are larger than all
others; repeated rows are nodes of their own. An empty table gives no rows; extra columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import packed
from barloom.llm.components import components
from barloom.session import stage

SHINGLE_WORDS = 4
RADIUS = 4
PIVOTS = 16
SEED = 42
#: Fingerprints that may be expected to meet by chance under one choice of parts.
MEETING = 64

#: Fingerprints that may meet under one choice of parts before it is refined, and the parts the other bits are cut into then.
HOT, FINE = 4096, 8

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes; no words give zero.

    bytes.lower and bytes.split know ASCII letters and ASCII white space only, as the contract has it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1:] - 1).tolist())], "<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(lanes[:, k], minlength=256) @ _BITS
        for i in np.flatnonzero(2 * ones > n).tolist():
            out |= 1 << (8 * k + i)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row, fp as a signed long; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch["text"]], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return stage(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long"), "fingerprints")


def pivot_table(fp: Column, pivots: int = PIVOTS) -> Column:
    """Distances to the pivots; these are the SEED-ed hashes of their numbers, the same on every run."""
    refs = [np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64).item() for i in range(pivots)]
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("tinyint") for r in refs])


def scheme(n: int, radius: int, meeting: int = MEETING) -> tuple[list[int], int]:
    """(part masks, parts that must be equal): the fewest parts under which n random fingerprints meet in small numbers."""
    for parts in range(radius + 1, 2 * radius + 3):
        equal = parts - radius
        edges = [round(64 * i / parts) for i in range(parts + 1)]
        masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
        if n / 2 ** (64 * equal / parts) <= meeting:
            break
    return masks, equal


def refinements(mask: int, radius: int, fine: int = FINE) -> list[int]:
    """Masks over the bits outside ``mask`` of which two fingerprints within the radius agree on one at least."""
    free, fine = [b for b in range(64) if not mask >> b & 1], max(fine, 2 * radius)
    edges = [round(len(free) * i / fine) for i in range(fine + 1)]
    parts = [sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(parts, fine - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over all pairs within the radius; every one is a link of the input."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            lo, hi = np.searchsorted(table[left, 0], [table[x, 0] - radius, table[x, 0] + radius + 1])
            near = left[lo:hi]
            near = near[np.abs(table[near] - table[x]).max(axis=1) <= radius] if len(near) else near
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if len(near):
                a += [int(fps[x].astype(np.int64))] * len(near)
                b += fps[near].astype(np.int64).tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
                front += near.tolist()
    return a, b


def links(distinct: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS, meeting: int = MEETING, hot: int = HOT) -> DataFrame:
    """(a, b) over distinct fingerprints: links within the radius that connect whatever is connected."""
    masks, equal = scheme(distinct.count(), radius, meeting)
    fp = F.col("fp")
    chosen = [sum(some) for some in combinations(masks, equal)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))).alias("key")) for i, m in enumerate(chosen)])
    rows = distinct.select(F.explode(keys).alias("k"), "fp").select("k.*", "fp")
    crowded = stage(rows.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    if not crowded.isEmpty():
        finer = F.array().cast("array<bigint>")
        for i, m in enumerate(chosen):
            finer = F.when(F.col("choice") == i, F.array(*[F.xxhash64(F.lit(j), "key", fp.bitwiseAND(F.lit(_signed(x)))) for j, x in enumerate(
                refinements(m, radius))])).otherwise(finer)
        rows = rows.join(crowded, "key", "left_anti").select("key", "fp").union(
            rows.join(crowded, "key", "left_semi").select(F.explode(finer).alias("key"), "fp"))
    met = rows.select("key", "fp", pivot_table(fp, pivots).alias("near")).repartition("key").sortWithinPartitions("key")

    def solve(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, out: tuple[list, list]) -> None:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            a, b = forest(fps[s:e], table[s:e], radius)
            out[0].extend(a)
            out[1].extend(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch["key"].to_numpy()
            f = batch["fp"].to_numpy().astype(np.uint64)
            t = batch["near"].flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots)
            last = int(np.searchsorted(k, k[-1]))                      # the last key may go on in the next batch
            out: tuple[list, list] = ([], [])
            if last:
                kept.append((k[:last], f[:last], t[:last]))
                solve(*[np.concatenate(x) for x in zip(*kept)], out)
                kept = []
            kept.append((k[last:], f[last:], t[last:]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
        if kept:
            out = ([], [])
            solve(*[np.concatenate(x) for x in zip(*kept)], out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    See the module for nulls, empty texts and repeated rows.
    """
    rows = fingerprints(docs, shingle_words)
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(distinct, radius))
    label = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    label = stage(label, "labels")
    smallest = label.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    known = stage(label.join(smallest, F.col("root") == F.col("of")).select(F.col("fp").alias("known_fp"), "component_id"), "known")
    return rows.join(known, F.col("fp") == F.col("known_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents whose doc_id is the component_id ``found`` for them; repeated rows leave one."""
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").withColumn(
        "nth", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row")))).filter("nth = 1").select("row.*")


def without_near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents that stand for their group (smallest doc_id), with all their columns; repeated rows leave one."""
    return first_of_group(docs, near_copies(docs.select("doc_id", "text"), shingle_words, radius))
