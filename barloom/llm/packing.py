"""Best-fit packing with certified bin counts.

Documents become token ids plus an end id; longer ones are cut into full sequences and one shorter first piece. Pieces are dealt
into groups of bounded size by a hash, and each group is packed by best-fit decreasing. Dual feasible functions give a lower bound
of its bins: a group whose count equals the bound is certified and final. The other groups give up the pieces of their bins that
are not full, exchange them (they are dealt anew, into fewer groups), and run best-fit decreasing again, as long as that saves bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import tokens
from barloom.session import stage

SEQUENCE = 1024
END_ID = 2
#: Pieces that are packed in one task.
GROUP_PIECES = 8192
#: Most rounds of exchange; each must save sequences.
ROUNDS = 4

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % size or size if n else 0
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Per piece: doc_id, row_key, piece, start, length, ids_crc32. Null text is empty: one piece with the end id."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.tokenizer(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                out: list[tuple] = []
                for doc, key, data in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), known.encode(
                        [t or "" for t in batch["text"].to_pylist()])):
                    data += end
                    for i, (start, length) in enumerate(cut(len(data) // 4, size)):
                        out.append((doc, key, i, start, length, zlib.crc32(data[4 * start:4 * (start + length)])))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most that dual feasible functions prove: the volume, and every threshold k that counts long pieces as whole bins.

    For k <= size/2: above size - k a piece counts as a bin, below k as nothing, else as itself. For the halves: pieces above
    size/2 need a bin each.
    """
    count = np.bincount(lengths, minlength=size + 1)
    volume = count * np.arange(size + 1)
    below, total = np.cumsum(volume), volume.sum()
    k = np.arange(0, size // 2 + 1)
    whole = np.cumsum(count[::-1])[::-1]                                     # pieces of at least this length
    above = np.append(whole, 0)[size - k + 1]
    middle = below[size - k] - np.where(k > 0, below[np.maximum(k - 1, 0)], 0)
    bounds = above + -(-middle // size)
    return int(max(bounds.max(), -(-total // size)))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece of a list sorted by falling length, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []                                                    # the different free lengths, sorted
    by_room: dict[int, list[int]] = {}
    n = 0
    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
        else:
            room, b, n = size, n, n + 1
        bins[i], offsets[i] = b, size - room
        if left := room - length:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets, n


def _pack_group(size: int, step: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "row_key", "piece"], ascending=[False, True, True, True])
        bins, offsets, n = best_fit_decreasing(group["length"].to_numpy(), size)
        certified = n == lower_bound(group["length"].to_numpy(), size)
        full = np.bincount(bins, weights=group["length"].to_numpy(), minlength=n)[bins] == size
        return pd.DataFrame({"row_key": group["row_key"].to_numpy(), "piece": group["piece"].to_numpy(), "doc_id": group["doc_id"],
                             "length": group["length"].to_numpy(), "step": step, "part": int(key[0]), "bin": bins, "offset": offsets,
                             "open": ~full & (not certified), "first": offsets == 0})
    return run


PLACED = "row_key long, piece int, doc_id long, length long, step int, part long, bin long, offset long, open boolean, first boolean"


def _packed(rows: DataFrame, n: int, size: int, step: int, group_pieces: int) -> DataFrame:
    groups = max(1, -(-n // group_pieces))
    dealt = rows.select("row_key", "piece", "doc_id", "length", F.pmod(F.xxhash64(F.lit(step), "row_key", "piece"), F.lit(groups)).alias("part"))
    return stage(dealt.groupBy("part").applyInPandas(_pack_group(size, step), PLACED), "packed")


def placed(found: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The stored pieces with their sequence (step, part, bin) and offset."""
    final = []
    now = _packed(found, found.count(), size, 0, group_pieces)
    for step in range(1, rounds + 1):
        loose = now.filter("open")
        before = loose.agg(F.count("*").alias("pieces"), F.count(F.when(F.col("first"), 1)).alias("bins")).collect()[0]
        if before["bins"] < 2:
            break
        again = _packed(loose, before["pieces"], size, step, group_pieces)
        if again.filter("first").count() >= before["bins"]:
            break
        final.append(now.filter("not open"))
        now = again
    final.append(now)
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each; they differ by an internal row key. Sequence ids are unique, not gapless. Empty input gives
    no rows. Offsets inside a sequence start at 0 and leave no gap.
    """
    found = stage(pieces(docs, tokenizer, size), "pieces")
    places = placed(found, size, group_pieces, rounds)
    sequence = (F.col("step").cast("long") * (1 << 58)) + F.col("part") * (1 << 24) + F.col("bin")
    return found.join(places.select("row_key", "piece", sequence.alias("sequence_id"), "offset"), ["row_key", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
