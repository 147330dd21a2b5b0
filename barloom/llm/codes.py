"""Vector code compression: product codes trained with Drake-Hamerly adaptive bounds.

A vector is cut into equal parts; each part position has a codebook. Assigning a part to its nearest entry does not compare it with
all of them again in every round. The state of a part is stored beside the vector: its b closest entries in order of distance, an
upper bound for the first, lower bounds for the others, and one outer bound below which no entry outside the list can lie. When the
entries move, the bounds move by as much. A part whose first entry is nearer than every bound keeps it without a distance; otherwise
the b listed entries get exact integer distances, and only if the best of them is not below the outer bound, all entries do. Bounds are
whole numbers rounded to the safe side and compared strictly, so ties are always settled by exact distances and the lower index.

b is adapted for each part position between rounds: the state keeps how deep in its list a part found its nearest entry (b where the list
did not do), and the lists are cut to the depth that does for 99 of 100 parts, within limits.

A round is one pass that writes the new state and one that adds up sums per entry in each task; the driver holds the codebooks only.

Rows whose vector is null or holds a null or non-finite component are dropped, and those that have not ``dims`` components, since they
cannot be cut alike. Every row counts, repeated rows too; null ids are last. With fewer kept rows than entries there are as many
entries as rows; without any, and for an empty table, the result is empty. Other columns are not read, so none can clash; a null label
is a label. Components beyond 2^18 in size fail the job (see ``vectors``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import vectors
from barloom.llm.vectors import floor_means, lists, matrix, ordered_by, squared, summed, whole_numbers
from barloom.session import stage, unstage

DIMS = 64
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries a part remembers at first, and at least.
CLOSEST = 8
FEWEST = 2
#: Bounds are stored in units of a fourth of the integer distance.
UNIT = 4
BLOCK = 2048

_FAR = np.iinfo(np.int64).max
#: The depth that so many of all parts must find sufficient.
ENOUGH = 0.99
STATE = "vec_id long, label {label}, v array<int>, near array<int>, bound array<long>, outer array<long>, depth array<int>"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def below(d: np.ndarray) -> np.ndarray:
    """A lower bound, in units, of the distances whose squares are given."""
    return np.maximum(np.floor(np.sqrt(d.astype(np.float64)) * (UNIT * (1 - 1e-12))).astype(np.int64), 0)


def above(d: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(d.astype(np.float64)) * (UNIT * (1 + 1e-12))).astype(np.int64)


def _in_order(distances: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (distance, entry) in rising order; equal distances by entry."""
    key = np.sort(distances * k + entries, axis=1)
    return key // k, key % k


@dataclass
class Part:
    """The state of one part position for a block of vectors: near[:, 0] is the assigned entry, bound[:, 0] its upper bound."""

    near: np.ndarray
    bound: np.ndarray
    outer: np.ndarray
    depth: np.ndarray

    def cut(self, b: int) -> Part:
        if b >= self.near.shape[1]:
            return self
        return Part(self.near[:, :b], self.bound[:, :b], np.minimum(self.outer, self.bound[:, b:].min(axis=1)), self.depth)


def closest(x: np.ndarray, book: np.ndarray, b: int) -> Part:
    """The state from all exact distances."""
    k = len(book)
    d, entries = _in_order(squared(x[:, None, :], book[None, :, :]), np.arange(k)[None, :], k)
    b = min(b, k)
    bound = below(d[:, :b])
    bound[:, 0] = above(d[:, 0])
    return Part(entries[:, :b], bound, below(d[:, b]) if b < k else np.full(len(x), _FAR), np.full(len(x), b))


def step(x: np.ndarray, book: np.ndarray, before: np.ndarray, old: Part) -> Part:
    """The state after the entries moved from ``before`` to ``book``."""
    moves = above(squared(book, before))
    near, b = old.near, old.near.shape[1]
    bound = np.maximum(old.bound - moves[near], 0)
    bound[:, 0] = old.bound[:, 0] + moves[near[:, 0]]
    outer = np.where(old.outer == _FAR, _FAR, np.maximum(old.outer - moves.max(), 0))
    others = np.minimum(bound[:, 1:].min(axis=1, initial=_FAR), outer)
    open_ = np.flatnonzero(bound[:, 0] >= others)
    depth = np.zeros(len(x), np.int64)
    if len(open_):
        listed = near[open_]
        d, entries = _in_order(squared(x[open_, None, :], book[listed]), listed, len(book))
        sure = above(d[:, 0]) < outer[open_]
        near, done = near.copy(), open_[sure]
        depth[done] = (listed[sure] == entries[sure][:, :1]).argmax(axis=1)
        near[done] = entries[sure]
        bound[done] = below(d[sure])
        bound[done, 0] = above(d[sure, 0])
        if len(rest := open_[~sure]):
            new = closest(x[rest], book, b)
            near[rest], bound[rest], outer[rest], depth[rest] = new.near, new.bound, new.outer, new.depth
    return Part(near, bound, outer, depth)


def _parts_of(batch: pa.RecordBatch, widths: list[int]) -> list[Part]:
    near, bound, outer, depth = (matrix(batch[c]) for c in ("near", "bound", "outer", "depth"))
    at = np.concatenate(([0], np.cumsum(widths)))
    return [Part(near[:, a:b], bound[:, a:b], outer[:, p], depth[:, p]) for p, (a, b) in enumerate(zip(at[:-1], at[1:]))]


class Books:
    """The codebooks of all part positions, an array (parts, entries, components)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts = len(entries)

    def cut(self, rows: np.ndarray) -> np.ndarray:
        return rows.reshape(len(rows), self.parts, -1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, BLOCK):
            yield big.slice(at, BLOCK)


def _state(batch: pa.RecordBatch, parts: list[Part]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch["vec_id"], batch["label"], batch["v"], lists(np.concatenate([p.near for p in parts], axis=1), pa.int32()),
         lists(np.concatenate([p.bound for p in parts], axis=1), pa.int64()), lists(np.stack([p.outer for p in parts], axis=1), pa.int64()),
         lists(np.stack([p.depth for p in parts], axis=1), pa.int32())], ["vec_id", "label", "v", "near", "bound", "outer", "depth"])


def first_state(kept: DataFrame, books: Books, b: int) -> DataFrame:
    """The first assignment, from all distances; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            x = books.cut(matrix(batch["v"]))
            yield _state(batch, [closest(x[:, p], books.entries[p], b) for p in range(books.parts)])

    return stage(kept.mapInArrow(run, STATE.format(label=kept.schema["label"].dataType.simpleString())), "codes")


def _stepper(books: Books, before: Books, widths: list[int], cut_to: list[int]):
    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, list[Part]]:
        x = books.cut(matrix(batch["v"]))
        return x, [step(x[:, p], books.entries[p], before.entries[p], part.cut(cut_to[p]))
                   for p, part in enumerate(_parts_of(batch, widths))]
    return run


def next_state(state: DataFrame, go: Callable[[pa.RecordBatch], tuple[np.ndarray, list[Part]]]) -> DataFrame:
    """The state after the entries moved; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            yield _state(batch, go(batch)[1])

    return stage(state.mapInArrow(run, state.schema), "codes")


def moved(state: DataFrame, books: Books, widths: list[int]) -> Books:
    """Each entry becomes the componentwise floor of the mean of its parts; unused entries stay."""
    k = books.entries.shape[1]
    firsts = np.concatenate(([0], np.cumsum(widths)))[:-1]

    def sums_of(batch: pa.RecordBatch, found: dict) -> None:
        x, near = books.cut(matrix(batch["v"])), matrix(batch["near"])
        for p, at in enumerate(firsts):
            codes = near[:, at]
            n = np.bincount(codes, minlength=k)
            total = np.zeros((k, x.shape[2]), np.int64)
            np.add.at(total, codes, x[:, p])
            for c in np.flatnonzero(n).tolist():
                have = found.setdefault((p, c), [0, np.zeros(x.shape[2], np.int64)])
                have[0] += int(n[c])
                have[1] += total[c]

    out = books.entries.copy()
    for (p, c), mean in floor_means(summed(state, sums_of, ["part", "entry"]), ["part", "entry"], out.shape[2]).items():
        out[p, c] = mean
    return Books(out)


def adapted(state: DataFrame, widths: list[int], fewest: int = FEWEST) -> list[int]:
    """The list lengths of the next step, one a part position; never longer than now."""
    deep = state.agg(*[F.percentile_approx(F.get("depth", F.lit(p)), ENOUGH) for p in range(len(widths))]).collect()[0]
    return [min(w, max(fewest, d + 1)) for d, w in zip(deep, widths)]


def encoded(vectors_: DataFrame, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, b: int = CLOSEST) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors_.sparkSession
    kept = whole_numbers(vectors_, dims, "label")
    start = kept.orderBy(*ordered_by(F.col("vec_id"), F.col("v"))).limit(entries).select("v").collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    books = Books(np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).swapaxes(0, 1).copy())
    widths = [min(b, len(start))] * parts
    state, go = first_state(kept, books, b), None
    for n in range(rounds):
        before, books = books, moved(state, books, widths)
        cut_to = adapted(state, widths)
        go = _stepper(books, before, widths, cut_to)
        if n + 1 < rounds:
            new = next_state(state, go)
            unstage(state)
            state, widths = new, cut_to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            if go:
                x, found = go(batch)
            else:
                x, found = books.cut(matrix(batch["v"])), _parts_of(batch, widths)
            codes = np.stack([p.near[:, 0] for p in found], axis=1)
            error = sum(squared(x[:, p], books.entries[p][codes[:, p]]) for p in range(books.parts))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    done = stage(state.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"), "coded")
    unstage(state)
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def encoded_sql(dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The plain rounds in DuckDB: every part against every entry of its codebook."""
    size = dims // parts
    sql = [f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS (SELECT r, (i - 1) // {size} AS p, (i - 1) % {size} AS i, x FROM (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k)),
c0 AS (SELECT c, p, i, x AS y FROM e JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM k) USING (r) WHERE c < {entries})"""]
    for n in range(rounds + 1):
        sql.append(f"""d{n} AS (SELECT r, p, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{n} USING (p, i) GROUP BY r, p, c),
a{n} AS (SELECT r, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r, p)""")
        if n < rounds:
            sql.append(f"""s{n} AS (SELECT p, c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{n} USING (r, p) GROUP BY p, c, i),
c{n + 1} AS (SELECT p, c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN s{n} USING (p, c, i))""")
    return ",\n".join(sql) + f""",
f AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, c, i)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN f USING (r)"""
