"""Vectors as integers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Component x becomes floor(SCALE * x).
SCALE = 256
#: The largest size of an integer component, so that squared distances and their keys fit 64 bits.
LARGEST = 1 << 26


def whole_numbers(vectors: DataFrame, dims: int, *others: str) -> DataFrame:
    """(vec_id, others, v): the rows with exactly ``dims`` components, none null or non-finite, v as integers.

    Larger integers than LARGEST cannot be summed exactly in 64 bits; a job that meets one fails instead of being wrong.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = (F.size("embedding") == dims) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    v = F.transform(x, lambda c: F.when(F.abs(c) <= LARGEST / SCALE, F.floor(c * SCALE).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}")).cast("int")))
    return vectors.select("vec_id", "embedding", *others).filter(F.col("embedding").isNotNull() & good).select("vec_id", *others, v.alias("v"))


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """A list column whose lists are all of one length, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1), kind))


def summed(rows: DataFrame, sums_of: Callable[[pa.RecordBatch, dict], None], key: list[str]) -> DataFrame:
    """(*key, n, at, total): what ``sums_of`` adds up per key (a tuple of ints) in each task, then over all tasks.

    ``sums_of`` puts key -> [count, vector of totals] into its second argument; a task emits one row per key it met.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows:
                sums_of(batch, found)
        if found:
            keys = list(zip(*found))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k, pa.int32()) for k in keys], pa.array([v[0] for v in found.values()], pa.int64()),
                 lists(np.array([v[1] for v in found.values()]), pa.int64())], [*key, "n", "totals"])

    parts = rows.mapInArrow(run, ", ".join(f"{k} int" for k in key) + ", n long, totals array<long>")
    return parts.select(*key, "n", F.posexplode("totals").alias("at", "total")).groupBy(*key, "at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))


def floor_means(sums: DataFrame, key: list[str], dims: int) -> dict[tuple, np.ndarray]:
    """key -> componentwise floor(total / n); the caller bounds the number of keys."""
    out: dict[tuple, np.ndarray] = {}
    for row in sums.collect():
        out.setdefault(tuple(row[k] for k in key), np.zeros(dims, np.int64))[row["at"]] = row["total"] // row["n"]
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def ordered_by(*columns: Column) -> list[Column]:
    return [c.asc_nulls_last() for c in columns]
