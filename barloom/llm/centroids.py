"""Centroid clustering with a LAESA pivot table: exact rounds in which few distances are computed.

A few initial centroids that lie far apart stay fixed as pivots. The distances of every vector to the pivots are stored once. In each
round the centroids' distances to the pivots are computed (a table of centroids x pivots); by the triangle inequality the largest
difference of a vector's and a centroid's pivot distances is a lower bound of their distance. A vector is compared with the centroid
of the lowest bound, and then only with the centroids whose bound does not exceed that distance. These get exact integer distances,
so ties go to the smaller number. Roundings of the stored distances are covered by a margin that only lets more centroids through.

Each round is one pass over the stored table; a task returns its sums per centroid, and the driver holds the centroids only.

Rows whose vector is null, has not ``dims`` components or holds a null or non-finite one are dropped. Every row is a vector of its own,
repeated rows too. Null ids are hashed last. With fewer kept rows than centroids there are as many centroids as rows; without any, and
for an empty table, the result is empty. Other columns than ``vec_id`` and ``embedding`` are not read, so none can clash. Vectors at
equal distances go to the smaller number. Components beyond 2^18 in size fail the job (see ``vectors``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import vectors
from barloom.llm.vectors import floor_means, lists, matrix, ordered_by, squared, summed, whole_numbers
from barloom.session import stage, unstage

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 12
#: Vectors that are compared at a time in a task.
BLOCK = 1024

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def pivots_of(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Centroids that lie far apart: each next one is the farthest from all before it."""
    chosen = [0]
    away = squared(centroids, centroids[0])
    while len(chosen) < min(n, len(centroids)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(centroids, centroids[chosen[-1]]))
    return centroids[chosen]


def distances_to(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(rows[:, None, :], pivots[None, :, :]).astype(np.float64))


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, away): the vectors with their distances to the pivots; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                batch = big.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["v"], lists(distances_to(matrix(batch["v"]), pivots), pa.float64())], ["vec_id", "v", "away"])

    return stage(kept.mapInArrow(run, "vec_id long, v array<int>, away array<double>"), "pivots")


def nearest(rows: np.ndarray, away: np.ndarray, centroids: np.ndarray, centroids_away: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, and the number of exact distances it took."""
    low = np.zeros((len(rows), len(centroids)))
    for p in range(away.shape[1]):
        np.maximum(low, np.abs(away[:, p, None] - centroids_away[None, :, p]), out=low)
    known = squared(rows, centroids[low.argmin(axis=1)])
    reach = np.sqrt(known.astype(np.float64)) * (1 + 1e-9) + 1e-5
    r, c = np.nonzero(low <= reach[:, None])
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[r, c] = squared(rows[r], centroids[c])
    best = exact.argmin(axis=1)                                          # the smaller number where distances are equal
    return best, exact[np.arange(len(rows)), best], len(rows) + len(r)


def _assigner(centroids: np.ndarray, pivots: np.ndarray):
    centroids_away = distances_to(centroids, pivots)

    def assign(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, away = matrix(batch["v"]), matrix(batch["away"], np.float64)
        parts = [nearest(rows[at:at + BLOCK], away[at:at + BLOCK], centroids, centroids_away)[:2] for at in range(0, len(rows), BLOCK)]
        return rows, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    return assign


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    assign = _assigner(centroids, pivots)

    def sums_of(batch: pa.RecordBatch, found: dict) -> None:
        rows, best, _ = assign(batch)
        for c in np.unique(best).tolist():
            mine = rows[best == c]
            total = found.setdefault((c,), [0, np.zeros(rows.shape[1], np.int64)])
            total[0] += len(mine)
            total[1] += mine.sum(axis=0)

    out = centroids.copy()
    for (c,), mean in floor_means(summed(table, sums_of, ["cluster"]), ["cluster"], centroids.shape[1]).items():
        out[c] = mean
    return out


def clustered(vectors_: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors_.sparkSession
    kept = whole_numbers(vectors_, dims)
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(*ordered_by(name, F.col("v"))).limit(centroids).collect()
    if not start:
        return spark.createDataFrame([], RESULT)
    now = np.array([r["v"] for r in start], np.int64)
    fixed = pivots_of(now, pivots)
    table = pivot_table(kept, fixed)
    for _ in range(rounds):
        now = moved(table, now, fixed)
    assign = _assigner(now, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, best, distance = assign(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    found = stage(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    unstage(table)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())            # one row a centroid
    known = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(now.tolist())],
        "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), F.col("cluster") == F.col("of")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered_sql(dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The plain rounds in DuckDB: every vector against every centroid."""
    parts = [f"""WITH k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k),
c0 AS (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM k) WHERE c < {centroids})"""]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{n} USING (i) GROUP BY r, c),
a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM k JOIN a{rounds} USING (r) JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""
