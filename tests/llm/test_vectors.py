"""Vector codes and centroid clustering against plain Python rounds over awkward vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from barloom.llm import centroids, codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int, near long"


def awkward_vectors():
    r = random.Random(8)
    vec = lambda s=0.2: [r.gauss(0, s) for _ in range(64)]
    hot = [float(x) for x in np.float32(vec())]
    rows = [(i, vec() if i % 3 else hot, None if i % 5 == 0 else i % 4) for i in range(220)]
    rows += [(300 + i, [x + r.gauss(0, 0.01) for x in hot], 1) for i in range(60)]
    rows += [(400, None, 1), (401, [], 1), (402, vec()[:63], 2), (403, [None, *vec()[1:]], 2), (404, [math.nan, *vec()[1:]], 2),
             (405, [math.inf, *vec()[1:]], None), (406, [0.0] * 64, 3), (407, [-0.001] * 64, 3), (408, [1.0] * 64, 3), (409, [-1.0] * 64, 3)]
    rows += [rows[6], rows[6], (None, vec(), None)]
    return [(a, b, c, "x", 7, 1) for a, b, c in rows]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame(awkward_vectors(), SCHEMA).repartition(4).cache()


def kept(rows):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for r in good]


def best(x, book):
    d = [sum((p - q) ** 2 for p, q in zip(x, y)) for y in book]
    return d.index(min(d)), min(d)


def means(book, rows, found):
    out = []
    for c, y in enumerate(book):
        mine = [x for x, f in zip(rows, found) if f == c]
        out.append([sum(col) // len(mine) for col in zip(*mine)] if mine else y)
    return out


def sha(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


@pytest.mark.parametrize("entries,rounds,b", [(64, 2, 8), (20, 4, 3), (64, 5, 2)])
def test_codes(embeddings, entries, rounds, b):
    rows = sorted(kept(awkward_vectors()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[2][4 * p:4 * p + 4] for r in rows[:entries]] for p in range(16)]
    for n in range(rounds + 1):
        found = [[best(r[2][4 * p:4 * p + 4], books[p]) for r in rows] for p in range(16)]
        if n < rounds:
            books = [means(books[p], [r[2][4 * p:4 * p + 4] for r in rows], [f[0] for f in found[p]]) for p in range(16)]
    digest = sha([x for book in books for y in book for x in y])
    error = [sum(found[p][i][1] for p in range(16)) for i in range(len(rows))]
    of = {}
    for r, e in zip(rows, error):
        of[r[1]] = of.get(r[1], 0) + e
    want = [(r[0], "".join(f"{found[p][i][0]:02x}" for p in range(16)), error[i], of[r[1]], digest) for i, r in enumerate(rows)]
    got = [tuple(x) for x in codes.encoded(embeddings, entries=entries, rounds=rounds, b=b).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bounds_hold_and_spare_distances():
    """After moves, each listed bound is below its distance, the outer bound below all others, and most parts need no distance."""
    r = np.random.default_rng(3)
    x, book = r.integers(-300, 300, (4000, 4)), r.integers(-300, 300, (64, 4))
    old = codes.closest(x, book, 8)
    moved = book + r.integers(-4, 5, book.shape)
    new = codes.step(x, moved, book, old.cut(5))
    exact = np.sqrt(codes.squared(x[:, None, :], moved[None]).astype(float)) * codes.UNIT
    want = codes.closest(x, moved, 5)
    assert (new.near[:, 0] == want.near[:, 0]).all()
    listed = np.take_along_axis(exact, new.near, axis=1)
    assert (new.bound[:, 0] >= listed[:, 0]).all() and (new.bound[:, 1:] <= listed[:, 1:]).all()
    rest = exact.copy()
    np.put_along_axis(rest, new.near, np.inf, axis=1)
    assert (new.outer <= rest.min(axis=1)).all()
    assert (new.depth == 0).mean() > 0.5 and (new.depth == 5).mean() < 0.2


@pytest.mark.parametrize("k,rounds,pivots", [(40, 5, 12), (9, 3, 1), (40, 0, 40)])
def test_centroids(embeddings, k, rounds, pivots):
    rows = kept(awkward_vectors())
    name = lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()
    rows.sort(key=lambda r: (r[0] is None, name(r), r[2]))
    book = [r[2] for r in rows[:k]]
    for n in range(rounds + 1):
        found = [best(r[2], book) for r in rows]
        if n < rounds:
            book = means(book, [r[2] for r in rows], [f[0] for f in found])
    of = {}
    for c, d in found:
        of[c] = of.get(c, 0) + d
    want = [(r[0], c, d, of[c], sum(of.values()), sha(book[c])) for r, (c, d) in zip(rows, found)]
    got = [tuple(x) for x in centroids.clustered(embeddings, centroids=k, rounds=rounds, pivots=pivots).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pivots_spare_distances():
    r = np.random.default_rng(5)
    book = r.integers(-100, 100, (40, 64))
    rows = book[r.integers(0, 40, 2000)] + r.integers(-15, 16, (2000, 64))
    pivots = centroids.pivots_of(book)
    got, d, exact = centroids.nearest(rows, centroids.distances_to(rows, pivots), book, centroids.distances_to(book, pivots))
    all_d = centroids.squared(rows[:, None, :], book[None])
    assert (got == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
    assert exact < 0.5 * all_d.size


def test_empty_and_few(spark, embeddings):
    empty = embeddings.limit(0)
    assert codes.encoded(empty).count() == centroids.clustered(empty).count() == 0
    assert codes.encoded(empty).columns == codes.encoded(embeddings.filter("vec_id < 3")).columns
    three = embeddings.filter("vec_id in (1, 2, 4)")
    assert sorted((x.vec_id, x.error) for x in codes.encoded(three).collect()) == [(1, 0), (2, 0), (4, 0)]
    assert sorted(x.distance for x in centroids.clustered(three).collect()) == [0, 0, 0]
    huge = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="beyond"):
        codes.encoded(huge).collect()
